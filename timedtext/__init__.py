"""Timed audio and transcript tables on PySpark."""
