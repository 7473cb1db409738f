"""All queries of the library with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timedtext.plans import queries_audio, queries_runs, queries_segments, queries_streams, queries_timeline, views

MODULES = (queries_segments, queries_timeline, queries_runs, queries_audio, queries_streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(views.Views(spark, sf_dir))) for m in MODULES for name, (f, _) in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: views.duckdb(sql) for m in MODULES for name, (_, sql) in m.Q.items() if sql}
