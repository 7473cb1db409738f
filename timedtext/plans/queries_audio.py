"""Queries on samples, and on media that is derived from them. Q: name to (query on the views, DuckDB SQL or None)."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from timedtext.functions.scratch import fresh_path
from timedtext.operators import audio
from timedtext.sources import media, sinks

RATE = 48_000


def as_wav(samples) -> bytes:
    """Mono samples as a WAV file with 32-bit floats at 16 kHz."""
    data = np.asarray(samples, "<f4").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 3, 1, 16_000, 64_000, 4, 32, b"data", len(data))
    return head + data


def _wav_files(v):
    make = F.udf(as_wav, "binary")  # the test data has no media files, so the samples are put into some first
    return audio.pcm_blocks(v.pcm_v).select(F.col("rec").cast("string").alias("path"), make("samples").alias("content"))


def _ranges(v):
    """The files written, and read by ranges of 64 bytes."""
    path = fresh_path(v.spark, "media")
    sinks.write_files(_wav_files(v).select(F.concat("path", F.lit(".wav")).alias("name"), "content"), path)
    rec = F.regexp_extract("rec", r"([0-9]+)\.wav\z", 1).cast("long")
    return media.read_wav(v.spark, path, "*.wav", range_bytes=64, block=12).select(rec.alias("rec"), F.posexplode("samples").alias("pos", "x"), "start_sample").select("rec", (F.col("start_sample") + F.col("pos")).alias("i"), "x")


Q = {
    "digital_silence": (lambda v: audio.silent_recordings(v.pcm_v), "SELECT rec, bool_and(x = 0) AS silent FROM pcm_v GROUP BY rec"),
    "digital_silence_blocks": (
        lambda v: audio.pcm_blocks(v.pcm_v, 16).select("rec", "start_sample", audio.digital_silence("samples").alias("silent")),
        "SELECT rec, i // 16 * 16 AS start_sample, bool_and(x = 0) AS silent FROM pcm_v GROUP BY ALL",
    ),
    "signal_stats": (
        lambda v: audio.signal_stats(v.pcm_v).withColumn("energy", F.round("energy", 9)),
        """SELECT rec, round(sum(x::DOUBLE * x::DOUBLE), 9) AS energy, count(*) FILTER (WHERE c) AS crossings
           FROM (SELECT rec, x, (x < 0) <> (lag(x) OVER (PARTITION BY rec ORDER BY i) < 0) AS c FROM pcm_v) GROUP BY rec""",
    ),
    "compare_pcm": (
        lambda v: audio.compare_pcm(v.pcm_v, v.pcm_v.withColumn("x", (F.col("x") * F.when(F.col("i") % 2 == 0, 1.0).otherwise(0.9)).cast("double")), skip=(8, 16)).withColumn("relative_error", F.round("relative_error", 9)),
        """SELECT rec, count(*) AS samples, CASE WHEN sum(a * a) > 0 THEN round(sum((a - b) * (a - b)) / sum(a * a), 9) END AS relative_error
           FROM (SELECT rec, x::DOUBLE AS a, x::DOUBLE * CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS b FROM pcm_v WHERE i NOT BETWEEN 8 AND 15) GROUP BY rec""",
    ),
    "pcm_blocks": (
        lambda v: audio.pcm_blocks(v.pcm_v, 24).select("rec", "start_sample", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total")),
        "SELECT rec, i // 24 * 24 AS start_sample, count(*) AS n, round(sum(x::DOUBLE), 6) AS total FROM pcm_v GROUP BY ALL",
    ),
    "read_pcm": (
        lambda v: media.read_pcm(_wav_files(v), block=32).select(F.col("rec").cast("long").alias("rec"), F.posexplode("samples").alias("pos", "x"), "start_sample").select("rec", (F.col("start_sample") + F.col("pos")).alias("i"), "x"),
        "SELECT rec, i, x FROM pcm_v",
    ),
    "read_wav": (lambda v: _ranges(v), "SELECT rec, i, x FROM pcm_v"),
    "downmix_resample": (
        # each block of 32 samples as two equal channels at 16 kHz: the sum times sqrt(1/2)
        lambda v: audio.downmix_resample(audio.pcm_blocks(v.pcm_v, 32).select("rec", F.col("start_sample").alias("seq"), F.flatten(F.transform("samples", lambda x: F.array(x, x))).alias("samples"), F.lit(16_000).alias("rate"), F.lit(2).alias("channels")))
        .select("rec", "start_sample", F.posexplode("samples").alias("pos", "x"))
        .select("rec", (F.col("start_sample") + F.col("pos")).alias("i"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x")),
        "SELECT rec, i, round(((x::DOUBLE + x::DOUBLE) * sqrt(0.5::DOUBLE))::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS x FROM pcm_v",
    ),
}
