"""Streaming forms of the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from timedtext.operators import recognize as rec_ops
from timedtext.operators import runs, timeline
from timedtext.operators.fold import fold
from timedtext.streaming.ordered import ordered_fold
from timedtext.streaming.windows import windowed

#: Parts of a published table.
BUCKETS = 256


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, per_trigger: int = 1, format: str = "parquet") -> DataFrame:
    """A folder of files as a stream of at most `per_trigger` files at a time."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode="append") -> None:
    """Writes what there is now as Parquet and ends."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def timeline_state(frames: DataFrame, gaps="auto", key="rec") -> DataFrame:
    """(rec, next, end, shift) behind the frames of a batch, for a stream that goes on from there."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list]:
        rec, seq, pts, n, delay, tolerance, transport = row
        now, _ = timeline.place_frame(state and state[2], pts, n, delay, tolerance, transport, gaps)
        return (rec, seq + 1, now), []

    schema = T.StructType([frames.schema[key], T.StructField("next", T.LongType()), *timeline.STATE])
    rows = frames.select(key, "seq", "pts", "n_samples", "delay", "tolerance", "transport")
    return fold(rows, key, ["seq"], lambda: None, step, schema, lambda state: [(state[0], state[1], *state[2])])


def stream_align_timeline(frames: DataFrame, gaps="auto", key="rec", idle: float | None = None, begin: DataFrame | None = None) -> DataFrame:
    """align_timeline with its state by recording. frames have seq from 1 on; late ones are placed in their turn and never dropped. begin: timeline_state of what a batch has placed."""
    columns = [key, "seq", "pts", "n_samples", "delay", "tolerance", "transport"]

    def step(state, row):
        rec, seq, pts, n, delay, tolerance, transport = row
        state, placed = timeline.place_frame(state, *(None if x is None else int(x) for x in (pts, n, delay, tolerance)), transport, gaps)
        return state, [(rec, int(seq), *placed, n)]

    return ordered_fold(frames.select(columns), key, columns, "seq", 1, lambda r: int(r[1]) + 1, lambda: None, step, timeline.aligned_type(frames, key), timeline.STATE, idle, begin)


def stream_budget(events: DataFrame, strict=False, limit_s=30, key="rec", idle: float | None = None) -> DataFrame:
    """decode_budget with its state by recording: one row when a recording first fails. events: seq from 0 on, kind, seconds, recoverable."""
    columns = [key, "seq", "kind", "seconds", "recoverable"]

    def step(state, row):
        spent, damaged, stuck, failed = state
        stuck = int(stuck)
        rec, seq, kind, seconds, recoverable = row
        reason = None
        if kind == "packet":
            stuck = 0
            if seconds is not None and np.isfinite(seconds) and seconds > 0:
                spent += float(seconds)
        elif kind == "frame":
            spent, damaged, stuck = 0.0, False, 0
        elif kind == "error" and recoverable:
            damaged, stuck = True, stuck + 1
            reason = "strict" if strict else "stalled" if stuck >= timeline.STALLED else None
        if reason is None and limit_s and damaged and spent >= limit_s and (kind == "await" or (kind == "error" and recoverable)):
            reason = "time"
        made = [(rec, int(seq), reason)] if reason and not failed else []
        return (spent, damaged, stuck, failed or bool(reason)), made

    schema = T.StructType([events.schema[key], T.StructField("seq", T.LongType()), T.StructField("reason", T.StringType())])
    rows = events.withColumn("recoverable", timeline.classify_code("code") == "recoverable").select(columns)
    state = T.StructType([T.StructField("spent", T.DoubleType()), T.StructField("damaged", T.BooleanType()), T.StructField("stuck", T.LongType()), T.StructField("failed", T.BooleanType())])
    return ordered_fold(rows, key, columns, "seq", 0, lambda r: int(r[1]) + 1, lambda: (0.0, False, 0, False), step, schema, state, idle)


def stream_windows(blocks: DataFrame, recognize: rec_ops.Recognize, choose_cut: rec_ops.ChooseCut, limit: int, guard: int, key="rec", idle: float | None = None, begin: DataFrame | None = None) -> DataFrame:
    """recognize_windows with the tail of each recording in state. A block without samples marks the recording's end.

    begin: manifests (rec, chunks, samples) of what a batch has committed, whose samples
    are not needed again.
    """
    return windowed(blocks, recognize, choose_cut, limit, guard, key, idle, begin)


def stream_paragraphs(segments: DataFrame, pause_ms: int, key="rec", delay="1 hour") -> DataFrame:
    """(rec, language, start, end, n): sections of one language without a pause of pause_ms, as sessions.

    Equal to paragraph_breaks on segments of one language that do not overlap. A
    pause of exactly pause_ms breaks, so the gap of a session is a microsecond less.
    segments: rec, ts (when it starts), duration_ms, language.
    """
    gap = F.concat((F.col("duration_ms") * 1000 + pause_ms * 1000 - 1).cast("string"), F.lit(" microseconds"))
    rows = segments.withWatermark("ts", delay).groupBy(key, "language", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max(F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, duration_ms / 1000)")).alias("end")).select(key, "language", "start", "end", "n")


def stream_grid_totals(segments: DataFrame, seconds=120, key="rec", delay="1 hour") -> DataFrame:
    """(rec, start, n, speech_ms) by windows of fixed length. segments: rec, ts, duration_ms."""
    rows = segments.withWatermark("ts", delay).groupBy(key, F.window("ts", f"{seconds} seconds").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum("duration_ms").alias("speech_ms")).select(key, F.col("w.start").alias("start"), "n", "speech_ms")


def _known(spark: SparkSession, path: str, schema: T.StructType, columns: list[str], buckets: list[int]) -> DataFrame:
    """What the table at `path` has in some buckets; nothing before the first batch."""
    try:
        return spark.read.parquet(path).filter(F.col("bucket").isin(buckets)).select(*columns)
    except AnalysisException:  # the first batch
        return spark.createDataFrame([], schema).select(*columns)


def publish_batch(results: DataFrame, sink: str, key=("rec", "format")) -> DataFrame:
    """Publishes the results (key, content) that the sink does not have and returns those that differ from what it has, which are quarantined.

    A repeat of what is there changes nothing, in the quarantine neither. Of several
    contents of one key in a batch, the one of least hash is published, the others
    differ from it. Both tables are kept by buckets of the key, and a batch reads keys
    and hashes of its own buckets only. Contents are dealt once, by bucket, and what is
    known goes the same way, so a batch writes a file or two a bucket, whatever its size.
    """
    spark = results.sparkSession
    schema = T.StructType([*results.schema, T.StructField("hash", T.StringType()), T.StructField("bucket", T.IntegerType())])
    rows = results.withColumn("hash", F.sha2("content", 256)).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"))
    buckets = [r[0] for r in results.select(F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().collect()]
    names = ["bucket", *key, "hash"]
    both = rows.withColumn("__kind", F.lit(2))
    for kind, path in enumerate((sink, f"{sink}-quarantine")):
        both = both.unionByName(_known(spark, path, schema, names, buckets).withColumn("__kind", F.lit(kind)), allowMissingColumns=True)
    own, same = W.partitionBy("bucket", *key), W.partitionBy("bucket", *key, "hash")
    new = F.col("__kind") == 2
    both = both.repartition("bucket").withColumn("__was", F.max(F.when(F.col("__kind") == 0, F.col("hash"))).over(own)).withColumn("__least", F.min(F.when(new, F.col("hash"))).over(own))
    both = both.withColumn("__kept", F.bool_or(F.col("__kind") == 1).over(same)).withColumn("__turn", F.row_number().over(same.orderBy(F.desc("__kind"))))
    # the first new row of its key and hash; a known hash that is null is no reason to compare
    first = both.filter("__kind = 2 and __turn = 1").withColumn("__new", F.expr("__was is null and hash <=> __least"))
    first = first.filter("__new or (not __kept and not coalesce(__was, __least) <=> hash)").select(*rows.columns, "__new").persist()
    first.filter("__new").drop("__new").write.mode("append").partitionBy("bucket").parquet(sink)
    first.filter("not __new").drop("__new").write.mode("append").partitionBy("bucket").parquet(f"{sink}-quarantine")
    first.unpersist()
    return spark.read.schema(schema).parquet(f"{sink}-quarantine")


def stream_publish(results: DataFrame, sink: str, checkpoint: str, key=("rec", "format")) -> StreamingQuery:
    """publish_batch for each batch of a stream."""
    return results.writeStream.foreachBatch(lambda df, _: publish_batch(df, sink, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(stream: DataFrame, path: str, checkpoint: str, saved: DataFrame, current: DataFrame, key="job") -> None:
    """run_available from a checkpoint, but only under the same settings; a difference is an error that names the fields."""
    changed = runs.changed_fields(runs.diff_settings(saved, current, key), key).orderBy(key).limit(5).collect()
    if changed:
        raise ValueError("settings changed: " + "; ".join(f"{r[0]}: {r['fields']}" for r in changed))
    run_available(stream, path, checkpoint)
