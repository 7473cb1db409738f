"""Queries that run a stream to its end over tables derived from the given ones. Q: name to (query on the views, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from timedtext.functions.scratch import fresh_path, written
from timedtext.operators import audio, recognize
from timedtext.operators import timeline as tl
from timedtext.plans import queries_segments as qs
from timedtext.plans import queries_timeline as qt
from timedtext.streaming import operators as st
from timedtext.streaming.ordered import use_rocksdb

EPOCH = "timestamp_millis({0})"


def through(v, df, make, files=4, per_trigger=2, closing=None):
    """`df` as a stream of files through make, and what comes out as a table. `closing` comes after all that, in a run of its own."""
    source, sink, checkpoint = (fresh_path(v.spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    use_rocksdb(v.spark)
    for part, n in ((df, files), (closing, 1)):
        if part is not None:
            (part.repartition(n) if n else part).write.mode("append").parquet(source)
            out = make(st.stream_table(v.spark, source, df.schema, per_trigger))
            st.run_available(out, sink, checkpoint)
    return v.spark.read.schema(out.schema).parquet(sink)


def paragraphs(v):
    """Sessions by recording and language of one-language input; the watermark is closed by a row far ahead."""
    rows = v.seg_v.select("rec", F.timestamp_millis("start_ms").alias("ts"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.lit("xx").alias("language"))
    ahead = v.seg_v.groupBy().agg((F.max("end_ms") + 86_400_000 * 30).alias("ms")).select(F.lit(-1).cast("long").alias("rec"), F.timestamp_millis("ms").alias("ts"), F.lit(0).cast("long").alias("duration_ms"), F.lit("xx").alias("language"))
    done = through(v, rows, lambda s: st.stream_paragraphs(s, qs.PAUSE_MS), per_trigger=1000, closing=ahead)
    return done.filter("rec >= 0").select("rec", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


def grid(v):
    rows = v.seg_v.select("rec", F.timestamp_millis("start_ms").alias("ts"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    ahead = v.seg_v.groupBy().agg((F.max("end_ms") + 86_400_000 * 30).alias("ms")).select(F.lit(-1).cast("long").alias("rec"), F.timestamp_millis("ms").alias("ts"), F.lit(0).cast("long").alias("duration_ms"))
    done = through(v, rows, lambda s: st.stream_grid_totals(s, 30), per_trigger=1000, closing=ahead)
    return done.filter("rec >= 0").select("rec", F.unix_millis("start").alias("start_ms"), "n", "speech_ms")


def windows(v):
    """Blocks of samples, and for each recording an empty one that ends it."""
    blocks = audio.pcm_blocks(v.pcm_v, 32)
    ends = blocks.groupBy("rec").agg(F.max(F.col("start_sample") + F.size("samples")).alias("start_sample")).withColumn("samples", F.array().cast("array<float>"))
    done = through(v, blocks.unionByName(ends), lambda s: st.stream_windows(s, qt.fake_recognizer, qt.choose_cut, 16, 4))
    return done.select("rec", "idx", "start_sample", "end_sample", "silent", F.size("segments").cast("long").alias("n"))


def timeline_from_batch(v):
    """The first frames of every other recording placed by a batch, and the rest by a stream that begins there."""
    rows = v.frames_v.select(FRAMES)
    first = rows.filter("rec % 2 = 0 and seq <= 5")
    begin = st.timeline_state(first)
    done = through(v, rows.filter("rec % 2 <> 0 or seq > 5"), lambda s: st.stream_align_timeline(s, begin=begin))
    return tl.align_timeline(first).unionByName(done).drop("n_samples")


def windows_from_batch(v):
    """The first windows of every other recording from a batch, and the rest from a stream that begins there and reads only the samples from there on."""
    blocks = audio.pcm_blocks(v.pcm_v, 8)
    ends = blocks.groupBy("rec").agg(F.max(F.col("start_sample") + F.size("samples")).alias("start_sample")).withColumn("samples", F.array().cast("array<float>"))
    first = recognize.recognize_windows(blocks, qt.fake_recognizer, qt.choose_cut, 16, 4).filter("rec % 2 = 0 and idx < 2")
    begin = written(first.groupBy("rec").agg(F.max("end_sample").alias("samples"), F.count("*").alias("chunks")), "begin")
    rest = blocks.unionByName(ends).join(begin.select("rec", F.col("samples").alias("at")), "rec", "left").filter("size(samples) = 0 or start_sample + size(samples) > coalesce(at, 0)").drop("at")
    done = through(v, rest, lambda s: st.stream_windows(s, qt.fake_recognizer, qt.choose_cut, 16, 4, begin=begin))
    return first.unionByName(done).select("rec", "idx", "start_sample", "end_sample", "silent", F.size("segments").cast("long").alias("n"))


def publish(v):
    """Renderings published twice by a stream, the second time with some that differ."""
    rows = v.docseg_v.select("rec", F.col("seq").cast("string").alias("format"), F.col("text").alias("content"))
    again = v.docseg_v.select("rec", F.col("seq").cast("string").alias("format"), F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    sink = fresh_path(v.spark, "published")
    for df in (rows, again):
        source = fresh_path(v.spark, "results")
        df.write.parquet(source)
        st.stream_publish(st.stream_table(v.spark, source, df.schema, 1000), sink, fresh_path(v.spark, "state")).awaitTermination()
    kept = v.spark.read.parquet(sink).select("rec", "format", "hash", F.lit(False).alias("quarantined"))
    return kept.union(v.spark.read.parquet(f"{sink}-quarantine").select("rec", "format", "hash", F.lit(True)))


def resumed(v):
    """A stream that is stopped after the first files and goes on from its checkpoint under the same settings."""
    source, sink, checkpoint = (fresh_path(v.spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    rows = v.seg_v.select("rec", "seq", "start_ms")
    settings = v.spark.range(1).select(F.col("id").alias("job"), F.lit("x").alias("model"))
    for part in (rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")):
        part.write.mode("append").parquet(source)
        st.resume(st.stream_table(v.spark, source, rows.schema, 100), sink, checkpoint, settings, settings)
    return v.spark.read.parquet(sink)


def late(v):
    """The timeline of frames that arrive last first, a few at a time: none is lost."""
    rows = v.frames_v.select(FRAMES)
    done = through(v, rows.repartitionByRange(4, F.desc("seq")), lambda s: st.stream_align_timeline(s), files=None, per_trigger=1)
    return done.groupBy("rec").agg(F.count("*").alias("n"), F.sum("n_samples").alias("samples"), F.max("timeline_end").alias("timeline_end"))


FRAMES = ["rec", "seq", "pts", "n_samples", "delay", "tolerance", "transport"]
Q = {
    "stream_table": (lambda v: through(v, v.seg_v.select("rec", "seq", "start_ms"), lambda s: s), "SELECT rec, seq, start_ms FROM seg_v"),
    "stream_align_timeline": (
        lambda v: through(v, v.frames_v.select(FRAMES), lambda s: st.stream_align_timeline(s)).drop("n_samples"),
        f"WITH {qt.ALIGNED.format(auto='')} {qt.SHOWN}",
    ),
    "late_policy": (
        late,
        f"WITH {qt.ALIGNED.format(auto='')} SELECT rec, count(*) AS n, CAST(sum(n_samples) AS BIGINT) AS samples, max(coalesce(pos, 0)) AS timeline_end FROM st GROUP BY rec",
    ),
    "stream_budget": (
        lambda v: through(v, qt.long_packets(v).withColumn("seq", F.col("seq") - 3), lambda s: st.stream_budget(s, limit_s=3)).withColumn("seq", F.col("seq") + 3),
        f"WITH {qt.EVENTS} {qt.LATE}",
    ),
    "stream_windows": (windows, qt.Q["recognize_windows"][1].replace("false AS whole, ", "")),
    "stream_align_timeline_from_batch": (timeline_from_batch, f"WITH {qt.ALIGNED.format(auto='')} {qt.SHOWN}"),
    "stream_windows_from_batch": (windows_from_batch, qt.Q["recognize_windows"][1].replace("false AS whole, ", "")),
    "stream_paragraphs": (
        paragraphs,
        f"""SELECT rec, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM (
              SELECT *, sum(b) OVER (PARTITION BY rec ORDER BY seq) AS g FROM (
                SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY rec ORDER BY seq) >= {qs.PAUSE_MS} THEN 1 ELSE 0 END AS b FROM seg_v)) GROUP BY rec, g""",
    ),
    "stream_grid_totals": (grid, "SELECT rec, start_ms // 30000 * 30000 AS start_ms, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms FROM seg_v GROUP BY ALL"),
    "stream_publish": (
        publish,
        """SELECT rec, seq::VARCHAR AS format, sha256(text) AS hash, false AS quarantined FROM docseg_v
           UNION ALL SELECT rec, seq::VARCHAR, sha256(text || '!'), true FROM docseg_v WHERE doc_id % 10 = 0""",
    ),
    "resume": (resumed, "SELECT rec, seq, start_ms FROM seg_v"),
}
