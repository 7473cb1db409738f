"""Operators on timed segments: repair, validation, order and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timedtext.functions import text as t

MAX_LANGUAGES = 256


def clamp_segment(segments: DataFrame, duration: Column | str, start_cs="start_cs", end_cs="end_cs") -> DataFrame:
    """Centiseconds to start_s and end_s, the start within the window and the end within start and window."""
    d = F.col(duration) if isinstance(duration, str) else duration
    start = F.least(F.greatest(F.col(start_cs) / 100.0, F.lit(0.0)), d)
    return segments.withColumn("start_s", start).withColumn("end_s", F.least(F.greatest(F.col(end_cs) / 100.0, F.col("start_s")), d))


def rebase_segments(segments: DataFrame, offset="offset_samples", count="count_samples") -> DataFrame:
    """Window time to recording time; an end is at most that of the window's last sample."""
    moved = t.samples_to_seconds(F.col(offset))
    return segments.withColumn("start_s", F.col("start_s") + moved).withColumn("end_s", F.least(F.col("end_s") + moved, t.samples_to_seconds(F.col(offset) + F.col(count))))


def drop_blank(segments: DataFrame, text="text") -> DataFrame:
    return segments.filter(t.trim_text(text) != "")


def invalid_reason(start: Column | str = "start_s", end: Column | str = "end_s", low: Column | float = 0.0, high: Column | float = float("inf"), probability: Column | str | None = None) -> Column:
    """Why a segment is invalid; null if it is valid."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    numbers = [F.col(x) if isinstance(x, str) else x for x in (start, end, *([] if probability is None else [probability]))]
    start, end = numbers[:2]
    all_finite = F.lit(True)
    for c in numbers:
        all_finite = all_finite & F.coalesce(finite(c), F.lit(False))
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (
        F.when(~all_finite, "not finite")
        .when(start < low, "starts too early")
        .when(end < start, "ends before its start")
        .when(end > high, "ends too late")
    )


def validate_segments(segments: DataFrame, strict=False, **limits) -> DataFrame:
    """`segments` with `reason`; with `strict`, the first invalid row is an error."""
    out = segments.withColumn("reason", invalid_reason(**limits))
    if strict:
        out = out.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("string")))
    return out


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows without `reason`, and the others with it."""
    return validated.filter("reason is null").drop("reason"), validated.filter("reason is not null")


def languages(segments: DataFrame, *key: str, order="seq", limit=MAX_LANGUAGES) -> DataFrame:
    """(key, languages): distinct languages in the order of first appearance, without the empty one; more than `limit` is an error."""
    first = segments.filter("language <> ''").groupBy(*key, "language").agg(F.min(order).alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "language"))), lambda x: x["language"])
    out = first.groupBy(*key).agg(listed.alias("languages"))
    return out.withColumn("languages", F.when(F.size("languages") > limit, F.raise_error(F.lit("too many languages")).cast("array<string>")).otherwise(F.col("languages")))


def language_summary(segments: DataFrame, *key: str) -> DataFrame:
    """(key, language): the language if there is exactly one, else null."""
    named = F.when(F.col("language") != "", F.col("language"))
    return segments.groupBy(*key).agg(F.when(F.min(named) == F.max(named), F.max(named)).alias("language"))


def order_segments(segments: DataFrame, key="rec", order="seq") -> DataFrame:
    """Recording order, in total."""
    return segments.orderBy(key, order)


def cue_index(segments: DataFrame, key="rec", order: str | list[str] = "seq", first=1) -> DataFrame:
    """Numbers from `first` within each recording: 1 for captions, 0 for JSON."""
    return segments.withColumn("cue", (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1 + first).cast("long"))


def srt_cues(segments: DataFrame, key="rec", order="seq") -> DataFrame:
    """(rec, cue, start, end, text) of SubRip captions; each segment is a cue, blank ones too."""
    out = cue_index(segments, key, order)
    return out.select(key, "cue", t.srt_time("start_s").alias("start"), t.srt_time("end_s").alias("end"), t.normalize_text("text").alias("text"))


def vtt_times(segments: DataFrame, key="rec", order: str | list[str] = "seq") -> DataFrame:
    """`segments` with start_ms and end_ms of WebVTT captions: starts never go back, nor before 0, ends are at least 1 ms later.

    A cue with a time that is not finite has null times, and moves no other.
    """
    w = W.partitionBy(key).orderBy(order)
    good = t.finite("start_s") & t.finite("end_s")
    latest = F.max(F.when(good, t.milliseconds("start_s"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = segments.withColumn("start_ms", F.when(good, F.greatest(latest, F.lit(0))))
    return out.withColumn("end_ms", F.when(good, F.greatest(t.milliseconds("end_s"), F.col("start_ms") + 1)))


def vtt_cues(segments: DataFrame, key="rec", order="seq") -> DataFrame:
    """(rec, cue, start_ms, end_ms, start, end, text) of WebVTT captions, with the times of vtt_times."""
    out = cue_index(vtt_times(segments, key, order), key, order)
    return out.select(key, "cue", "start_ms", "end_ms", t.vtt_time("start_ms").alias("start"), t.vtt_time("end_ms").alias("end"), t.cue_escape("text").alias("text"))


def refused_cue(caption: str, start: Column | str = "start_s", end: Column | str = "end_s") -> Column:
    """Why a segment cannot be a caption: a time that is null or not finite, or, in `srt`, negative; null if it can."""
    times = [F.col(x) if isinstance(x, str) else x for x in (start, end)]
    reason = F.when(~(F.coalesce(t.finite(times[0]), F.lit(False)) & F.coalesce(t.finite(times[1]), F.lit(False))), "not finite")
    return reason.when((times[0] < 0) | (times[1] < 0), "negative") if caption == "srt" else reason


def last_qualifying(df: DataFrame, keys: list[str], value: Column, condition: Column, order: Column, name="value") -> DataFrame:
    """(keys, value) of each group's last row that meets the condition, without a sort; null if none does."""
    return df.groupBy(*keys).agg(F.max_by(value, F.when(condition, order)).alias(name))


def nest_segments(segments: DataFrame, key="rec", order="seq") -> DataFrame:
    """(rec, segments): the segments of a recording as an ordered array of structs."""
    fields = [c for c in segments.columns if c not in (key, order)]
    return segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("segments"))


def explode_chunks(chunks: DataFrame, key="rec", index="idx") -> DataFrame:
    """Chunks with a language and an array `segments` to one row per segment, numbered over the whole recording as `seq`."""
    rows = chunks.select(key, index, "language", F.posexplode("segments").alias("pos", "segment"))
    seq = (F.row_number().over(W.partitionBy(key).orderBy(index, "pos")) - 1).cast("long")
    return rows.withColumn("seq", seq).select(key, "seq", index, "language", "segment.*")
