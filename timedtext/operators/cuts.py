"""Where a recording is cut: pauses, safe boundaries, and what is committed at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timedtext.functions.text import RATE, seconds_to_samples
from timedtext.operators.segments import invalid_reason, last_qualifying


def with_tail_interval(speech: DataFrame, windows: DataFrame, key=("rec", "win")) -> DataFrame:
    """Speech intervals and, for each window, an empty one at its end, which closes the last silence."""
    tail = windows.select(*key, F.col("n_samples").alias("start_sample"), F.col("n_samples").alias("end_sample"))
    return speech.select(*key, "start_sample", "end_sample").unionByName(tail)


def pause_cut(speech: DataFrame, windows: DataFrame, min_silence_ms: int, key=("rec", "win"), strict=False) -> DataFrame:
    """(key, cut): the middle of the last silence that is long enough and has its middle in the window's last quarter, else the window's end.

    speech: intervals that don't overlap; windows: n_samples by key. A window with
    intervals that overlap, are reversed or null, or are not within it has no cut, or is
    an error if `strict`.
    """
    rows = with_tail_interval(speech, windows, key).join(windows.select(*key, "n_samples"), list(key))
    w = W.partitionBy(*key).orderBy("start_sample", "end_sample")
    before = F.coalesce(F.lag("end_sample").over(w), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("middle", (F.col("before") + F.floor((F.col("start_sample") - F.col("before")) / 2)).cast("long"))
    long = (F.col("start_sample") > F.col("before")) & (F.col("start_sample") - F.col("before") >= min_silence_ms * (RATE // 1000))
    late = (F.col("middle") >= F.floor(F.col("n_samples") * 3 / 4)) & (F.col("middle") < F.col("n_samples"))
    wrong = F.coalesce((F.col("start_sample") < F.col("before")) | (F.col("end_sample") < F.col("start_sample")) | (F.col("end_sample") > F.col("n_samples")), F.lit(True))
    cut = rows.groupBy(*key).agg(F.max_by("middle", F.when(long & late, F.col("middle"))).alias("cut"), F.max("n_samples").alias("n_samples"), F.bool_or(wrong).alias("wrong"))
    bad = F.raise_error(F.lit("invalid speech intervals")).cast("long") if strict else F.lit(None).cast("long")
    return cut.select(*key, F.when(F.col("wrong"), bad).otherwise(F.coalesce("cut", "n_samples")).alias("cut"))


def safe_cut(segments: DataFrame, windows: DataFrame, key=("rec", "win"), order="seq", strict=False) -> DataFrame:
    """(key, cut): the last segment end that is at or before min(preferred, n_samples - guard) and that no later segment starts before, else the whole window.

    segments: start_s and end_s in window time; windows: n_samples, preferred and guard by key.
    A window with a segment whose times are not finite or not within it, or whose
    preferred place is not above 0 and within it, has no cut, so nothing is committed of
    it, or is an error if `strict`.
    """
    w = W.partitionBy(*key).orderBy(order)
    rows = segments.select(*key, order, "start_s", "end_s")
    rows = rows.withColumn("upto", F.max("end_s").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.min("start_s").over(w.rowsBetween(1, W.unboundedFollowing)))
    rows = rows.join(windows.select(*key, "n_samples", "preferred", "guard"), list(key), "right")
    at = seconds_to_samples("upto")
    target = F.least(F.col("preferred"), F.greatest(F.col("n_samples") - F.col("guard"), F.lit(0)))
    safe = (at > 0) & (at <= target) & (F.least(F.coalesce("next", F.col("n_samples") / float(RATE)), F.col("n_samples") / float(RATE)) >= at / float(RATE))
    wrong = F.col(order).isNotNull() & invalid_reason(high=F.col("n_samples") / float(RATE)).isNotNull()
    nowhere = F.coalesce((F.col("preferred") <= 0) | (F.col("preferred") > F.col("n_samples")), F.lit(True))
    rows = rows.withColumn("wrong", F.max(wrong | nowhere).over(W.partitionBy(*key)))
    cut = last_qualifying(rows, [*key, "n_samples", "wrong"], at, safe, F.col(order), "cut")
    bad = F.raise_error(F.lit("a segment or the preferred place is not within its window")).cast("long") if strict else F.lit(None).cast("long")
    return cut.select(*key, F.when(F.col("wrong"), bad).otherwise(F.coalesce("cut", "n_samples")).alias("cut"))


def commit_segments(segments: DataFrame, cuts: DataFrame, key=("rec", "win")) -> DataFrame:
    """The segments that end at or before their window's cut."""
    return segments.join(cuts, list(key)).filter(F.col("end_s") <= F.col("cut") / float(RATE))


def clip_intervals(speech: DataFrame, windows: DataFrame, key="rec", cell=600 * RATE) -> DataFrame:
    """(rec, win, start_sample, end_sample): speech within each window it meets, in window time. windows: rec, win, from_sample, n_samples.

    Both are sent to the cells of time that they meet and joined by cell, so that a
    long recording is many small joins; a pair counts in the first cell it shares.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(F.greatest(high - 1, low) / cell)))
    w = windows.select(key, "win", "from_sample", "n_samples", cells(F.col("from_sample"), F.col("from_sample") + F.col("n_samples")).alias("cell"))
    s = speech.select(key, F.col("start_sample").alias("s"), F.col("end_sample").alias("e"), cells(F.col("start_sample"), F.col("end_sample")).alias("cell"))
    both = s.join(w, [key, "cell"]).filter((F.col("s") < F.col("from_sample") + F.col("n_samples")) & (F.col("e") > F.col("from_sample")))
    both = both.filter(F.col("cell") == F.floor(F.greatest("s", "from_sample") / cell))
    start = F.least(F.greatest(F.col("s") - F.col("from_sample"), F.lit(0)), F.col("n_samples"))
    end = F.least(F.greatest(F.col("e") - F.col("from_sample"), F.lit(0)), F.col("n_samples"))
    return both.select(key, "win", start.cast("long").alias("start_sample"), F.greatest(start, end).cast("long").alias("end_sample"))


def grid_speech(speech: DataFrame, seconds: int, key="rec") -> DataFrame:
    """Like clip_intervals, on a grid of windows of equal length: each interval is sent to the windows it meets, without a join."""
    size = seconds * RATE
    last = F.floor((F.greatest(F.col("end_sample") - 1, F.col("start_sample"))) / size)
    rows = speech.withColumn("win", F.explode(F.sequence(F.floor(F.col("start_sample") / size), last)))
    start = F.greatest(F.col("start_sample") - F.col("win") * size, F.lit(0))
    end = F.least(F.col("end_sample") - F.col("win") * size, F.lit(size))
    return rows.select(key, "win", start.cast("long").alias("start_sample"), end.cast("long").alias("end_sample"))
