"""Running a recognizer over the windows of recordings.

`recognize` takes samples and returns (language, [(start_s, end_s, text,
no_speech_prob)]) in window time; `choose_cut` takes samples and returns where
it would like the window to end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from timedtext.functions import scratch
from timedtext.functions.text import RATE
from timedtext.operators.fold import fold

Segment = tuple[float, float, str, float]
Recognize = Callable[[np.ndarray], tuple[str, list[Segment]]]
RecognizeMany = Callable[[list[np.ndarray]], list[tuple[str, list[Segment]]]]
ChooseCut = Callable[[np.ndarray], int]
MAX_WINDOW = 600 * RATE

SEGMENTS = "array<struct<start_s double, end_s double, text string, no_speech_prob double>>"


def checked_times(segments: list[Segment], samples: int) -> np.ndarray:
    """Starts and ends as rows; an error where a recognizer's times are not finite, reversed or outside its window."""
    times = np.array([(s, e) for s, e, *_ in segments], np.float64).reshape(-1, 2)
    if not (np.isfinite(times).all() and (times[:, 0] >= 0).all() and (times[:, 0] <= times[:, 1]).all() and (times[:, 1] <= samples / RATE).all()):
        raise ValueError("a recognizer's segment is not within its window")
    return times


def safe_ends(times: np.ndarray, samples: int, above: int, upto: int) -> np.ndarray:
    """The sample places, above one and up to another, where a segment has ended and all that come later in the list are still to begin."""
    if not len(times):
        return np.zeros(0, np.int64)
    whole = samples / RATE
    places = np.ceil(np.maximum.accumulate(times[:, 1]) * RATE)
    begins = np.append(np.minimum.accumulate(times[:0:-1, 0])[::-1], whole)
    return places[(places > above) & (places <= upto) & (np.minimum(begins, whole) >= places / RATE)].astype(np.int64)


def boundary(samples: int, preferred: int, segments: list[Segment], guard: int) -> int:
    """Where a window is cut: the last safe end up to `preferred` and `guard` samples before the window's end, or all of the window."""
    if not 0 < preferred <= samples:
        raise ValueError("no such boundary")
    ends = safe_ends(checked_times(segments, samples), samples, 0, min(preferred, max(samples - guard, 0)))
    return int(ends[-1]) if len(ends) else samples


class Windows:
    """The windows of one recording: samples go in, committed windows come out."""

    def __init__(self, limit: int, guard: int, recognize: Recognize, choose_cut: ChooseCut, skip: int = 0, index: int = 0) -> None:
        if not 0 < limit <= MAX_WINDOW:
            raise ValueError("invalid window")
        if guard < 0 or skip < 0:
            raise ValueError("a negative guard or place")
        self.limit, self.guard, self.recognize, self.choose_cut = limit, guard, recognize, choose_cut
        self.buffer, self.position, self.index, self.skip, self.recognized = np.zeros(0, np.float32), skip, index, skip, 0

    def push(self, samples: np.ndarray) -> Iterator[dict]:
        """`skip` samples that are committed already are only counted."""
        drop = min(self.skip, len(samples))
        self.skip -= drop
        self.buffer = np.concatenate([self.buffer, samples[drop:]])
        while len(self.buffer) >= self.limit:
            yield self.commit(self.buffer[: self.limit], last=False)

    def finish(self) -> Iterator[dict]:
        """At the end of the recording; an error if that is before what is committed."""
        if self.skip:
            raise ValueError("the audio ends before the committed place")
        while len(self.buffer):
            yield self.commit(self.buffer, last=True)

    def commit(self, window: np.ndarray, last: bool) -> dict:
        silent = bool((window == 0).all())
        language, segments, count = "", [], len(window)
        if not silent:
            self.recognized += len(window)
            language, segments = self.recognize(window)
            checked_times(segments, len(window))
            if not last:
                count = boundary(len(window), self.choose_cut(window), segments, self.guard) if segments else len(window)
        whole = not last and count == len(window) and bool(segments)
        base, end = self.position / RATE, (self.position + count) / RATE
        kept = [(s + base, min(e + base, end), t.strip(" \n\r\t"), p) for s, e, t, p in segments if e <= count / RATE and t.strip(" \n\r\t")]
        row = {"idx": self.index, "start_sample": self.position, "end_sample": self.position + count, "silent": silent, "whole": whole, "recognized": 0 if silent else len(window), "language": language if kept else "", "segments": kept}
        self.position, self.index, self.buffer = self.position + count, self.index + 1, self.buffer[count:]
        return row


def committed_type(rec: T.StructField) -> T.StructType:
    segment = T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("no_speech_prob", T.DoubleType())])
    names = [("idx", T.LongType()), ("start_sample", T.LongType()), ("end_sample", T.LongType()), ("silent", T.BooleanType()), ("whole", T.BooleanType()), ("recognized", T.LongType()), ("language", T.StringType()), ("segments", T.ArrayType(segment))]
    return T.StructType([rec, *(T.StructField(n, k) for n, k in names)])


def committed_row(rec, row: dict) -> tuple:
    names = ("start_s", "end_s", "text", "no_speech_prob")
    return (rec, *(row[n] for n in ("idx", "start_sample", "end_sample", "silent", "whole", "recognized", "language")), [dict(zip(names, s, strict=True)) for s in row["segments"]])


def recognize_windows(blocks: DataFrame, recognize: Recognize, choose_cut: ChooseCut, limit: int, guard: int, manifests: DataFrame | None = None, key="rec") -> DataFrame:
    """Committed windows of each recording, one after the other: where a window is cut tells where the next begins.

    blocks: rec, start_sample, samples; limit and guard in samples. With manifests
    (rec, chunks, samples), what is committed is read but not recognized again; audio
    that ends before that place is an error (short_recordings tells them beforehand).
    `whole` marks windows that were committed whole for lack of a safe boundary.
    """
    rows = blocks.select(key, "start_sample", "samples", F.lit(0).cast("long").alias("skip"), F.lit(0).cast("long").alias("chunks"))
    if manifests is not None:
        m = manifests.select(key, F.col("samples").alias("skip"), "chunks")
        rows = blocks.join(m, key, "left").select(key, "start_sample", "samples", F.coalesce("skip", F.lit(0)).alias("skip"), F.coalesce("chunks", F.lit(0)).alias("chunks"))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        rec, _, samples, skip, chunks = row
        state = state or (rec, Windows(limit, guard, recognize, choose_cut, skip, chunks))
        return state, [committed_row(rec, x) for x in state[1].push(np.array(samples, np.float32))]

    def finish(state: tuple) -> list[tuple]:
        return [committed_row(state[0], x) for x in state[1].finish()]

    return fold(rows, key, ["start_sample"], lambda: None, step, committed_type(blocks.schema[key]), finish)


def short_recordings(blocks: DataFrame, recordings: DataFrame, key="rec") -> DataFrame:
    """(rec, reason) of the recordings that cannot be worked on: `empty` without a sample, `short` where the audio ends before what is committed. recordings: rec and, if there, samples."""
    there = blocks.groupBy(F.col(key).alias("__rec")).agg(F.max(F.col("start_sample") + F.size("samples")).alias("__end"))
    done = F.coalesce("samples", F.lit(0)) if "samples" in recordings.columns else F.lit(0)
    rows = recordings.join(there, recordings[key] == there["__rec"], "left")
    end = F.coalesce("__end", F.lit(0))
    return rows.select(key, F.when(end < done, "short").when(end <= 0, "empty").alias("reason")).filter("reason is not null")


def overlapping_windows(blocks: DataFrame, size: int, overlap: int, key="rec") -> DataFrame:
    """(rec, win, start_sample, samples): windows of `size` samples that overlap, on a fixed grid; each block is sent to the windows it meets."""
    if not 0 <= overlap < size:
        raise ValueError("invalid overlap")
    hop = size - overlap
    end = F.col("start_sample") + F.size("samples")
    first = F.greatest(F.lit(0), F.ceil((F.col("start_sample") - size + 1) / hop))
    rows = blocks.withColumn("win", F.explode(F.sequence(first.cast("long"), F.floor((end - 1) / hop).cast("long"))))
    low = F.greatest(F.col("win") * hop - F.col("start_sample"), F.lit(0))
    high = F.least(F.col("win") * hop + size - F.col("start_sample"), F.size("samples"))
    rows = rows.select(key, "win", "start_sample", F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    parts = rows.groupBy(key, "win").agg(F.array_sort(F.collect_list(F.struct("start_sample", "part"))).alias("p"))
    windows = parts.select(key, "win", (F.col("win") * hop).alias("start_sample"), F.flatten(F.transform("p", lambda x: x["part"])).alias("samples"))
    # a last window that lies within the one before has nothing of its own
    return windows.filter((F.col("win") == 0) | (F.size("samples") > overlap))


def in_batches(recognize: RecognizeMany, windows: list[np.ndarray], batch: int) -> list[tuple[str, list[Segment]]]:
    """What a recognizer of several windows makes of all that are not silent, at most `batch` at a time; silent ones have no segments."""
    loud = [i for i, x in enumerate(windows) if (x != 0).any()]
    out: list[tuple[str, list[Segment]]] = [("", [])] * len(windows)
    for at in range(0, len(loud), batch):
        part = loud[at : at + batch]
        for i, found in zip(part, recognize([windows[i] for i in part]), strict=True):
            out[i] = found
    return out


def recognize_overlapping(blocks: DataFrame, recognize: Recognize | RecognizeMany, size: int, overlap: int, key="rec", batch: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """(rec, seq, win, start_s, end_s, text, no_speech_prob, language) of all windows recognized at once and stitched.

    Each window but the last ends at its last segment end in the overlap that no later
    segment of it starts before, or else where the next window begins to be on its own;
    it keeps what ends by there, and starts where the one before ended. As the grid is
    fixed, segments near a boundary may differ from those of recognize_windows.

    With `batch`, `recognize` takes a list of at most so many windows and returns a list,
    as a model on a device wants it. `profile` is where its tasks run: by the number of
    devices then, not by that of cores.
    """
    if batch is not None and batch < 1:
        raise ValueError("an empty batch")
    windows = overlapping_windows(blocks, size, overlap, key)
    kind = dict(blocks.dtypes)[key]

    hop, names = size - overlap, ("start_s", "end_s", "text", "no_speech_prob")
    shape = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("text", pa.string()), ("no_speech_prob", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, found = b.column("samples"), []
            windows = [np.asarray(lists[i].values, np.float32) for i in range(b.num_rows)]
            many = recognize if batch else lambda xs: [recognize(x) for x in xs]
            for samples, (language, segments) in zip(windows, in_batches(many, windows, batch or 1), strict=True):
                # the samples of a window's own end are those of its last safe end in the overlap
                ends = safe_ends(checked_times(segments, len(samples)), len(samples), hop, size)
                kept = [dict(zip(names, (s, e, t.strip(" \n\r\t"), p), strict=True)) for s, e, t, p in segments if t.strip(" \n\r\t")]
                found.append((len(samples), int(ends[-1]) if len(ends) else hop, language, kept))
            kinds = (pa.int64(), pa.int64(), pa.string(), shape)
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("win"), *columns], [key, "win", "n", "cut", "language", "segments"])

    found = windows.select(key, "win", "samples").mapInArrow(run, f"`{key}` {kind}, win long, n long, cut long, language string, segments {SEGMENTS}", profile=profile)
    by = W.partitionBy(key).orderBy("win")
    inside = F.when(F.lead("win").over(by).isNull(), F.col("n")).otherwise(F.col("cut"))
    ends = found.withColumn("to", F.col("win") * hop + inside)
    ends = ends.withColumn("from", F.coalesce(F.lag("to").over(by), F.lit(0)))
    rows = ends.select(key, "win", "from", "to", "language", F.posexplode("segments").alias("pos", "s")).select(key, "win", "from", "to", "language", "pos", "s.*")
    base = F.col("win") * hop / float(RATE)
    kept = rows.withColumn("start_s", F.col("start_s") + base).withColumn("end_s", F.col("end_s") + base)
    kept = kept.filter((F.col("end_s") <= F.col("to") / float(RATE)) & (F.col("start_s") >= F.col("from") / float(RATE)))
    seq = (F.row_number().over(W.partitionBy(key).orderBy("win", "pos")) - 1).cast("long")
    return kept.select(key, seq.alias("seq"), "win", "start_s", "end_s", "text", "no_speech_prob", "language")


def _chains(blocks: DataFrame, begins: DataFrame, recognize: Recognize, choose_cut: ChooseCut, limit: int, guard: int, size: int, key: str) -> DataFrame:
    """(rec, region, start_sample, ..., segments): the windows of each region from a given place to where the next region, or a known window, begins.

    begins: rec, region, begin, and met, the starts of windows that need not be made again.
    """
    end = F.col("start_sample") + F.size("samples")
    low = F.greatest(F.lit(0), F.floor((F.col("start_sample") - limit) / size))
    spread = blocks.select(key, "start_sample", "samples", F.explode(F.sequence(low.cast("long"), F.floor((end - 1) / size).cast("long"))).alias("region"))
    rows = spread.join(begins.select(key, "region", "begin", "met"), [key, "region"]).select(key, "region", "start_sample", "samples", "begin", "met")
    fields = T.StructType([blocks.schema[key], T.StructField("region", T.LongType()), *committed_type(blocks.schema[key])[2:]])

    class Region:
        def __init__(self, row: tuple) -> None:
            self.key, begin = row[:2], row[4]
            self.at, self.stop, self.met = row[2], (row[1] + 1) * size, set(row[5].tolist() if isinstance(row[5], np.ndarray) else row[5])
            self.windows = Windows(limit, guard, recognize, choose_cut, 0, 0)
            self.windows.position, self.over = begin, False

        def kept(self, made: Iterator[dict]) -> list[tuple]:
            out = []
            # the next window is made when it is asked for, so that none beyond the region is
            while not self.over and (row := next(made, None)) is not None:
                out.append((*self.key, *committed_row(None, row)[2:]))
                self.over = self.windows.position >= self.stop or self.windows.position in self.met
            return out

        def push(self, at: int, samples: np.ndarray) -> list[tuple]:
            gone = max(0, self.windows.position + len(self.windows.buffer) - at)
            if self.over or gone >= len(samples):
                return []
            return self.kept(self.windows.push(samples[gone:]))

    def step(state: Region | None, row: tuple) -> tuple[Region, list[tuple]]:
        state = state or Region(row)
        return state, state.push(row[2], np.array(row[3], np.float32))

    def finish(state: Region) -> list[tuple]:
        return state.kept(state.windows.finish())

    return fold(rows, [key, "region"], ["start_sample"], lambda: None, step, fields, finish)


def recognize_in_regions(blocks: DataFrame, recognize: Recognize, choose_cut: ChooseCut, limit: int, guard: int, region: int | None = None, rounds: int = 8, key="rec") -> DataFrame:
    """The rows of recognize_windows, made in parallel within a recording, and `redone`, whether a window was not among those made first.

    A recording is cut into regions of `region` samples, and the windows of each are made
    as if one began where it does. Cuts lie in pauses, so that the windows of two
    neighbours mostly meet soon: where the last window of a region ends, a window of the
    next one begins, and all from there on are right. Where none does, the next region
    is gone through again from there, to the first window that is known. A round does
    that for all regions at once; what is still apart after `rounds` is done by
    recognize_windows. `recognize` and `choose_cut` have to give the same for the same
    samples.
    """
    size = region or 8 * limit
    if size < limit:
        raise ValueError("a region is shorter than a window")
    none = F.array().cast("array<long>")
    end = F.col("start_sample") + F.size("samples")
    lengths = scratch.written(blocks.groupBy(key).agg(F.max(end).alias("total")).filter("total > 0"), "lengths")
    regions = lengths.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / size).cast("long"))).alias("region"))
    begins = regions.select(key, "region", (F.col("region") * size).alias("begin"), none.alias("met"))
    chains = scratch.written(_chains(blocks, begins, recognize, choose_cut, limit, guard, size, key).withColumn("redone", F.lit(False)), "windows")
    order = W.partitionBy(key).orderBy("region")
    for turn in range(rounds + 1):
        # where each region is entered, if all before it are right
        ends = regions.join(chains.groupBy(key, "region").agg(F.max("end_sample").alias("end"), F.min("start_sample").alias("first"), F.array_sort(F.collect_list("start_sample")).alias("starts")), [key, "region"], "left")
        entry = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
        ends = ends.withColumn("begin", entry).join(lengths, key)
        apart = (F.col("begin") < F.col("total")) & (F.col("begin") < (F.col("region") + 1) * size) & ~F.coalesce(F.array_contains("starts", F.col("begin")), F.lit(False))
        state = scratch.written(ends.select(key, "region", "begin", F.coalesce("starts", none).alias("met"), apart.alias("apart")), "entries")
        # what lies before a region's entry was a guess
        chains = chains.join(state.select(key, "region", "begin"), [key, "region"]).filter(F.col("start_sample") >= F.col("begin")).drop("begin")
        left = state.filter("apart")
        if turn == rounds or not left.limit(1).count():
            break
        again = _chains(blocks, left, recognize, choose_cut, limit, guard, size, key).withColumn("redone", F.lit(True))
        again = scratch.written(again, "windows")
        # of a region that was gone through again, only what begins where that ended, or later, is still right
        met = again.groupBy(key, "region").agg(F.max("end_sample").alias("from"))
        old = chains.join(met, [key, "region"], "left").filter(F.col("from").isNull() | (F.col("start_sample") >= F.col("from"))).drop("from")
        chains = scratch.written(old.unionByName(again), "windows")
    slow = left.select(key).distinct()
    rest = recognize_windows(blocks.join(slow, key, "left_semi"), recognize, choose_cut, limit, guard, key=key).withColumn("redone", F.lit(True))
    number = (F.row_number().over(W.partitionBy(key).orderBy("start_sample")) - 1).cast("long")
    fast = chains.join(slow, key, "left_anti").withColumn("idx", number)
    return fast.select(rest.columns).unionByName(rest)
