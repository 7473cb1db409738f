"""Paragraphs of a transcript."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from timedtext.functions import text as t
from timedtext.operators.scan import BITS, block_scan

#: Fixed value: code points after which a sentence's end ends the paragraph.
LONG = 600


def paragraph_breaks(segments: DataFrame, pause_ms: int, key="rec", order="seq") -> DataFrame:
    """Segments that are not blank, with `line` (normalized text), `hard` (a break before it, by pause or language) and `section`."""
    w = W.partitionBy(key).orderBy(order)
    rows = segments.withColumn("line", t.normalize_text("text")).filter("line <> ''")
    pause = (F.col("start_s") - F.lag("end_s").over(w)) * 1000 >= pause_ms
    hard = F.coalesce(pause | (F.col("language") != F.lag("language").over(w)), F.lit(False))
    return rows.withColumn("hard", hard).withColumn("section", F.sum(F.col("hard").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def is_hard(before: tuple, start: float | None, language: str | None, pause_ms: int) -> bool:
    """Whether the line before, of (end, language), and one that starts then are parted by a pause or by their languages; what is null parts nothing, and a time that is no number does, as in SQL."""
    end, other = before
    pause = end is not None and start is not None and not (start - end) * 1000 < pause_ms
    return pause or (other is not None and language is not None and other != language)


def count_step(state: tuple, row: tuple, pause_ms: int) -> tuple[tuple, list[tuple]]:
    """One line of (key, order, start, end, language, length, sentence end) after the state (code points of the paragraph, last sentence end, end and language of the last line, breaks)."""
    key, seq, start, end, language, n, ends = row
    count, ended, *before, breaks = state
    broken = is_hard(before, start, language, pause_ms) or (count >= LONG and ended)
    breaks += broken
    return (min(LONG, n if broken else count + n), ends, end, language, breaks), [(key, seq, broken, breaks)]


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<i8").tobytes(), 1)


def _unpacked(packed: bytes, at: int) -> int:
    return int(np.frombuffer(zlib.decompress(packed), "<i8")[at])


def count_sums(rows: list[tuple], pause_ms: int) -> tuple:
    """A block of lines as a function of the state before it.

    What comes in is a count from 0 to LONG, with a sentence end or without one, or a
    hard break before the first line: each has a place in the tables of the counts that
    come out and of the breaks within. These repeat a few numbers, so they are kept
    packed: as lists they are 19 KB a block, and a batch of blocks is in memory. Further: start and language of the first line,
    and sentence end, end and language of the last one.
    """
    count = np.concatenate([np.arange(LONG + 1), np.arange(LONG + 1), [0]])
    broken = np.arange(len(count)) == 2 * LONG + 1
    broken[-1] = True
    ended, breaks, before = False, np.zeros(len(count), np.int64), (None, None)
    for i, (_, _, start, end, language, n, ends) in enumerate(rows):
        if i:
            broken = np.full(len(count), is_hard(before, start, language, pause_ms)) | (ended & (count >= LONG))
        breaks += broken
        count = np.minimum(LONG, np.where(broken, n, count + n))
        ended, before = bool(ends), (end, language)
    return (_packed(count), _packed(breaks), rows[0][2], rows[0][4], ended, *before)


def count_after(state: tuple, sums: tuple, pause_ms: int) -> tuple:
    """The state behind a block of count_sums."""
    counts, within, start, language, *last = sums
    count, ended, *before, breaks = state
    at = 2 * LONG + 2 if is_hard(before, start, language, pause_ms) else count + bool(ended) * (LONG + 1)
    return (_unpacked(counts, at), *last, breaks + _unpacked(within, at))


def _state(number: T.DataType) -> list[T.StructField]:
    return [T.StructField("ended", T.BooleanType()), T.StructField("end", number), T.StructField("language", T.StringType())]


def paragraphs(segments: DataFrame, pause_ms: int, layout="paragraphs", key="rec", order="seq", bits=BITS) -> DataFrame:
    """Segments that are not blank, with `line`, `breaks` and `paragraph`, numbered from 0.

    A break is a hard one, or one after LONG code points at a sentence's end. Only
    times, lengths and flags go through Python, in parallel blocks of 2 ** bits
    segments where a recording has several.
    """
    rows = segments.withColumn("line", t.normalize_text("text")).filter("line <> ''")
    if layout != "paragraphs":
        return rows.withColumn("breaks", F.lit(False)).withColumn("paragraph", F.lit(0).cast("long"))
    lines = rows.withColumn("n", t.code_points("line")).withColumn("ends", t.sentence_end("line"))
    return rows.join(paragraph_numbers(lines, pause_ms, layout, key, order, bits), [key, order])


def paragraph_numbers(lines: DataFrame, pause_ms: int, layout="paragraphs", key="rec", order="seq", bits=BITS) -> DataFrame:
    """(rec, seq, breaks, paragraph) of lines that are not blank, without their text: `n`, its code points, and `ends`, whether it ends a sentence."""
    if layout != "paragraphs":
        return lines.select(key, order, F.lit(False).alias("breaks"), F.lit(0).cast("long").alias("paragraph"))
    small = lines.select(key, order, F.col("start_s").cast("double"), F.col("end_s").cast("double"), "language", "n", "ends")
    flag, long, double, text = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()
    schema = T.StructType([lines.schema[key], lines.schema[order], T.StructField("breaks", flag), T.StructField("paragraph", long)])
    last = _state(double)
    state = T.StructType([T.StructField("count", long), *last, T.StructField("breaks", long)])
    sums = T.StructType([T.StructField("counts", T.BinaryType()), T.StructField("within", T.BinaryType()), T.StructField("start", double), T.StructField("first", text), *last])
    return block_scan(
        small, key, order, lambda: (0, False, None, None, 0), lambda s, row: count_step(s, row, pause_ms), schema,
        state, lambda block: count_sums(block, pause_ms), sums, lambda s, block: count_after(s, block, pause_ms), bits=bits,
    )


def paragraph_texts(segments: DataFrame, pause_ms: int, layout="paragraphs", key="rec", order="seq") -> DataFrame:
    """(rec, paragraph, text): the lines of a paragraph joined by a space."""
    rows = paragraphs(segments, pause_ms, layout, key, order)
    return rows.groupBy(key, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), " ").alias("text"))


def transcript_text(segments: DataFrame, pause_ms: int, layout="paragraphs", key="rec", order="seq") -> DataFrame:
    """(rec, text): paragraphs with an empty line between them."""
    rows = paragraph_texts(segments, pause_ms, layout, key, order)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
