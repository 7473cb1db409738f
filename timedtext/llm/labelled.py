"""The bounded sample of labelled documents from which a model is fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.llm import shared

#: At most so many labelled documents are used to fit a model, those of least hash, and of these the ones of at most so many bytes.
SAMPLE, BYTES, PARTS = 12_000, 1 << 17, 16


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, size=SAMPLE, parts=PARTS) -> DataFrame:
    """(part, text, y, pick): up to `size` documents that are not held out, written; pick is a number from 0 to 9 that depends on the id.

    A document with several labels has their rounded mean, and of several texts of an
    id the least counts; null labels and ids don't. `part` deals the sample into
    `parts` shares of at most about size / parts texts of BYTES bytes.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    y = y.orderBy(order, "doc_id").limit(size)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= BYTES).join(F.broadcast(shared.written(y, "labels")), "doc_id")  # at most `size` rows
    joined = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    joined = joined.select(F.pmod(order, F.lit(parts)).cast("int").alias("part"), "text", "y", F.pmod(F.floor(order / 1000), F.lit(10)).cast("int").alias("pick"))
    return shared.written(joined, "sample")
