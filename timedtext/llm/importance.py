"""Importance resampling: documents drawn by how much likelier their words are in a target text.

Words and runs of up to three of them are counted by hashed buckets, in the
corpus and in the target; the logarithm of the two smoothed shares is a bucket's
gain, and a document's weight is the sum over its features. Gumbel noise, fixed by
the document's id, is added, and the highest scores are drawn. CRC-32 is linear, so
the buckets of runs come from the checksums of their words by table look-ups on
arrays, without building the runs.

The draw is a quickselect over Spark tables: a round picks random rows as pivots,
one aggregate counts exactly how many rows lie before each and whether it is passed,
and only rows between two neighbouring pivots go on. No row is sorted until the
last of the winners is known; the winners alone are range-sorted and numbered.

Defined cases: a null or empty text has no words, weight 0 and a score like others;
it cannot be drawn where `min_words` is above 0. A null id counts as the empty text
for the noise and comes last among equal scores. Repeated rows are drawn each by
itself: rows that agree in score and id are told apart by their place in the written
table of scores. Texts of any length are worked on in pieces. An empty table gives
an empty one, an empty target the gains of no counts. Other columns are not carried.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import shared, words

BUCKETS, LONGEST, MIN_WORDS, SEED, PERCENT = 10_000, 3, 20, 42, 5
#: Pivots of a round of the selection.
PIVOTS = 16
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: True for bytes that stand between words, in texts that are not yet lower-cased.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Lengths of words for which the tables of CRC-32 are kept; longer words take the plain way.
_TABLED = 64


def _step(crc: np.ndarray) -> np.ndarray:
    """The register of CRC-32 after a zero byte."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


@functools.lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[length, byte, value]: what a byte of a checksum becomes behind `length` more bytes; the four bytes' parts are added by xor."""
    out = np.empty((_TABLED, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _TABLED):
        out[n] = _step(out[n - 1])
    return out


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together, from those of both parts and the length of the right ones."""
    t, n = _shifts(), np.minimum(length, _TABLED - 1)
    out = left
    while True:
        out = t[n, 0, out & 255] ^ t[n, 1, (out >> 8) & 255] ^ t[n, 2, (out >> 16) & 255] ^ t[n, 3, out >> 24]
        length = length - n
        if not length.any():
            return out ^ right
        n = np.minimum(length, _TABLED - 1)


def _word_crcs(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the words of `raw`: all words' first bytes, then all second bytes, and so on; long words one by one."""
    table = _step(np.arange(256, dtype=np.uint32))
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(length < _TABLED)
    for n in range(_TABLED - 1):
        live = live[length[live] > n]
        if not len(live):
            break
        c = crc[live]
        crc[live] = table[(c ^ raw[starts[live] + n]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length >= _TABLED):
        crc[i] = zlib.crc32(raw[starts[i] : starts[i] + length[i]].tobytes())
    return crc


def features(texts: list[str | None], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of the texts: each word's text, and (text, bucket) of each feature that ends in this part.

    Parts are bounded in bytes; the last words of a text's part lead into its next.
    """
    space, none = np.uint32(zlib.crc32(b" ")), np.zeros(0, np.int64)
    doc, crc, length = none, none.astype(np.uint32), none
    for owners, held in words.batches(texts, size, _BETWEEN):
        lead = np.flatnonzero(doc[-LONGEST + 1 :] == owners[0]) + max(0, len(doc) - LONGEST + 1)
        raw = _LOWER[np.frombuffer(b"\n" + b"\n".join(held) + b"\n", np.uint8)]
        between = _BETWEEN[raw]
        edges = np.flatnonzero(between[1:] != between[:-1]) + 1
        starts, width = edges[::2], edges[1::2] - edges[::2]
        owner = np.array(owners, np.int64)[np.searchsorted(np.cumsum([len(x) + 1 for x in held]), starts, "right")]
        doc, crc, length = (np.concatenate([a[lead], b]) for a, b in ((doc, owner), (crc, _word_crcs(raw, starts, width)), (length, width)))
        n_lead = len(lead)
        behind_blank = joined_crc(np.full_like(crc, space), crc, length)
        run, owns, bucket = crc, [doc[n_lead:]], [crc[n_lead:] % BUCKETS]
        for n in range(1, LONGEST):
            # `run` is of the n words from each place on; a blank and the next word are put behind it
            if len(doc) <= n:
                break
            run = joined_crc(run[:-1], behind_blank[n:], length[n:] + 1)
            ok = doc[:-n] == doc[n:]
            ok[: max(0, n_lead - n)] = False
            owns.append(doc[n:][ok])
            bucket.append(run[ok] % BUCKETS)
        yield doc[n_lead:], np.concatenate(owns), np.concatenate(bucket).astype(np.int64)


def _sums(owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by owner, exact as long as they are below 2^53."""
    return np.bincount(owner, x, n).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, bucket in features(b.column(0).to_pylist()):
            n += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts each bucket has; a task sends a row a bucket at most, and so does the sum."""
    rows = texts.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over corpus share, each with one added to every bucket."""
    many, few = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = (target + 1.0) * many / ((corpus + 1.0) * few)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel-distributed number that depends on the id only."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document; `gain` has BUCKETS numbers."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            n_words, n, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for word, doc, bucket in features(b.column(1).to_pylist()):
                n_words += np.bincount(word, minlength=len(ids))
                n += np.bincount(doc, minlength=len(ids))
                weight += _sums(doc, gain[bucket], len(ids))
            score = weight + np.array([noise(x, seed) for x in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_words, n, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def _literal(key: Row) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(k) for k, v in key.asDict().items()])


def kth(keys: DataFrame, k: int) -> Row | None:
    """The k-th smallest (from 1) of the structs of longs in column `key`, or null if there are fewer.

    A round takes a row each from PIVOTS random groups, and counts the rows between
    and on these pivots. The rows that can still be it are written, some 1 / PIVOTS
    of those before.
    """
    for turn in itertools.count():
        chance = F.xxhash64("key", F.lit(turn))
        found = keys.groupBy(F.pmod(chance, F.lit(PIVOTS)).alias("group")).agg(F.min_by("key", F.struct(chance, "key")).alias("key")).collect()
        pivots = sorted({r["key"] for r in found})
        if not pivots:
            return None
        # 2 i: between the pivots i - 1 and i; 2 i + 1: on the pivot i
        place = functools.reduce(lambda a, b: a + b, [(F.col("key") >= _literal(p)).cast("int") + (F.col("key") > _literal(p)).cast("int") for p in pivots])
        n = dict(map(tuple, keys.groupBy(place.alias("place")).count().collect()))
        for i in range(2 * len(pivots) + 1):
            if k <= n.get(i, 0):
                break
            k -= n.get(i, 0)
        else:
            return None
        if i % 2:
            return pivots[i // 2]
        inside = keys
        if i:
            inside = inside.filter(F.col("key") > _literal(pivots[i // 2 - 1]))
        if i < 2 * len(pivots):
            inside = inside.filter(F.col("key") < _literal(pivots[i // 2]))
        keys = shared.written(inside, "between")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """`df` with `rank`, from 1 in the order of `key`: sorted by ranges, and each range's rows numbered on from those before it."""
    df = shared.written(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    counts = sorted(map(tuple, df.groupBy(part).count().collect()))  # a row a partition
    before = dict(zip([p for p, _ in counts], itertools.accumulate([n for _, n in counts], initial=0), strict=False))
    if not before:
        return df.drop("at").withColumn("rank", F.lit(None).cast("long"))
    first = df.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    return df.withColumn("part", part).join(F.broadcast(first), "part").withColumn("rank", F.col("before") + (F.col("at") - F.shiftleft("part", 33)) + 1).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document of docs (doc_id, text).

    Of the N documents of at least `min_words` words, the floor(percent * N / 100) of
    highest score have a rank, from 1; ties go to the smaller id. `target` has a
    column text.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = shared.written(weigh(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    key = F.struct((-F.col("score")).alias("score"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "row")
    scored = scored.withColumn("key", key)
    able = F.col("n_words") >= min_words
    last = kth(scored.filter(able).select("key"), k) if (k := percent * scored.filter(able).count() // 100) else None
    if last is None:
        return scored.drop("key", "row").withColumn("rank", F.lit(None).cast("long"))
    drawn = able & (F.col("key") <= _literal(last))
    rest = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.filter(drawn), "key").unionByName(rest).drop("key", "row")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by a table of 256 entries that is made by the bitwise rule.
SQL = """
WITH RECURSIVE register(b, turn, crc) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL
  SELECT b, turn + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM register WHERE turn < 8),
crc_table AS MATERIALIZED (SELECT list(crc ORDER BY b) AS t FROM register WHERE turn = 8),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS MATERIALIZED (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM texts),
runs AS MATERIALIZED (
  SELECT kind, id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f
  FROM words, range(1, 4) t(n)),
coded AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM runs), crc_table),
used AS MATERIALIZED (SELECT kind, id, bucket, count(*) AS n FROM runs JOIN coded USING (f) GROUP BY ALL),
sums AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM used GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM sums),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(a.t, 0) + 1)::DOUBLE * (b.s + 10000) / ((coalesce(a.s, 0) + 1)::DOUBLE * (b.t + 10000))))::BIGINT AS gain
  FROM sums a, total b),
weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM used JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT d.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words d LEFT JOIN weights USING (id) WHERE kind = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
