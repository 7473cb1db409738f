"""Phrases whose words come together more often than their parts come apart, for each language.

Counting: tasks turn texts into numbers of words and send each distinct run of up
to two words once, with its count; what is seen in fewer than `least` places cannot
be part of a phrase that is not. A filter of the pairs that are left, of a fixed
size, spares most runs of three words; those it lets pass are counted exactly.

Scoring: the counts that are left are laid out as two streams, in prefix order
(first word, second, third) and in suffix order (last word, the one before, ...).
In prefix order a word comes just before the pairs that it begins, and a pair before
its extensions, so that one pass over the stream has the count of the left part of
each run beside it, and of each pair its most frequent extension to the right; the
suffix stream gives the right parts and the extensions to the left. Both streams
meet by run. A stream is cut into ranges of equal size wherever that is, also within
the runs of one word: rows before a range's first word or pair get its count from
the one that an earlier range ended with, of which there is one a range at most.

Defined cases: a null text has no words, a null language counts as `und`. Repeated
rows count as often as they are there. A text of any length is worked on in pieces;
a word of any length is one word. Ties in score go to the more frequent, then to
the phrase that is smaller in UTF-8 bytes. An empty table gives no phrases. Other
columns are not read. Counts are exact below 10^15 words a language.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timedtext.llm import shared, words

#: A phrase counts from LEAST places on; one that is in a longer one in at least SHARE of 100 of its places is dropped; TOP phrases a language.
LEAST, SHARE, TOP = 10, 50, 2000
#: Words that a task counts together, and the 64-bit blocks of the filter of pairs: 8 MB, whatever the table's size.
TOGETHER, BLOCKS = 1 << 21, 1 << 20
#: Parts in which a language's best phrases are picked before they meet.
PARTS = 64
_MARKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in _MARKS else 32 if b == 9 else b for b in range(256))
_TOKEN = re.compile(rb"[^ \n]+|\n")
_ENDS = np.array([bytes([b]) in b" \t" + _MARKS for b in range(256)])


class Runs:
    """The words of one language's texts as numbers in the order of their first use; 0 stands between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {b"\n": 0}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.size, self.lead = 1, 1

    def add(self, text: bytes, ends: bool) -> None:
        """More text; `ends` tells that the next one is another document's."""
        n = self.numbers
        found = [n.setdefault(t, len(n)) for t in _TOKEN.findall(text.translate(_FOLD))]
        if ends:
            found.append(0)
        self.parts.append(np.array(found, np.int64))
        self.size += len(found)

    def vocabulary(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.binary())

    def all(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def rest(self) -> Runs:
        """An empty one that goes on behind this one's last two words."""
        out, names = Runs(), list(self.numbers)
        last = self.all()[-2:]
        out.parts = [np.array([out.numbers.setdefault(names[i], len(out.numbers)) for i in last], np.int64)]
        out.size = out.lead = len(last)
        return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Runs]]:
    """Batches of (text, lang) as words by language, TOGETHER at a time."""
    held: dict[str, Runs] = {}
    size = 0
    for b in batches:
        langs, texts = b.column(1).to_pylist(), b.column(0).cast(pa.binary())
        for lang, text in zip(langs, texts, strict=True):
            lang = "und" if lang is None else lang
            cut = list(words.pieces(text.as_py() or b"", between=_ENDS))
            for k, piece in enumerate(cut):
                runs = held.setdefault(lang, Runs())
                size -= runs.size
                runs.add(piece, k == len(cut) - 1)
                size += runs.size
                if size >= TOGETHER:
                    most = max(held, key=lambda x: held[x].size)
                    yield most, held[most]
                    size -= held[most].size
                    held[most] = held[most].rest()
                    size += held[most].size
    yield from held.items()


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def _rows(lang: str, names: pa.Array, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), 50_000):
        part = slice(at, at + 50_000)
        w = [names.take(pa.array(c[part])).cast(pa.string()) if c is not None else pa.nulls(len(n[part]), pa.string()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[part])), *w, pa.array(n[part].astype(np.int64))], names=["lang", *(f"w{i + 1}" for i in range(len(columns))), "f"])


def _singles_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, w1, w2, f): words with w2 null, pairs, and of each language the number of words, with both null."""
    for lang, runs in _gathered(batches):
        names, ids = runs.vocabulary(), runs.all()
        own = ids[runs.lead :]
        n = np.bincount(own, minlength=len(names))
        n[0] = 0
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([int(n.sum())])], names=["lang", "w1", "w2", "f"])
        used = np.flatnonzero(n)
        yield from _rows(lang, names, [used, None], n[used])
        a, b = ids[runs.lead - 1 : -1], own
        codes, n = _counts((a * len(names) + b)[(a > 0) & (b > 0)])
        yield from _rows(lang, names, [codes // len(names), codes % len(names)], n)


def _name(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, len(lang)) ^ xxhash.xxh3_64_intdigest(lang.encode())


def _places(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of the filter that a pair of names falls into, and its four bits there."""
    h = words.mix(first * np.uint64(0x9E3779B97F4A7C15) + words.mix(second))
    bits = np.zeros(len(h), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(24 + 6 * k)) & np.uint64(63))
    return (h % np.uint64(BLOCKS)).astype(np.int64), bits


def _pair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(BLOCKS, np.uint64)
    for b in batches:
        langs, w1, w2 = (b.column(i).to_pylist() for i in range(3))
        first, second = (np.fromiter((_name(x, y.encode("utf-8", "surrogatepass")) for x, y in zip(langs, w, strict=True)), np.uint64, len(langs)) for w in (w1, w2))
        block, bits = _places(first, second)
        np.bitwise_or.at(out, block, bits)
    used = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used].view(np.int64))], names=["block", "bits"])


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """Bits that all pairs (lang, w1, w2) have set; BLOCKS numbers, however many pairs there are."""
    rows = pairs.select("lang", "w1", "w2").mapInArrow(_pair_blocks, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    table = rows.toArrow()  # at most BLOCKS rows
    out = np.zeros(BLOCKS, np.uint64)
    out[np.asarray(table["block"], np.int64)] = np.asarray(table["bits"], np.int64).view(np.uint64)
    return out


def _triples(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, w1, w2, w3, f) of the runs of three words whose pairs the filter knows."""
    for lang, runs in _gathered(batches):
        names, ids = runs.vocabulary(), runs.all()
        hashed = np.fromiter((_name(lang, w) for w in runs.numbers), np.uint64, len(names))
        a, b = ids[:-1], ids[1:]
        pairs, back = np.unique(np.where((a > 0) & (b > 0), a * len(names) + b, 0), return_inverse=True)
        block, bits = _places(hashed[pairs // len(names)], hashed[pairs % len(names)])
        pair = ((known[block] & bits) == bits)[back] & (a > 0) & (b > 0)
        both = pair[:-1] & pair[1:]
        both[: max(0, runs.lead - 2)] = False
        at = np.flatnonzero(both)
        codes, n = _counts(back[at] * np.int64(len(names)) + ids[at + 2])
        first = pairs[codes // len(names)]
        yield from _rows(lang, names, [first // len(names), first % len(names), codes % len(names)], n)


def frequent_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3, f), written: runs of one, two and three words in at least `least` places; and each language's number of words, with all words null."""
    texts, by = docs.select("text", "lang"), ["lang", "w1", "w2"]
    short = texts.mapInArrow(_singles_and_pairs, "lang string, w1 string, w2 string, f long").groupBy(by).agg(F.sum("f").alias("f"))
    short = shared.written(short.filter((F.col("f") >= least) | F.col("w1").isNull()), "runs")
    known = docs.sparkSession.sparkContext.broadcast(pair_filter(short.filter("w2 is not null")))
    long = texts.mapInArrow(lambda batches: _triples(batches, known.value), "lang string, w1 string, w2 string, w3 string, f long")
    long = long.groupBy([*by, "w3"]).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return shared.written(short.withColumn("w3", F.lit(None).cast("string")).select(*by, "w3", "f").unionByName(long), "runs")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, k1, k2, k3, f) of a range, sorted, with the counts of k1 and of (k1, k2), and the highest of a pair's extensions.

    A range may begin behind its word or pair: such rows have no count of it. A pair
    whose extensions go on in the next range, or began in the last, has rows of both.
    """
    carried = [None, None]  # counts of the last word and the last pair
    pair, most = None, 0  # the pair at work, and its highest extension so far

    for b in batches:
        f = np.asarray(b.column("f"), np.int64)
        has = [b.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("k2", "k3")]
        heads = [~has[0], has[0] & ~has[1]]
        cover = []
        for i, head in enumerate(heads):
            last = np.maximum.accumulate(np.where(head, np.arange(len(f)), -1))
            known = (last >= 0) | (carried[i] is not None)
            value = np.where(last >= 0, f[np.maximum(last, 0)], carried[i] or 0)
            cover.append(pa.array(value, mask=~known))
            if len(f) and known[-1]:
                carried[i] = int(value[-1])
        c1, c2 = (pc.if_else(pa.array(h), c, pa.scalar(None, pa.int64())) for h, c in zip(has, cover, strict=True))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("lang", "k1", "k2", "k3")), b.column("f"), c1, c2, pa.nulls(len(f), pa.int64())], names=["lang", "k1", "k2", "k3", "f", "c1", "c2", "most"])
        # extensions: runs of three words lie together by pair
        at = np.flatnonzero(has[1])
        if len(at):
            idx = pa.array(at)
            lang, first, second = (b.column(c).take(idx) for c in ("lang", "k1", "k2"))
            new = np.ones(len(at), bool)
            if len(at) > 1:
                same = pc.and_(pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(first[1:], first[:-1])), pc.equal(second[1:], second[:-1]))
                new[1:] = ~same.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(new)
            highest = np.maximum.reduceat(f[at], begins)
            keys = list(zip(*(x.take(pa.array(begins)).to_pylist() for x in (lang, first, second)), strict=True))
            done = []
            for key, h in zip(keys, highest.tolist(), strict=True):
                if key != pair:
                    if pair:
                        done.append((pair, most))
                    pair, most = key, 0
                most = max(most, h)
            if done:
                yield _extensions(done)
    if pair:
        yield _extensions([(pair, most)])


def _extensions(found: list[tuple[tuple, int]]) -> pa.RecordBatch:
    lang, k1, k2 = (pa.array([k[i] for k, _ in found], pa.string()) for i in range(3))
    none = pa.nulls(len(found), pa.int64())
    return pa.RecordBatch.from_arrays([lang, k1, k2, pa.nulls(len(found), pa.string()), none, none, none, pa.array([m for _, m in found], pa.int64())], names=["lang", "k1", "k2", "k3", "f", "c1", "c2", "most"])


def covered(runs: DataFrame) -> DataFrame:
    """`runs` (lang, k1, k2, k3, f) with c1 and c2, the counts of (k1) and (k1, k2) where these are shorter, and rows with `most` of pairs, the highest f of their extensions.

    What a range could not know, as its word or pair is in an earlier one, is looked
    up: that is one word and one pair a range.
    """
    order = ["lang", "k1", "k2", "k3"]
    schema = "lang string, k1 string, k2 string, k3 string, f long, c1 long, c2 long, most long"
    done = shared.written(runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, schema), "stream")
    for name, keys, what in (("c1", order[:2], "k2 is null"), ("c2", order[:3], "k2 is not null and k3 is null")):
        open_rows = done.filter(f"f is not null and {name} is null and {'k2' if name == 'c1' else 'k3'} is not null").select(keys).distinct()  # a row a range at most
        known = runs.filter(what).join(F.broadcast(open_rows), keys).select(*keys, F.col("f").alias("cut"))
        done = done.join(F.broadcast(known), keys, "left").withColumn(name, F.when(F.col("f").isNotNull() & F.col("k2" if name == "c1" else "k3").isNotNull(), F.coalesce(name, "cut"))).drop("cut")
    return done


def phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases of two and three words of docs (text, lang).

    A phrase of `a` places is cut after one or two words; l and r are the counts of both
    parts, and 1000000 a a / (l r) the cut's score, rounded down. The lowest counts, of
    equal ones the first.
    """
    runs = frequent_runs(docs, least)
    grams = runs.filter("w1 is not null")
    left = covered(grams.select("lang", F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.col("w3").alias("k3"), "f"))
    right = covered(grams.select("lang", F.coalesce("w3", "w2", "w1").alias("k1"), F.expr("CASE WHEN w3 IS NOT NULL THEN w2 WHEN w2 IS NOT NULL THEN w1 END").alias("k2"), F.expr("CASE WHEN w3 IS NOT NULL THEN w1 END").alias("k3"), "f"))
    none = F.lit(None).cast("long")
    left = left.select("lang", F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("k3").alias("w3"), "f", F.col("c1").alias("l1"), F.col("c2").alias("l2"), none.alias("r1"), none.alias("r2"), "most")
    # the last word comes first here: the right part of the first cut is the longest
    r1, r2 = "CASE WHEN k3 IS NULL THEN c1 ELSE c2 END", "CASE WHEN k3 IS NOT NULL THEN c1 END"
    right = right.select("lang", F.coalesce("k3", "k2", "k1").alias("w1"), F.expr("CASE WHEN k3 IS NOT NULL THEN k2 WHEN k2 IS NOT NULL THEN k1 END").alias("w2"), F.expr("CASE WHEN k3 IS NOT NULL THEN k1 END").alias("w3"), none.alias("f"), none.alias("l1"), none.alias("l2"), F.expr(r1).alias("r1"), F.expr(r2).alias("r2"), "most")
    both = left.unionByName(right).filter("w2 is not null").groupBy("lang", "w1", "w2", "w3").agg(*[F.max(c).alias(c) for c in ("f", "l1", "l2", "r1", "r2", "most")])
    big = "CAST({} AS DECIMAL(16, 0))".format
    score = lambda l, r: F.expr(f"(1000000 * ({big('f')} * {big('f')})) DIV ({big(l)} * {big(r)})")  # noqa: E731, E741
    cuts = [F.when(F.col(l).isNotNull() & F.col(r).isNotNull(), F.struct(score(l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))) for k, l, r in ((1, "l1", "r1"), (2, "l2", "r2"))]  # noqa: E741
    kept = both.filter(F.coalesce(100 * F.col("most") < share * F.col("f"), F.lit(True))).withColumn("cut", F.least(*cuts))
    found = kept.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    return best(found, runs.filter("w1 is null").select("lang", F.col("f").alias("n")), top)


def best(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Each language's first `top` phrases; they are picked within parts of a language first, so that no task has all of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(shared.documents(spark, sf_dir))


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, range(1, 4) t(size)),
counts AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS f FROM runs GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(c.w[1:k], ' ') AS first, array_to_string(c.w[k + 1:], ' ') AS second
  FROM counts c, range(1, 3) t(k) WHERE k < c.size),
scored AS (
  SELECT x.*, l.f AS l, r.f AS r, 1000000 * a * a // (l.f * r.f) AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = first JOIN counts r ON r.lang = x.lang AND r.phrase = second),
longer AS (
  SELECT lang, phrase, max(f) AS f
  FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM counts WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase WHERE coalesce(100 * o.f < 50 * s.a, true)
  QUALIFY row_number() OVER (PARTITION BY s.lang, s.phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
