"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of keys are made from minhashes; a table's key is a pair
of one key from each. HALVES x HALVES tables thus need 2 x HALVES x ROWS
minhashes instead of HALVES^2 x 2 x ROWS. At a similarity of 0.75 a pair misses
all tables with a chance of about 2 (1 - 0.75^ROWS)^HALVES.

1. Documents with the same shingle set become one node.
2. Nodes alone under each key of the first collection are done; the others get
   their table keys. Each table key links its nodes to its smallest one, so a
   group of any size costs one row per node and table.
3. The likeliest such pair of each node is verified on full sets and components
   are formed. A table key whose nodes are of several components is still open.
   Under each first key, the nodes of its open keys are compared in tiles on
   full sets, all that are not of the commonest component with all others of a
   size that allows the similarity, and a tile returns the pairs of components
   that are linked. So no link between components is missed among the candidates,
   while a group of copies never becomes all its pairs: its own component is not
   compared with itself. Tiles are bounded in shingles, as in nodes.

Defined cases: words and shingles are those of the query's contract. Null or
empty texts, or texts without words, have no shingles and link with nothing.
Rows that share a doc_id are separate rows; a null doc_id is never the smallest
one of a group that has others. An empty table gives an empty result. Extra
columns are not returned, whatever their names; join by doc_id. Shingles are
compared by 64-bit hashes, and sets are the same where 128 bits of them are; for
texts of few words, the second half of those is a digest of the words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import graph, shared, words
from timedtext.llm.vector_dedup import forest

SHINGLE, PERCENT = 5, 75
HALVES, ROWS = 20, 3
#: Nodes of either side of a tile, and about the shingles that they may have together; one node more than that is a side of its own.
TILE, TILE_SHINGLES = 512, 1 << 20
#: Words up to which a set's name has a digest of the shingles themselves.
FEW = 12
_rng = np.random.default_rng(75)
_HASHES = 2 * HALVES * ROWS
_FLIP = _rng.integers(0, 2**63, _HASHES, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD, _LOWER = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans(shared.UPPER, shared.LOWER)
_PLACE = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], size=SHINGLE) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    out = []
    for w in words.word_hashes(texts):
        if len(w) >= size:
            n = len(w) - size + 1
            s = w[:n] * _PLACE[0]
            for k in range(1, size):
                s += w[k : k + n] * _PLACE[k]
            out.append(np.unique(words.mix(s)))
        elif len(w):
            out.append(words.mix(np.sum(w * _PLACE[: len(w)], keepdims=True) + np.uint64(len(w))))
        else:
            out.append(w)
    return out


def minhashes(s: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set, in slices of bounded size."""
    out = np.full(_HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(out, ((s[i : i + 4096, None] ^ _FLIP) * _ODD).min(axis=0), out=out)
    return out


def names(texts: list[str | None], sets: list[np.ndarray], size=SHINGLE) -> np.ndarray:
    """Two columns of 64 bits for each set, the same for equal sets."""
    out = np.zeros((len(sets), 2), np.uint64)
    for k, s in enumerate(sets):
        out[k] = s.sum() ^ np.uint64(len(s)), words.mix(s ^ _PLACE[0]).sum()
        if 0 < len(s) <= FEW - size + 1 and len(w := _WORD.findall(texts[k].translate(_LOWER))) <= FEW:
            shingles = sorted({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
            out[k, 1] = int.from_bytes(hashlib.blake2b("\n".join(shingles).encode("utf-8", "surrogatepass"), digest_size=8).digest())
    return words.mix(out)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[pa.Array]]]:
    """Parts of batches with the sets of their texts, and the columns of names."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            b = batch.slice(i, 512)
            texts = b.column("text").to_pylist()
            sets = shingle_sets(texts)
            none = np.array([len(s) == 0 for s in sets])
            yield b, sets, [pa.array(np.ascontiguousarray(x), mask=none) for x in names(texts, sets).view(np.int64).T]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = _PLACE[:ROWS]
    lanes = np.arange(2 * HALVES, dtype=np.uint64) << np.uint64(40)
    for b, sets, named in _slices(batches):
        low = np.array([minhashes(s) for s in sets], np.uint64).reshape(len(sets), 2 * HALVES, ROWS)
        keys = words.mix((low * factors).sum(axis=2) + lanes).view(np.int64)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(k).ravel()), HALVES).cast(pa.list_(t)) for k, t in ((keys[:, :HALVES], pa.int64()), (keys[:, HALVES:].astype(np.int32), pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *named, *lists], ["doc_id", "n_shingles", "n1", "n2", "first_keys", "second_keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets, named in _slices(batches):
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([*named, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["n1", "n2", "s"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, written."""
    a, b = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return shared.written(common.filter(F.col("common") * 100 >= percent * (F.col("sizes") - F.col("common"))).select("a", "b"), "links")


def _close(n: str, m: str, percent: int):
    """Sizes that allow the similarity at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", percent=PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of `docs`."""
    kind = dict(docs.dtypes)[doc_id]
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches = texts.mapInArrow(_sketch, f"doc_id {kind}, n_shingles long, n1 long, n2 long, first_keys array<long>, second_keys array<int>")
    sketches = shared.written(sketches, "sketches")
    classes = sketches.filter("n1 is not null").groupBy("n1", "n2").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("first_keys").alias("first_keys"), F.first("second_keys").alias("second_keys"))
    classes = shared.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    first = classes.select("node", F.explode("first_keys").alias("k1"))
    shared_k1 = shared.written(first.groupBy("k1").agg(F.count("*").alias("c")).filter("c > 1").select("k1"), "shared-keys")
    crowded = shared.written(first.join(shared_k1, "k1"), "crowded").join(classes.select("node", "n", "second_keys"), "node")
    crowded = crowded.select("node", "n", "k1", F.posexplode("second_keys").alias("j", "k2"))
    tables = shared.written(crowded.select(F.xxhash64("k1", "j", "k2").alias("key"), "k1", "node", "n"), "tables")
    least = tables.groupBy("key").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("na"), F.count("*").alias("c")).filter("c > 1").drop("c")
    least = shared.written(least, "smallest")
    stars = tables.join(least, "key").filter(F.col("node") != F.col("a")).filter(_close("n", "na", percent))
    stars = shared.written(stars.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c")), "stars")

    wanted = tables.join(least.select("key"), "key", "left_semi").select("node").distinct()
    rows = shared.written(classes.join(wanted, "node", "left_semi").select("n1", "n2", "node", "first_id"), "wanted")
    ids = shared.written(rows.select("first_id").distinct(), "wanted-ids")
    some = texts.join(ids, texts["doc_id"].eqNullSafe(ids["first_id"]), "left_semi")
    sets = some.mapInArrow(_sets, "n1 long, n2 long, s array<long>").join(rows.select("n1", "n2", "node"), ["n1", "n2"])
    sets = shared.written(sets.groupBy("node").agg(F.first("s").alias("s")), "sets")

    best = stars.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
    parts = shared.written(graph.connected_components(_verified(best, sets, percent)), "parts")
    # components that the open keys link become one
    merged = graph.connected_components(_open_links(tables, least, parts, sets, percent)).toDF("component", "whole")
    wholes = shared.written(merged, "wholes")
    parts = parts.join(wholes, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = wholes.join(parts, F.col("node") == wholes["component"], "left_anti").toDF("node", "component")
    parts = shared.written(parts.unionByName(alone), "parts")

    named = parts.join(classes.select("node", "first_id"), "node")
    smallest = shared.written(named.groupBy("component").agg(F.min("first_id").alias("low_id")), "components")
    of_node = classes.select("n1", "n2", "node", "first_id").join(parts.join(smallest, "component").select("node", "low_id"), "node", "left")
    of_node = shared.written(of_node.select("n1", "n2", F.coalesce("low_id", "first_id").alias("low_id")), "of-node")
    out = sketches.select("doc_id", "n_shingles", "n1", "n2").join(of_node, ["n1", "n2"], "left")
    component = F.when(F.col("n1").isNull(), F.col("doc_id")).otherwise(F.col("low_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _tile_links(t: pa.Table, percent: int) -> pa.Table:
    """(a, b): a spanning forest of the components of asking nodes and those that these have a link to among the other nodes."""
    asks, part = (np.asarray(t.column(c)) for c in ("asks", "part"))
    lists = t.column("s").combine_chunks()
    sets = [np.asarray(lists[i].values) for i in range(len(lists))]
    others = np.flatnonzero(~asks)
    sizes = np.array([len(sets[i]) for i in others])
    known, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(sets[i] for i in others)]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    a, b = [], []
    for x in np.flatnonzero(asks) if len(others) else ():
        at = np.searchsorted(known, sets[x])
        at = at[(at < len(known))]
        mark = np.zeros(len(known), np.int64)
        mark[at[np.isin(known[at], sets[x])]] = 1
        common = np.add.reduceat(mark[place], starts)
        hits = np.flatnonzero((common * 100 >= percent * (len(sets[x]) + sizes - common)) & (part[others] != part[x]))
        linked = np.unique(part[others][hits])
        a.extend([part[x]] * len(linked))
        b.extend(linked.tolist())
    # a spanning forest says as much as all pairs
    ids, at = np.unique(np.array([a, b], np.int64), return_inverse=True)
    at = at.reshape(2, -1)
    root = forest(len(ids), at[0], at[1])
    kept = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[kept], pa.int64()), "b": pa.array(ids[root[kept]], pa.int64())})


def _open_links(tables: DataFrame, least: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of components with a link under a table key, verified on full sets, written."""
    labelled = tables.join(least.select("key"), "key", "left_semi").join(parts, "node", "left")
    size = F.floor(F.log(F.col("n")) / math.log(100 / percent * (1 + 1e-9))).cast("int")
    labelled = labelled.select("key", "k1", "node", size.alias("size"), F.coalesce("component", "node").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    members = labelled.join(shared.written(mixed, "open-keys"), "key", "left_semi").groupBy("k1", "node").agg(F.first("part").alias("part"), F.first("size").alias("size"))
    members = shared.written(members, "open-nodes")
    most = members.groupBy("k1", "part").agg(F.count("*").alias("c")).groupBy("k1").agg(F.max_by("part", F.struct("c", "part")).alias("most"))
    rows = members.join(shared.written(most, "largest-parts"), "k1")
    # sets that are similar enough are of one size class or of two that follow each other
    asking = rows.filter("part <> most").select("k1", "node", "part", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"), F.lit(True).alias("asks"))
    rows = shared.written(asking.unionByName(rows.select("k1", "node", "part", "size", F.lit(False).alias("asks"))), "sides")
    side = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(TILE_SHINGLES / F.pow(F.lit(100 / percent), F.col("size") + 1))))
    counts = rows.groupBy("k1", "size").agg(F.ceil(F.count_if("asks") / side).cast("int").alias("askers"), F.ceil(F.count_if(~F.col("asks")) / side).cast("int").alias("others"))
    rows = rows.join(shared.written(counts.filter("askers > 0 and others > 0"), "tiles"), ["k1", "size"])
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = rows.filter("asks").select("k1", "size", "node", "part", "asks", own(F.col("askers")).alias("i"), every(F.col("others")).alias("j"))
    others = rows.filter("not asks").select("k1", "size", "node", "part", "asks", every(F.col("askers")).alias("i"), own(F.col("others")).alias("j"))
    tiles = asking.union(others).join(sets, "node")
    found = tiles.groupBy("k1", "size", "i", "j").applyInArrow(lambda t: _tile_links(t, percent), "a long, b long")
    return shared.written(found.distinct(), "links")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= {SHINGLE} THEN list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, low.b AS component_id, doc_id = low.b AS kept FROM s JOIN low ON low.a = doc_id"""
