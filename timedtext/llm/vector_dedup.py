"""Near-duplicate vectors by collision-counting projections.

Two unit vectors at the limit of similarity are at distance D, so their
projections on a random Gaussian direction differ by a normal variable with
deviation D. A tile of two chunks sorts the second chunk on each of many
directions; a query-centred window of WIDTH x D finds the collisions of each
vector of the first, and they are counted by pair: on half of the directions
for all pairs, on the others only for those that have a count by then which a
linked pair misses with a chance of at most MISS / 2. Pairs that reach such a
count over all directions are verified in double precision.

Vectors are only compared within a label, whatever its size by many tasks. On
the main axes of a bounded sample, two linked vectors are no further apart than
D. So a label is laid out by the sides that its vectors are on and along the
first axis, and cut into chunks of at most CHUNK; only chunks whose boxes on the
axes come as close as D meet in a tile. A tile returns counts of links and a spanning forest, never
pairs. Neither the sample nor the axes have an effect on what is found.

Defined cases: a row with a null label, or a vector that is null, zero or holds
null or non-finite components, links with nothing. Equal vectors of a label are
one node with copies, each of which links with all others. Vectors of different
length don't link. Finite vectors of any size do, as a power of two takes none of
their cosine away. A null vec_id is never the smallest of a group with others.
Rows with one vec_id are rows of their own. An empty table gives an empty
result. Of extra columns none is returned, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from timedtext.llm import graph, shared, vectors

SIMILARITY, DIRECTIONS, WIDTH, MISS, CHUNK = 0.93, 32, 1.5, 1e-4, 1024
#: Axes of boxes, and vectors of each length that they are fitted on.
AXES, AXES_SAMPLE = 8, 5_000
#: Axes of the grid by whose cells chunks find each other.
GRID = 3
#: Chunks of a task that cuts.
SLAB = 16


def needed_collisions(directions=DIRECTIONS, width=WIDTH, miss=MISS) -> int:
    """The largest count that a pair at the limit reaches with a chance of at least 1 - miss."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for n in range(directions + 1):
        below += math.comb(directions, n) * p**n * (1 - p) ** (directions - n)
        if below > miss:
            return n
    return directions


def directions(dim: int, n=DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(93).standard_normal((dim, n))


def windows(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each row of b in the order of b's projections, and the places from low to high that are within `reach` of each row of a."""
    order = np.argsort(b, kind="stable")
    place = np.empty(len(b), np.int32)
    place[order] = np.arange(len(b), dtype=np.int32)
    return place, np.searchsorted(b[order], a - reach, "left").astype(np.int32), np.searchsorted(b[order], a + reach, "right").astype(np.int32)


def colliding_pairs(a: np.ndarray, b: np.ndarray, reach: float, miss=MISS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a and b that are within `reach` in so many columns that a linked pair has fewer with a chance of at most `miss`."""
    n = a.shape[1]
    half = n // 2
    counts = np.zeros((len(a), len(b)), np.uint8)
    for k in range(half):
        place, low, high = windows(a[:, k], b[:, k], reach)
        counts += (place >= low[:, None]) & (place < high[:, None])
    rows, cols = np.nonzero(counts >= needed_collisions(half, miss=miss / 2))
    found = counts[rows, cols]
    for k in range(half, n):
        place, low, high = windows(a[:, k], b[:, k], reach)
        found += (place[cols] >= low[rows]) & (place[cols] < high[rows])
    enough = found >= needed_collisions(n, miss=miss / 2)
    return rows[enough], cols[enough]


def main_axes(nodes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, the middle of a sample of about AXES_SAMPLE nodes, and orthonormal columns along which it varies most."""
    share = min(1.0, AXES_SAMPLE / max(nodes.count(), 1))
    rows = nodes.filter(F.pmod("node", F.lit(1 << 30)) < int(share * (1 << 30))).select("dim", "embedding").toArrow()
    dims, out = np.asarray(rows.column("dim")), {}
    for dim in np.unique(dims):
        x, _ = vectors.scaled(vectors.matrix(rows.column("embedding").filter(pa.array(dims == dim))))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        middle = x.mean(axis=0)
        out[int(dim)] = middle, np.linalg.svd(x - middle, full_matrices=False)[2][:AXES].T
    return out


def chunked(nodes: DataFrame, chunk: int) -> DataFrame:
    """`nodes` with at, the places of the unit vector on the axes, sides, a bit for each of them, and chunk, the number of its chunk; written."""
    axes = main_axes(nodes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at = np.zeros((t.num_rows, AXES))
            dims = np.asarray(t.column("dim"))
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                x, _ = vectors.scaled(vectors.matrix(t.column("embedding").take(pa.array(mine))))
                middle, a = axes.get(int(dim), (np.zeros(dim), np.zeros((dim, 0))))
                at[mine, : a.shape[1]] = (x / np.linalg.norm(x, axis=1, keepdims=True) - middle) @ a
            lists = pa.ListArray.from_arrays(np.arange(0, at.size + 1, AXES, dtype=np.int32), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([*t.columns, lists, pa.array((at > 0) @ (1 << np.arange(AXES)), pa.int64())], [*t.schema.names, "at", "sides"])

    placed = nodes.mapInArrow(place, T.StructType([*nodes.schema, T.StructField("at", T.ArrayType(T.DoubleType())), T.StructField("sides", T.LongType())]))
    placed = shared.written(placed, "vector-places")
    slabs = placed.repartitionByRange(-(-placed.count() // (SLAB * chunk)) or 1, "label", "dim", "sides", F.get("at", F.lit(0)), "node")
    slabs = shared.written(slabs.withColumn("slab", F.spark_partition_id()), "vector-slabs")
    turn = F.row_number().over(W.partitionBy("label", "dim", "slab").orderBy("sides", F.get("at", F.lit(0)), "node")) - 1
    return shared.written(slabs.withColumn("chunk", F.col("slab").cast("long") * (1 << 32) + F.floor(turn / chunk)).drop("slab"), "vector-chunks")


def near_chunks(placed: DataFrame, distance: float) -> DataFrame:
    """(label, dim, i, j): the pairs of chunks, and each with itself, whose boxes are no further apart than `distance`; written.

    Boxes, half a distance wider on every side, are sent to the cells of a grid over the
    first GRID axes that they meet, and joined by cell; a pair counts in the first cell
    that both have. So a label's boxes are joined by many keys.
    """
    side = lambda f: F.array(*(f(F.get("at", F.lit(k))) for k in range(AXES)))
    boxes = shared.written(placed.groupBy("label", "dim", "chunk").agg(side(F.min).alias("low"), side(F.max).alias("high")), "vector-boxes")
    first = lambda k: F.floor((F.get("low", F.lit(k)) - distance / 2) / distance)
    cells = boxes.withColumn("begin", F.array(*(first(k) for k in range(GRID))))
    for k in range(GRID):
        cells = cells.withColumn(f"cell{k}", F.explode(F.sequence(first(k), F.floor((F.get("high", F.lit(k)) + distance / 2) / distance))))
    cell = [f"cell{k}" for k in range(GRID)]
    a = cells.select("label", "dim", *cell, F.col("begin").alias("begin_i"), F.col("chunk").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    b = cells.select("label", "dim", *cell, F.col("begin").alias("begin_j"), F.col("chunk").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    gap = lambda k: F.greatest(F.get("low_i", F.lit(k)) - F.get("high_j", F.lit(k)), F.get("low_j", F.lit(k)) - F.get("high_i", F.lit(k)), F.lit(0.0))
    apart = functools.reduce(lambda x, y: x + y, (gap(k) * gap(k) for k in range(AXES)))
    here = functools.reduce(lambda x, y: x & y, (F.col(f"cell{k}") == F.greatest(F.get("begin_i", F.lit(k)), F.get("begin_j", F.lit(k))) for k in range(GRID)))
    pairs = a.join(b, ["label", "dim", *cell]).filter(here & (F.col("i") <= F.col("j")) & (apart <= distance * distance * (1 + 1e-9)))
    return shared.written(pairs.select("label", "dim", "i", "j"), "vector-tiles")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the links (a, b)."""
    low = np.arange(n)
    while True:
        least = low.copy()
        np.minimum.at(least, a, low[b])
        np.minimum.at(least, b, low[a])
        least = least[least]
        if (least == low).all():
            return low
        low = least


def link_vectors(df: DataFrame, similarity=SIMILARITY, chunk=CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vec_id, embedding and label."""
    distance = math.sqrt(2 - 2 * similarity) * (1 + 1e-9)
    node = F.xxhash64("label", "embedding")
    nodes = shared.written(vectors.distinct_vectors(df.filter("label is not null"), "label").withColumn("node", node), "vectors")
    placed = chunked(nodes, chunk)
    pairs = near_chunks(placed, distance)
    rows = placed.select("label", "dim", "node", "copies", "embedding", F.col("chunk").alias("mine"))
    # a chunk's vectors go to each of its tiles, once to that with itself
    sides = pairs.withColumn("mine", F.col("i")).union(pairs.filter("i <> j").withColumn("mine", F.col("j")))
    tiles = rows.join(sides, ["label", "dim", "mine"])

    def run(t: pa.Table) -> pa.Table:
        ids, copies, mine = (np.asarray(t.column(c)) for c in ("node", "copies", "mine"))
        order = np.lexsort((ids, mine))
        ids, copies, mine = ids[order], copies[order], mine[order]
        raw, _ = vectors.scaled(vectors.matrix(t.column("embedding"))[order])  # the cosine stays the same
        norms = np.linalg.norm(raw, axis=1)
        unit = raw / norms[:, None]
        lines = unit @ directions(raw.shape[1])
        split = int(np.searchsorted(mine, mine[-1]))
        first = slice(0, split or len(ids))
        a, b = colliding_pairs(lines[first], lines[split:], WIDTH * distance)
        b = b + split
        a, b = (a, b) if split else (a[a < b], b[a < b])
        cosine = np.einsum("ij,ij->i", raw[a], raw[b]) / (norms[a] * norms[b])
        a, b = a[cosine >= similarity], b[cosine >= similarity]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        found = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[found], pa.int64()), "links": pa.array(links[found], pa.int64()), "root": pa.array(ids[forest(len(ids), a, b)][found], pa.int64())})

    found = shared.written(tiles.groupBy("label", "dim", "i", "j").applyInArrow(run, "node long, links long, root long"), "vector-links")
    parts = graph.connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "first_id", "copies").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = shared.written(named.join(links, "node", "left").select("node", "first_id", "part", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-parts")
    low = shared.written(named.groupBy("part").agg(F.min("first_id").alias("low_id")), "vector-components")
    done = shared.written(named.join(low, "part").select("node", "n_links", "low_id"), "vector-nodes")
    keyed = df.select("vec_id", F.when(F.col("label").isNotNull() & vectors.usable(F.col("embedding")), node).alias("node"))
    out = keyed.join(done, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("low_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND {_GOOD}),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {SIMILARITY}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, low.b AS component_id, vec_id = low.b AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN low ON low.a = vec_id"""
