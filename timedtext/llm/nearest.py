"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks, and a task has the tile of one
query block and one candidate block. Blocks are large, so that a vector goes
through the shuffle few times, and a task works through its tile in parts of
PART by PART. Vectors are rounded to int8 with a scale of their own; a part's
product of those gives every inner product up to an error that is bounded by the
norms of what rounding took away. A candidate is kept if the most it can be
reaches what the k-th is at least, in the part or in the parts before, so none
of the tile's nearest is lost; those are computed again in double precision and
go into the query's heap of k, which all parts share. The heaps of all tiles of
a query meet in a ranking that is cut to k before and after its shuffle. Work
grows with queries times candidates; a vector's copies with their number over
the side of a block.

Bounds are those of vectors that a power of two has brought near 1, so vectors of any
finite size are compared. Where a product may go beyond the range of doubles, it is
computed as it is: it may be infinite, or no number, which ranks first, as in SQL.

Defined cases: vectors that are null, zero or hold null or non-finite
components are neither queries nor candidates, nor are rows with a null id.
Rows with the same id and the same vector count once; a query's own id is never
its candidate. Vectors are only compared with those of equal length. Ties go to
the smaller id. With fewer than k candidates all are returned; an empty table
has no rows. Of extra columns none is returned, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timedtext.llm import shared, vectors

K, QUERY_BLOCK, BLOCK, PART = 20, 4096, 16_384, 1024
#: For rounding errors of the bounds themselves, by far larger than these.
SLACK = 1e-6
#: Powers of two whose products are far from the ends of the range of doubles, and those whose sums may lie beyond it.
USUAL, BEYOND = 250, 960


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, norm of what they stand for, and norm of the rest."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    values = np.rint(x / scale).astype(np.int8)
    stands = values * scale
    return values, scale[:, 0], np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, part: int = PART) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of the k nearest within the tile for each query, nearest first."""
    (near_q, power_q), (near_c, power_c) = vectors.scaled(q), vectors.scaled(c)
    a, sa, na, ea = rounded(near_q)
    b, sb, nb, eb = rounded(near_c)
    # products of usual size are told apart as well without their powers of two
    usual = max(np.abs(power_q).max(initial=0), np.abs(power_c).max(initial=0)) < USUAL
    least_step = q.shape[1] * 2.0**-1072
    exact = np.float32 if q.shape[1] <= 1024 else np.float64  # whole numbers, so the product is exact
    a, b = a.astype(exact), b.astype(exact)
    heaps: list[list[tuple[float, bool, int, float]]] = [[] for _ in qid]
    sure = np.full(len(qid), -np.inf)  # the k-th best score so far
    for x in range(0, len(qid), part):
        mine = slice(x, x + part)
        for y in range(0, len(cid), part):
            others = slice(y, y + part)
            about = (a[mine] @ b[others].T).astype(np.float64) * sa[mine, None] * sb[others]
            # x.y - x'.y' = x'.(y - y') + (x - x').y, where |y| <= |y'| + |y - y'|
            size = nb[others] + eb[others]
            error = na[mine, None] * eb[others] + ea[mine, None] * size + SLACK * (na[mine] + ea[mine])[:, None] * size
            own = qid[mine, None] == cid[others]
            lowest, highest = about - error, about + error
            power = power_q[mine, None] + power_c[others]
            if usual:
                factor = np.ldexp(1.0, power)
                lowest, highest = lowest * factor, highest * factor
            else:
                lowest, highest = np.ldexp(lowest, power) - least_step, np.ldexp(highest, power) + least_step
                beyond = power > BEYOND
                lowest[beyond], highest[beyond] = -np.inf, np.inf
            low = np.where(own, -np.inf, lowest)
            least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
            rows, cols = np.nonzero((highest >= np.maximum(least, sure[mine])[:, None]) & ~own)
            rows, cols = rows + x, cols + y
            # summed from left to right, so that a score doesn't depend on the tile
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.concatenate([np.cumsum(q[rows[i : i + 65_536]] * c[cols[i : i + 65_536]], axis=1)[:, -1] for i in range(0, len(rows), 65_536)] or [np.zeros(0)])
            for i, s, n in zip(rows.tolist(), scores.tolist(), cid[cols].tolist(), strict=True):
                entry = (s, False, -n, s) if s == s else (np.inf, True, -n, s)
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], entry)
                elif entry[:3] > heaps[i][0][:3]:
                    heapq.heapreplace(heaps[i], entry)
            sure[mine] = [h[0][0] if len(h) == k else -np.inf for h in heaps[mine]]
    return [(i, -n, s) for i, h in zip(qid.tolist(), heaps, strict=True) for *_, n, s in sorted(h, key=lambda x: x[:3], reverse=True)]


def nearest(df: DataFrame, is_query: Column, k=K, query_block=QUERY_BLOCK, block=BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for a table of vec_id and embedding; is_query tells the queries by vec_id."""
    rows = vectors.distinct_vectors(df.filter("vec_id is not null"), "vec_id").select("vec_id", "embedding", "dim", is_query.alias("is_query"))
    rows = shared.written(rows, "vectors")
    n, queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = -(-n // block) or 1, -(-queries // query_block) or 1
    place = F.xxhash64("vec_id", "embedding")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("c", F.pmod(place, F.lit(blocks)).cast("int")).select("vec_id", "embedding", "dim", F.lit(False).alias("asks"), grid(query_blocks).alias("q"), "c")
    asking = rows.filter("is_query").withColumn("q", F.pmod(place, F.lit(query_blocks)).cast("int")).select("vec_id", "embedding", "dim", F.lit(True).alias("asks"), "q", grid(blocks).alias("c"))

    def run(t: pa.Table) -> pa.Table:
        asks = np.asarray(t.column("asks"))
        ids, m = np.asarray(t.column("vec_id")), vectors.matrix(t.column("embedding"))
        found = tile(ids[asks], m[asks], ids[~asks], m[~asks], k) if asks.any() and not asks.all() else []
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    found = candidates.union(asking).groupBy("dim", "q", "c").applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
SQL = f"""
WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_GOOD}),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
