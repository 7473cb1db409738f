"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are shuffled by a seeded hash and cut into blocks.
A source of weight w (its share of all weights) has its block j released at
floor(j / w) and due at ceil((j + 1) / w). Earliest deadline first gives every
slot to one released block; as the shares sum to 1, every deadline holds, and
after any number of slots each source is less than one block away from its
share. Weights are whole numbers of 1 / FINE of their sum, so windows are exact.

Rows go through DataFrame operations only. The order of blocks is sequential by
nature, each slot depending on all before it, so it is worked out on the driver, by
heaps with one entry for each source that has blocks left. A slot for which no block
is released stays empty, and time goes on to the next release, so the work is in
proportion to the blocks there are. The plan is written in pieces of PIECE blocks as
it is made: what the driver holds is a name, a weight and some numbers for each
source, and a piece. Tables of billions of rows want larger blocks (`block_rows`),
as the plan has a step for each.

Defined cases: a null source is a source of its own, named by the empty string
together with any that is so named. Sources without a target weight get
`default_weight`, and are refused where that is None; zero, negative, null and
infinite weights are refused. A source that has run out takes no more slots, and each
block of the others keeps its window, so no row is lost. Rows with equal doc_id are
all kept; texts play no part. An empty table gives an empty result. All columns
are carried; those named mix_block, mix_slot, mix_row or mix_rank are replaced.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timedtext.llm import shared

BLOCK_ROWS, SEED = 16, "mix-1"
#: Hash ranges of rows at most, and rows of one otherwise.
BUCKETS, ROWS_PER_BUCKET = 1 << 20, 1_000
FINE = 2**40
#: Blocks of the plan that are written together.
PIECE = 1 << 18
#: Blocks of a source in one row of a plan.
PLAN_ROW = 64
_SOURCE, _KEY, _BUCKET = "__mix_source", "__mix_key", "__mix_bucket"


def square_root_weights(docs: DataFrame, source="source") -> DataFrame:
    """(source, weight): the square root of each source's rows, a common way to raise small sources."""
    return docs.groupBy(F.coalesce(source, F.lit("")).alias("source")).agg(F.sqrt(F.count("*").cast("double")).alias("weight"))


def quotas(weights: list[float]) -> list[int]:
    total = sum(weights)
    return [max(1, round(w / total * FINE)) for w in weights]


def block_slots(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source's place, block, slot) in the order of slots, for as many blocks as each source has; slots for which no block is released are passed over."""
    qs = quotas(weights)
    q, slot = sum(qs), 0
    due = [(-(-q // x), i, 0) for i, x in enumerate(qs) if blocks[i]]
    heapq.heapify(due)
    later: list[tuple[int, int, int]] = []
    while due or later:
        if not due:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            _, i, j = heapq.heappop(later)
            heapq.heappush(due, (-(-(j + 1) * q // qs[i]), i, j))
        _, i, j = heapq.heappop(due)
        yield i, j, slot
        if j + 1 < blocks[i]:
            heapq.heappush(later, ((j + 1) * q // qs[i], i, j + 1))
        slot += 1


def _exact_plan(docs: DataFrame, weights: DataFrame, source: str, block_rows: int) -> DataFrame:
    """(source, part, slots): the slots of PLAN_ROW blocks of a source each, written."""
    n = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    # a source without documents holds its slots, too
    rows = sorted(weights.join(n, "source", "left").select("source", F.col("weight").cast("double"), F.coalesce("blocks", F.lit(0))).collect())
    if not all(w is not None and 0 < w < float("inf") for _, w, _ in rows):
        raise ValueError("a target weight is not positive")
    blocks = [b for *_, b in rows]
    path, spark, made = shared.fresh_path(docs.sparkSession, "mix-plan"), docs.sparkSession, 0
    held: dict[int, array] = {}
    piece: list[tuple[str, int, array]] = []

    def write() -> None:
        columns = zip((pa.string(), pa.int64(), pa.list_(pa.int64())), zip(*piece) if piece else ((), (), ()), strict=True)
        table = pa.table([pa.array(list(c), kind) for kind, c in columns], ["source", "part", "slots"])
        spark.createDataFrame(table).write.mode("append").parquet(path)
        piece.clear()

    for i, j, slot in block_slots([w for _, w, _ in rows], blocks):
        held.setdefault(i, array("q")).append(slot)
        if (j + 1) % PLAN_ROW == 0 or j + 1 == blocks[i]:
            piece.append((rows[i][0], j // PLAN_ROW, held.pop(i)))
        made += 1
        if made % PIECE == 0 and piece:
            write()
    write()
    return spark.read.schema("source string, part long, slots array<long>").parquet(path)


def _order(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def ranked(docs: DataFrame, doc_id="doc_id", source="source", seed=SEED) -> DataFrame:
    """`docs` with mix_rank, the row's number (from 0) in its source's shuffled order.

    A source is cut into hash ranges of about ROWS_PER_BUCKET rows; a row's number is its number in the range plus the counts of the ranges before, so a source of any size is ranked by many tasks.
    """
    buckets = max(1, min(BUCKETS, docs.count() // ROWS_PER_BUCKET))
    key = docs.withColumn(_SOURCE, F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn(_KEY, _order(F.col(doc_id), seed))
    key = key.withColumn(_BUCKET, F.floor(F.conv(F.substring(_KEY, 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long"))
    ties = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]  # what can be hashed
    before = key.groupBy(_SOURCE, _BUCKET).agg(F.count("*").alias("n"))
    before = before.select(_SOURCE, _BUCKET, (F.sum("n").over(W.partitionBy(_SOURCE).orderBy(_BUCKET)) - F.col("n")).alias("__mix_before"))
    within = key.withColumn("__mix_n", F.row_number().over(W.partitionBy(_SOURCE, _BUCKET).orderBy(_KEY, F.xxhash64(*ties))))
    joined = within.join(before, [_SOURCE, _BUCKET])
    return joined.withColumn("mix_rank", F.col("__mix_before") + F.col("__mix_n") - 1).drop("__mix_before", "__mix_n", _KEY, _BUCKET)


def mix(docs: DataFrame, weights: DataFrame | None = None, doc_id="doc_id", source="source", block_rows=BLOCK_ROWS, default_weight: float | None = None, seed=SEED) -> DataFrame:
    """`docs` with mix_block (number of the block in its source), mix_slot (its place in the interleaving) and mix_row (place in the block).

    weights: (source, weight); `square_root_weights` if None.
    """
    if weights is None:
        weights = square_root_weights(docs, source)
    else:
        named = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double").alias("weight"))
        there = docs.select(F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
        if default_weight is not None:
            weights = there.join(named, "source", "left").select("source", F.coalesce("weight", F.lit(float(default_weight))).alias("weight"))
        elif there.join(named, "source", "left_anti").limit(1).count():
            raise ValueError("a source has no target weight")
        else:
            weights = named
    plan = _exact_plan(docs, shared.written(weights, "mix-weights"), source, block_rows).toDF(_SOURCE, "__mix_part", "__mix_slots")
    placed = ranked(docs, doc_id, source, seed).withColumn("mix_block", F.floor(F.col("mix_rank") / block_rows))
    placed = placed.withColumn("__mix_part", F.expr(f"mix_block div {PLAN_ROW}")).join(plan, [_SOURCE, "__mix_part"])
    placed = placed.withColumn("mix_slot", F.expr(f"__mix_slots[cast(mix_block % {PLAN_ROW} as int)]"))
    return placed.withColumn("mix_row", (F.col("mix_rank") % block_rows).cast("int")).drop(_SOURCE, "mix_rank", "__mix_part", "__mix_slots")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table mixed to square-root weights: doc_id, source, mix_block, mix_slot, mix_row."""
    docs = shared.documents(spark, sf_dir).select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_row")


def plan_sql(docs: str) -> str:
    """DuckDB: CTEs up to `placed` over the relation `docs`; a step of the recursion is a slot, until the last deadline; a source with blocks left competes."""
    return f"""
WITH RECURSIVE size AS (SELECT {BLOCK_ROWS}::BIGINT AS rows),
w AS MATERIALIZED (SELECT coalesce(source, '') AS source, sqrt(count(*)::DOUBLE) AS weight, (count(*) + any_value(rows) - 1) // any_value(rows) AS blocks FROM {docs}, size GROUP BY 1),
total AS (SELECT list_reduce(list(weight ORDER BY source), lambda a, b: a + b) AS total FROM w),
quotas AS MATERIALIZED (SELECT source, blocks, greatest(1, round(weight / total * {FINE}))::HUGEINT AS quota FROM w, total),
one AS MATERIALIZED (SELECT list(source ORDER BY source) AS s, list(quota ORDER BY source) AS qs, list(blocks ORDER BY source) AS ns, sum(quota)::HUGEINT AS q FROM quotas),
upto AS MATERIALIZED (SELECT max((blocks * q + quota - 1) // quota) AS last FROM quotas, one),
steps AS (
  SELECT 0::BIGINT AS t, list_transform(qs, lambda x: 0::HUGEINT) AS done, NULL::BIGINT AS pick FROM one
  UNION ALL
  SELECT t + 1, list_transform(done, lambda n, i: CASE WHEN i = p THEN n + 1 ELSE n END), p
  FROM (SELECT t, done, (list_min(list_filter(list_transform(done, lambda n, i: CASE WHEN n < ns[i] AND n * q // qs[i] <= t
                 THEN ((n + 1) * q + qs[i] - 1) // qs[i] * 10000000 + i END), lambda v: v IS NOT NULL)) % 10000000)::BIGINT AS p
        FROM steps, one, upto WHERE t < last)),
slots AS (SELECT s[pick] AS source, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM steps, one WHERE pick IS NOT NULL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('{SEED}|' || coalesce(doc_id::VARCHAR, ''))) - 1 AS mix_rank FROM {docs}),
placed AS (
  SELECT r.*, mix_rank // rows AS mix_block, slot AS mix_slot, (mix_rank % rows)::INT AS mix_row
  FROM ranks r, size JOIN slots l ON l.source = coalesce(r.source, '') AND l.turn = mix_rank // rows)"""


SQL = plan_sql("documents") + "\nSELECT doc_id, source, mix_block, mix_slot, mix_row FROM placed"
