"""Connected components by alternating large and small stars, as Spark joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm import shared


#: Edges of a task where a graph is small; what is left of a shuffle's partitions then is merged.
EDGES = 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in the edges (a, b); the component is its smallest node.

    Only minima are gathered, never neighbours, and both sides of each join are
    written tables, so that a node with very many edges can be split over tasks.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = shared.written(e, "edges")
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = _state(e)
    while state[0]:
        parts = min(most, state[0] // EDGES + 1)
        save = lambda df, name, parts=parts: shared.written(df.coalesce(parts), name)
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-star")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = save(large, "edges")
        least = save(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        small = large.join(least, "a")
        e = small.filter("b <> m").select("b", "m").union(least.select("a", "m")).toDF("a", "b").distinct()
        e = save(e, "edges")
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
