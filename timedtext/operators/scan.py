"""A scan of long recordings in parallel blocks, for rules whose next step depends on what the last one decided.

A recording is cut into blocks by its order. Each block is summed up as a function
of the state before it, all at once; a fold over these sums, a row a block, finds
the state before each block; then all blocks are gone through at once, each from its
state. So a recording is as many tasks as it has blocks, twice, and one cheap fold of
a row a block between. Recordings of a single block skip the first two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timedtext.operators.fold import fold

#: Rows of a block, as a power of two.
BITS = 13


def block_scan(
    df: DataFrame,
    key: str,
    order: str,
    init: Callable[[], tuple | None],
    step: Callable[[tuple | None, tuple], tuple[tuple | None, Iterable[tuple]]],
    schema: T.StructType,
    state: T.StructType,
    total: Callable[[list[tuple]], tuple],
    totals: T.StructType,
    after: Callable[[tuple | None, tuple], tuple | None],
    able: Column | None = None,
    bits: int = BITS,
) -> DataFrame:
    """Rows that `step` returns for each row of each key in order, as `fold` does.

    step takes (state, row as a tuple in the order of df's columns). total sums the rows
    of a block up as a tuple of the type `totals`, and after(state, sums) is the state
    behind it; a state is a tuple of the type `state`, or None, which all fields null
    stand for. A block has the rows of 2 ** bits values of `order`, a whole number. A
    key for which the aggregate `able` is not true is one block.
    """
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        return fold(df, key, [order], init, step, schema)
    names = df.columns
    place = F.shiftright(F.col(order).cast("long"), bits)
    ends = df.groupBy(key).agg(F.min(place).alias("__low"), F.max(place).alias("__high"), (F.lit(True) if able is None else able).alias("__able"))
    long = ends.filter("__low < __high AND __able").select(F.col(key).alias("__key"), F.lit(True).alias("__long"))
    rows = df.join(long, df[key] == long["__key"], "left").withColumn("__block", F.when(F.col("__long"), place).otherwise(F.lit(0).cast("long")))

    sums = T.StructType([df.schema[key], T.StructField("__block", T.LongType()), T.StructField("__sums", totals)])
    kept = rows.filter("__long").select(*names, "__block")
    at, width = names.index(key), len(names)

    def gather(held: list, row: tuple) -> tuple[list, list]:
        held.append(row)
        return held, []

    def summed(held: list) -> list[tuple]:
        return [(held[0][at], held[0][width], total([r[:width] for r in held]))]

    blocks = fold(kept, [key, "__block"], [order], list, gather, sums, summed)
    before = T.StructType([df.schema[key], T.StructField("__block", T.LongType()), T.StructField("__state", state)])
    empty = (None,) * len(state)

    def chain(now: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        rec, block, found = row
        return after(now, tuple(found.values())), [(rec, block, empty if now is None else now)]

    states = fold(blocks, key, ["__block"], init, chain, before)

    both = rows.select(*names, "__block", F.lit(True).alias("__row")).unionByName(states.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    both = both.select(*names, "__block", "__row", "__state")

    def replay(now: tuple | None, row: tuple) -> tuple[tuple | None, Iterable[tuple]]:
        if row[width + 1]:
            return step(now, row[:width])
        given = tuple(row[width + 2].values())
        return (None if all(x is None for x in given) else given), []

    return fold(both, [key, "__block"], ["__row", order], init, replay, schema)
