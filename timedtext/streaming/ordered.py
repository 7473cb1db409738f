"""Folds on streams: the step functions of the sorted folds, with their state kept by recording.

Rows of a recording may arrive in any order. Each has a place, and the state
knows the place that comes next: rows that fit are applied, later ones are held
in state until the gap closes, and earlier ones, which were applied before, are
skipped, as is a second row at a place that is held: both are repeats of a source
that delivers at least once. A row without a place is skipped, too. No row is
dropped for being late, as there is no watermark.

State is kept in columns, which can be read by Spark's state data source: the fold's
own in one value, rows that wait in a map by blocks of places. A stream may begin where a
batch ended: `begin` has the place that comes next and the state of each recording.

The state of a recording without new rows for `idle` expires: rows that are
still held are applied in their order, over the gaps, and the state goes. What
comes after that begins anew. Spark runs batch after batch for the sake of such
timers, so a stream with `idle` needs a trigger that goes on and must be stopped;
one that ends when all is read has to do without.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

#: Places of a block of rows that wait, as a power of two.
BITS = 8
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory; the operators of this module need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Blocks:
    """Rows that wait, in blocks of 2 ** BITS places; a block is read and written once in a call, if it is needed at all."""

    def __init__(self, held, place: int, kind: StructType, waiting: int) -> None:
        self.held, self.place, self.kind, self.waiting = held, place, kind, waiting
        self.blocks: dict[int, dict[int, tuple]] = {}
        self.there: set[int] = set()
        self.changed: set[int] = set()
        self.stored = waiting > 0

    def block(self, n: int) -> dict[int, tuple]:
        if n not in self.blocks:
            rows = self.held.getValue((n,))[0] if self.stored and self.held.containsKey((n,)) else ()
            if rows:
                self.there.add(n)
            self.blocks[n] = {int(r[self.place]): tuple(r) for r in rows}
        return self.blocks[n]

    def put(self, at: int, row: tuple) -> None:
        """Holds a row, unless one of its place is held."""
        block = self.block(at >> BITS)
        if at not in block:
            block[at] = row
            self.waiting += 1
            self.changed.add(at >> BITS)

    def take(self, at: int) -> tuple | None:
        if not self.waiting:
            return None
        row = self.block(at >> BITS).pop(at, None)
        if row is not None:
            self.waiting -= 1
            self.changed.add(at >> BITS)
        return row

    def save(self) -> int:
        """Writes what has changed, and returns how many rows wait."""
        for n in self.changed:
            if self.blocks[n]:
                self.held.updateValue((n,), ([_typed(r, self.kind) for r in self.blocks[n].values()],))
            elif n in self.there:
                self.held.removeKey((n,))
        return self.waiting


class _Ordered(StatefulProcessor):
    def __init__(self, columns, first, place, after, init, step, names, idle_ms, row_type, state_type) -> None:
        self.columns, self.first, self.place, self.after, self.begin, self.step, self.names, self.idle_ms = columns, first, place, after, init, step, names, idle_ms
        self.row_type, self.state_type = row_type, state_type

    def init(self, handle) -> None:
        self.handle = handle
        # waiting: how many rows are held; each call to the state takes longer than a step, so none is made for a row
        fields = [T.StructField("next", T.LongType()), T.StructField("timer", T.LongType()), T.StructField("waiting", T.LongType()), *self.state_type]
        self.state = handle.getValueState("state", StructType(fields))
        self.held = handle.getMapState("held", "block long", StructType([T.StructField("rows", T.ArrayType(self.row_type))]))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  # Spark's names
        row = initialState.astype(object).where(initialState.notna(), None).iloc[0]
        self.state.update((int(row["next"]), -1, 0, *_typed([row[f.name] for f in self.state_type], self.state_type)))

    def saved(self) -> tuple:
        """The place that comes next, the timer, the number of rows that wait and the fold's state; a state of nulls is one that has not begun."""
        saved = self.state.get()
        if not saved:
            return self.first, -1, 0, self.begin()
        state = tuple(saved[3:])
        return int(saved[0]), int(saved[1]), int(saved[2]), None if all(x is None for x in state) else state

    def save(self, expected: int, timer: int, waiting: int, state: tuple | None) -> None:
        self.state.update((expected, timer, waiting, *([None] * len(self.state_type) if state is None else _typed(state, self.state_type))))

    def rows_of(self, frame: pd.DataFrame) -> Iterator[tuple]:
        """The rows that have a place, with None for what is null."""
        columns = []
        for c in self.columns:
            null, made = frame[c].isna().to_numpy(), frame[c].tolist()
            columns.append([None if n else x for x, n in zip(made, null, strict=True)] if null.any() else made)
        return (r for r in zip(*columns, strict=True) if r[self.place] is not None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  # Spark's names
        expected, timer, waiting, state = self.saved()
        new = [r for frame in rows for r in self.rows_of(frame)]
        out: list[tuple] = []
        blocks = _Blocks(self.held, self.place, self.row_type, waiting)
        for row in sorted(new, key=lambda r: int(r[self.place])):
            at = int(row[self.place])
            if at > expected:
                blocks.put(at, row)
            elif at == expected:
                while row is not None:
                    state, made = self.step(state, row)
                    out.extend(made)
                    expected = self.after(row)
                    row = blocks.take(expected)
        waiting = blocks.save()
        if self.idle_ms:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.save(expected, timer, waiting, state)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        if self.state.exists():
            *_, state = self.saved()
            for _, held in sorted(((int(k[0]), v[0]) for k, v in self.held.iterator()), key=lambda x: x[0]):
                for row in sorted(map(tuple, held), key=lambda r: int(r[self.place])):
                    state, made = self.step(state, row)
                    out.extend(made)
        self.held.clear()
        self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, key: str, columns: list[str], place: str, first: int, after: Callable[[tuple], int], init: Callable[[], object], step: Callable[[tuple | None, tuple], tuple[tuple | None, Iterable[tuple]]], schema: StructType, state: StructType, idle: float | None = None, begin: DataFrame | None = None) -> DataFrame:
    """The rows that step makes of each row, recording by recording, in the order of `place`, which starts at `first` and goes on at after(row).

    The fold's state is a tuple of the type `state`, or None. idle: seconds after which
    state expires; never if None. begin: key, next (a place) and the columns of `state`,
    a row for each recording that a batch has begun.
    """
    names = [f.name for f in schema]
    row_type = StructType([stream.schema[c] for c in columns])
    processor = _Ordered(columns, first, columns.index(place), after, init, step, names, int(idle * 1000) if idle else 0, row_type, state)
    initial = None if begin is None else begin.select(key, "next", *(f.name for f in state)).groupBy(key)
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="processingTime" if idle else "none", initialState=initial)


def _typed(row: Iterable, kind: StructType) -> tuple:
    """Values as state takes them: numbers that came through pandas as floats are whole again where their column is."""

    def one(x, t: T.DataType):
        if x is None:
            return None
        made = int if isinstance(t, T.IntegralType) else float if isinstance(t, T.FractionalType) else bool if isinstance(t, T.BooleanType) else None
        return made(x) if made else x

    return tuple(one(x, f.dataType) for x, f in zip(row, kind, strict=True))
