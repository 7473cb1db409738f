"""The sorted fold: one pass over each key's rows in order, with a state carried along.

It is for rules whose next step depends on what the last one decided. Rows are
dealt by key, sorted within the partition, and streamed through Arrow batches;
no key is ever held whole, and keys may begin and end anywhere in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

State = object
Step = Callable[[State, tuple], tuple[State, Iterable[tuple]]]
ROWS = 4096


def values(column: pa.Array) -> list:
    """A column's values; lists of numbers are views of the batch, not Python lists."""
    kind = column.type
    if not (pa.types.is_list(kind) and (pa.types.is_integer(kind.value_type) or pa.types.is_floating(kind.value_type))) or column.flatten().null_count:
        return column.to_pylist()
    return [np.asarray(x.values) if x.is_valid else None for x in column]


def fold(df: DataFrame, key: str | list[str], order: list[str], init: Callable[[], State], step: Step, schema: StructType, finish: Callable[[State], Iterable[tuple]] | None = None) -> DataFrame:
    """Rows that `step` returns for each row, and `finish` for each key's last state.

    step takes (state, row), the row as a tuple in the order of df's columns, and
    returns (state, rows of `schema`). Lists of numbers are numpy arrays, structs are
    dicts. A key may be several columns.
    """
    keys = [key] if isinstance(key, str) else key
    places = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema)
        begun, last, state, out = False, None, None, []

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(kind)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)
            out.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for row in zip(*map(values, part.columns), strict=True):
                    at_key = [row[i] for i in places]
                    if at_key != last:
                        if begun and finish:
                            out.extend(finish(state))
                        begun, last, state = True, at_key, init()
                    state, rows = step(state, row)
                    out.extend(rows)
                if out:
                    yield made()
        if begun and finish:
            out.extend(finish(state))
            if out:
                yield made()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
