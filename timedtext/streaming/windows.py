"""Windows of a recognizer on streams of sample blocks.

The blocks of a recording are a map in state, by where they begin. A block is put
there once, read for the windows that it is in, and removed when the last of them is
committed; what is left of a window is never written again. Blocks may come in any
order and more than once: those behind a gap wait in the same map, those before what
is committed are skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from timedtext.operators import recognize as rec_ops


#: Blocks that are remembered within a call: a call to the state takes longer than most of what is done with a block.
SEEN = 256


class _Windows(StatefulProcessor):
    def __init__(self, key: str, recognize, choose_cut, limit: int, guard: int, names: list[str], idle_ms: int) -> None:
        self.key, self.recognize, self.choose_cut, self.limit, self.guard, self.names, self.idle_ms = key, recognize, choose_cut, limit, guard, names, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        # head: where the first block begins that is still needed; upto: where the first gap is; total: where the recording ends, or -1; count: how many blocks are in the map
        self.state = handle.getValueState("place", "position long, chunks long, head long, upto long, total long, timer long, count long")
        self.blocks = handle.getMapState("blocks", "start long", "samples array<float>")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  # Spark's names
        self.begin(initialState["samples"].iloc[0], initialState["chunks"].iloc[0])

    def begin(self, samples, chunks) -> None:
        at, n = int(samples), int(chunks)
        self.state.update((at, n, at, at, -1, -1, 0))

    def load(self) -> bool:
        """What is saved of the key, and whether anything is; nothing is remembered of the key before."""
        found = self.state.get()
        *self.saved, self.count = map(int, found) if found else (0, 0, 0, 0, -1, -1, 0)
        self.seen: dict[int, np.ndarray] = {}
        return bool(found)

    def has(self, at: int) -> bool:
        return at in self.seen or (self.count > len(self.seen) and self.blocks.containsKey((at,)))

    def get(self, at: int) -> np.ndarray:
        if at not in self.seen:
            self.keep(at, np.asarray(self.blocks.getValue((at,))[0], np.float32))
        return self.seen[at]

    def keep(self, at: int, samples: np.ndarray) -> None:
        """Remembers a block of the map for the rest of the call; few of them, however many wait."""
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen[at] = samples

    def put(self, at: int, samples) -> None:
        x = np.asarray(samples, np.float32)
        self.blocks.updateValue((at,), (x.tolist(),))
        self.count += 1
        self.keep(at, x)

    def remove(self, at: int) -> None:
        self.blocks.removeKey((at,))
        self.count -= 1
        self.seen.pop(at, None)

    def window(self, head: int, position: int, end: int) -> np.ndarray:
        """The samples from position to end, of the blocks from head on."""
        parts, at = [], head
        while at < end:
            x = self.get(at)
            parts.append(x[max(0, position - at) : end - at])
            at += len(x)
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def forget(self, head: int, position: int, upto: int) -> int:
        """Removes the blocks that end at or before a place, and returns where the first one left begins."""
        while head < upto:
            n = len(self.get(head))
            if head + n > position:
                break
            self.remove(head)
            head += n
        return head

    def commit(self, rec, place: list[int], out: list[tuple], at_end: bool) -> None:
        """All windows that can be committed; place: position, chunks, head, upto."""
        while place[3] - place[0] >= self.limit or (at_end and place[3] > place[0]):
            last = place[3] - place[0] < self.limit
            w = rec_ops.Windows(self.limit, self.guard, self.recognize, self.choose_cut, 0, place[1])
            w.position, w.buffer = place[0], self.window(place[2], place[0], min(place[3], place[0] + self.limit))
            out.append(rec_ops.committed_row(rec, w.commit(w.buffer, last)))
            place[0], place[1] = w.position, w.index
            place[2] = self.forget(place[2], place[0], place[3])

    def came(self, key, blocks: Iterable[tuple], timerValues) -> list[tuple]:  # noqa: N803
        """The windows that can be committed with further blocks of (start, samples)."""
        self.load()
        *place, total, timer = self.saved
        out: list[tuple] = []
        for at, samples in blocks:
            if at is None or at != at:
                continue
            at, n = int(at), 0 if samples is None else len(samples)
            if not n:
                total = max(total, at)
            elif at <= place[3] < at + n and at != place[3] and place[2] == place[3]:
                place[2] = at  # a block that is committed in part is the first one
                self.put(at, samples)
                place[3] = at + n
            elif at >= place[3] and not self.has(at):
                self.put(at, samples)
            while self.has(place[3]):
                place[3] += len(self.get(place[3]))
            self.commit(key[0], place, out, False)
        self.commit(key[0], place, out, 0 <= total <= place[3])
        if self.idle_ms:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.state.update((*place, total, timer, self.count))
        return out

    def expired(self, key) -> list[tuple]:
        """What is there up to the first gap is committed, and the state goes."""
        out: list[tuple] = []
        if self.load():
            *place, _, _ = self.saved
            self.commit(key[0], place, out, True)
        self.blocks.clear()
        self.state.clear()
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if out := self.came(key, (b for frame in rows for b in zip(frame["start_sample"], frame["samples"], strict=True)), timerValues):
            yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if out := self.expired(key):
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class _RowWindows(_Windows):
    """The same on rows: frames of a few rows a recording take longer to be made and turned into Arrow than all that is done with them."""

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.begin(initialState["samples"], initialState["chunks"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        made = Row(*self.names)
        return (made(*x) for x in self.came(key, ((r["start_sample"], r["samples"]) for r in rows), timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        made = Row(*self.names)
        return (made(*x) for x in self.expired(key))


def windowed(blocks: DataFrame, recognize: rec_ops.Recognize, choose_cut: rec_ops.ChooseCut, limit: int, guard: int, key: str, idle: float | None, begin: DataFrame | None) -> DataFrame:
    schema = rec_ops.committed_type(blocks.schema[key])
    processor = _RowWindows(key, recognize, choose_cut, limit, guard, [f.name for f in schema], int(idle * 1000) if idle else 0)
    initial = None if begin is None else begin.select(key, F.col("samples").cast("long").alias("samples"), F.col("chunks").cast("long").alias("chunks")).groupBy(key)
    rows = blocks.select(key, F.col("start_sample").cast("long").alias("start_sample"), "samples")
    return rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="processingTime" if idle else "none", initialState=initial)
