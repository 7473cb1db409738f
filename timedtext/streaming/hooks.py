"""Hooks that tell how far a run has come."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from timedtext.functions.text import RATE
from timedtext.operators.journal import observed

#: Position and total in seconds of audio, percent (at most 99 as long as the run goes on) and seconds left; the last two are None where they are not known.
Hook = Callable[[dict], None]


@dataclass
class Progress:
    """Adds up what was committed; the rate is that of all after the first commit."""

    total_s: float | None = None
    clock: Callable[[], float] = time.monotonic
    position_s: float = 0.0
    chunks: int = 0
    first: tuple[float, float] | None = field(default=None, repr=False)

    def add(self, samples: int, chunks: int) -> dict:
        self.position_s += samples / RATE
        self.chunks += chunks
        now = self.clock()
        self.first = self.first or (now, self.position_s)
        began, from_s = self.first
        known = bool(self.total_s and self.total_s > 0 and self.position_s <= self.total_s)
        percent = min(99, int(self.position_s / self.total_s * 100)) if known else None
        spent, moved = now - began, self.position_s - from_s
        left = (self.total_s - self.position_s) * spent / moved if known and spent > 0 and moved > 0 else None
        return {"position_s": self.position_s, "total_s": self.total_s, "chunks": self.chunks, "percent": percent, "left_s": left}


class CommitListener(StreamingQueryListener):
    """Calls a hook after each batch of a stream whose commits are observed under `name` (journal.observed)."""

    def __init__(self, hook: Hook, total_s: float | None = None, name: str = "commits", clock: Callable[[], float] = time.monotonic) -> None:
        self.hook, self.name, self.progress, self.error = hook, name, Progress(total_s, clock), None

    def onQueryStarted(self, event) -> None:  # noqa: N802  # Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = (event.progress.observedMetrics or {}).get(self.name)
        if seen is not None and seen["chunks"]:
            self.hook(self.progress.add(seen["samples"] or 0, seen["chunks"]))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.error = event.exception
        self.hook({"position_s": self.progress.position_s, "total_s": self.progress.total_s, "chunks": self.progress.chunks, "percent": None if event.exception else 100, "left_s": None if event.exception else 0.0})


def listen(spark: SparkSession, hook: Hook, total_s: float | None = None, name: str = "commits") -> CommitListener:
    """Begins to call `hook` for streams of this session; spark.streams.removeListener ends it."""
    listener = CommitListener(hook, total_s, name)
    spark.streams.addListener(listener)
    return listener


def run_in_batches(batches: Iterable[DataFrame], write: Callable[[DataFrame], None], hook: Hook, total_s: float | None = None, name: str = "commits") -> Progress:
    """Writes batch tables of commits one after the other and calls `hook` after each, with what Spark saw going through."""
    progress = Progress(total_s)
    for n, commits in enumerate(batches):
        seen, metrics = observed(commits, f"{name}-{n}")
        write(seen)
        got = metrics.get
        hook(progress.add(got["samples"] or 0, got["chunks"]))
    return progress
