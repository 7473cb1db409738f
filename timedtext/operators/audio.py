"""Operators on samples."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timedtext.functions.text import RATE
from timedtext.operators.fold import values

BLOCK = 65_536
#: Zero crossings of the resampler's sinc on either side, the share of the band that passes, and samples made at once.
ZEROS, PASS, PART = 32, 0.94, 4096


def digital_silence(samples: Column | str) -> Column:
    """Whether every sample of a block equals zero; -0.0 does, NaN and the smallest numbers don't, and an empty block is none."""
    c = F.col(samples) if isinstance(samples, str) else samples
    return (F.size(c) > 0) & F.forall(c, lambda x: x == 0)


def silent_recordings(pcm: DataFrame, key="rec", sample="x") -> DataFrame:
    """(rec, silent) of one row per sample."""
    return pcm.groupBy(key).agg(F.bool_and(F.col(sample) == 0).alias("silent"))


def signal_stats(pcm: DataFrame, key="rec", order="i", sample="x") -> DataFrame:
    """(rec, energy, crossings): the sum of squares, and changes of sign from one sample to the next."""
    x = F.col(sample).cast("double")
    before = F.lag(x).over(W.partitionBy(key).orderBy(order))
    rows = pcm.select(key, x.alias("x"), ((x < 0) != (before < 0)).alias("crosses"))
    return rows.groupBy(key).agg(F.sum(F.col("x") * F.col("x")).alias("energy"), F.count_if("crosses").alias("crossings"))


def compare_pcm(a: DataFrame, b: DataFrame, key="rec", order="i", sample="x", skip: tuple[int, int] | None = None) -> DataFrame:
    """(rec, samples, relative_error): squared difference over squares of `a` on aligned samples, without those of index skip[0] to skip[1]."""
    both = a.select(key, order, F.col(sample).cast("double").alias("__a")).join(b.select(key, order, F.col(sample).cast("double").alias("__b")), [key, order])
    if skip:
        both = both.filter(~F.col(order).between(skip[0], skip[1] - 1))
    d = F.col("__a") - F.col("__b")
    sums = both.groupBy(key).agg(F.count("*").alias("samples"), F.sum(d * d).alias("e"), F.sum(F.col("__a") * F.col("__a")).alias("s"))
    return sums.select(key, "samples", F.when(F.col("s") > 0, F.col("e") / F.col("s")).alias("relative_error"))


def pcm_blocks(pcm: DataFrame, block=BLOCK, key="rec", order="i", sample="x") -> DataFrame:
    """(rec, start_sample, samples) of one row per sample, in blocks of `block` samples."""
    at = (F.floor(F.col(order) / block) * block).cast("long")
    rows = pcm.groupBy(key, at.alias("start_sample")).agg(F.array_sort(F.collect_list(F.struct(order, sample))).alias("s"))
    return rows.select(key, "start_sample", F.transform("s", lambda x: x[sample]).alias("samples"))


class Resampler:
    """Mono at 16 kHz from blocks of one format.

    A sample is a weighted mean of the TAPS input samples around its place, by a
    windowed sinc whose pass band ends at the lower of both rates' halves, so that
    what lies above does not fold into speech. Beyond its ends, the input goes on
    with its first and last sample. Only a tail of the input is carried.
    """

    def __init__(self, rate: int, channels: int) -> None:
        if rate <= 0 or channels <= 0:
            raise ValueError("no such format")
        self.rate, self.channels = rate, channels
        common = math.gcd(rate, RATE)
        self.up, self.down = RATE // common, rate // common
        self.half = math.ceil(ZEROS * max(1.0, rate / RATE))
        self.held, self.at, self.made = np.zeros(0), 0, 0  # the input from index `at` on, and the number of samples made
        self.weights = _sinc_weights(rate, self.up, self.half)

    def mono(self, samples: np.ndarray) -> np.ndarray:
        """The mean of the channels; two channels keep their power: their sum times sqrt(1/2)."""
        x = np.asarray(samples, np.float64).reshape(-1, self.channels)
        return x.sum(axis=1) * (np.sqrt(0.5) if self.channels == 2 else 1 / self.channels)

    def push(self, samples: np.ndarray) -> np.ndarray:
        self.held = np.concatenate([self.held, self.mono(samples)])
        # a sample needs `half` of the input behind its place
        return self._make(max(0, -(-(self.at + len(self.held) - self.half) * self.up // self.down)))

    def drain(self) -> np.ndarray:
        """What is left, as at the end of the input or of a format."""
        return self._make(-(-(self.at + len(self.held)) * self.up // self.down))

    def _make(self, upto: int) -> np.ndarray:
        parts = [self._part(k, min(k + PART, upto)) for k in range(self.made, upto, PART)] if len(self.held) else []
        self.made = max(self.made, upto) if len(self.held) else self.made
        done = min(self.made * self.down // self.up - self.half - self.at, len(self.held) - 1)
        if done > 0:
            self.held, self.at = self.held[done:], self.at + done
        return np.concatenate([np.zeros(0, np.float32), *parts])

    def _part(self, first: int, last: int) -> np.ndarray:
        """The samples of numbers first to last: number k lies at k * down / up of the input."""
        k = np.arange(first, last)
        if self.up == self.down:
            return self.held[k - self.at].astype(np.float32)
        around = np.arange(1 - self.half, self.half + 1)
        places = np.clip((k * self.down // self.up)[:, None] + around - self.at, 0, len(self.held) - 1)
        return np.einsum("ij,ij->i", self.held[places], self.weights[k * self.down % self.up]).astype(np.float32)


@functools.lru_cache(maxsize=8)
def _sinc_weights(rate: int, up: int, half: int) -> np.ndarray:
    """A row for each of `up` places between two input samples: the weights of the samples around, which sum to 1."""
    away = np.arange(1 - half, half + 1) - np.arange(up)[:, None] / up
    band = PASS * min(1.0, RATE / rate)
    w = np.sinc(away * band) * np.i0(9 * np.sqrt(np.clip(1 - (away / half) ** 2, 0, None)))
    return w / w.sum(axis=1, keepdims=True)


def downmix_resample(pcm: DataFrame, key="rec", order="seq", block=BLOCK) -> DataFrame:
    """(rec, start_sample, samples) at 16 kHz from blocks of interleaved samples with their rate and channels.

    A change of format within a recording first drains the samples before it.
    Blocks go through in order, one in memory at a time, with a short tail carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made, current = None, 0, None
        for batch in batches:
            for rec, samples, rate, channels in zip(*(values(batch.column(c)) for c in (key, "samples", "rate", "channels")), strict=True):
                if current is not None and (rec != last or (rate, channels) != (current.rate, current.channels)):
                    tail = current.drain()
                    if len(tail):
                        yield out(last, made, tail)
                    made = 0 if rec != last else made + len(tail)
                    current = None
                current = current or Resampler(rate, channels)
                last = rec
                x = current.push(samples)
                for i in range(0, len(x), block):
                    yield out(rec, made + i, x[i : i + block])
                made += len(x)
        if current is not None and len(tail := current.drain()):
            yield out(last, made, tail)

    def out(rec, start: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rec]), pa.array([start], pa.int64()), pa.array([x], pa.list_(pa.float32()))], [key, "start_sample", "samples"])

    kind = dict(pcm.dtypes)[key]
    rows = pcm.select(key, order, "samples", "rate", "channels").repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, f"`{key}` {kind}, start_sample long, samples array<float>")
