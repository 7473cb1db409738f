"""Quality classifier on random-indexing word vectors.

A word has three units: itself, its ending, and its shape (letters in capitals,
digits, symbols, length, whether it repeats the word before). Each unit has a
sparse random index vector. The context vector of a unit is the sum of the
index vectors of the units of the words around it, gathered over the sample;
units fall into UNITS hashed places, so the table is of fixed size for any
vocabulary, and rare words may share one. A document is the mean of the context
vectors of its units, from its whole text. A network with one hidden layer gives
a score; a temperature that is fitted on a tenth of the sample that the network
has not seen calibrates it.

The model is fitted on at most labelled.SAMPLE labelled documents of at most
labelled.BYTES bytes each, which are turned into numbers by tasks; only those and
the table, of fixed size, reach the driver.

Defined cases: null and empty texts have a zero vector and a score like others.
Without any labelled rows every score is 0.5. Repeated rows and ids are scored
each; labels, lang, source and doc_id play no part in a score. A very long text
is worked on in pieces with the words around them, so its vector is that of the
whole. An empty table gives an empty one. All other columns are carried; one
named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timedtext.llm import labelled, shared, words

UNITS, DIMENSIONS, NONZERO, SPAN = 1 << 15, 48, 6, 2
HIDDEN, ROUNDS, DECAY, THRESHOLD = 24, 300, 1e-4, 0.3
_SHAPES = 1 << 10
#: Rows of the table that are added up together: a task of a few megabytes, however many units its texts have.
ROWS = 1 << 13


def units(scan: words.Scan) -> np.ndarray:
    """The units of each word, as places in the table: word, ending, shape."""
    raw, s, e = scan.raw, scan.starts, scan.ends
    count = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind)])[np.stack([s, e])], axis=0)[0]
    upper, digits = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    symbols = words.MARKS[raw] & ~np.isin(raw, np.frombuffer(b".,;:'\"()-\n ", np.uint8))
    uppers, n = count(upper), e - s
    first = upper[s]
    same = np.zeros(len(s), bool)
    same[1:] = (scan.hashes[1:] == scan.hashes[:-1]) & (scan.owners[1:] == scan.owners[:-1])
    shape = np.minimum(uppers, 3) | (first << 2) | ((count(digits) > 0) << 3) | (np.minimum(count(symbols), 3) << 4) | (np.minimum(n // 4, 3) << 6) | (same << 8) | ((n == count(symbols)) << 9)
    ending = scan.hash(np.maximum(e - 3, s), e)
    room = np.uint64((UNITS - _SHAPES) // 2)
    return np.stack([(scan.hashes % room).astype(np.int64) + _SHAPES, (ending % room).astype(np.int64) + _SHAPES + int(room), shape])


def index_vectors() -> np.ndarray:
    """A few random signs among zeros for each unit."""
    rng = np.random.default_rng(6)
    out = np.zeros((UNITS, DIMENSIONS), np.float32)
    at = rng.integers(0, DIMENSIONS, (UNITS, NONZERO))
    np.add.at(out, (np.arange(UNITS)[:, None], at), rng.choice(np.array([-1, 1], np.float32), (UNITS, NONZERO)))
    return out


def context_sums(texts: list[str | None]) -> np.ndarray:
    """The sum of the index vectors of the words around, for each unit. A shape depends on the word before, so pieces have one more word around them."""
    index, out = index_vectors(), np.zeros((UNITS, DIMENSIONS), np.float32)
    for _, scan, own in words.framed_batches(texts, SPAN + 1):
        u = units(scan)
        vector = sum(index[x] for x in u)
        around = np.zeros_like(vector)
        for k in range(1, SPAN + 1):
            together = (scan.owners[k:] == scan.owners[:-k])[:, None]
            around[k:] += vector[:-k] * together
            around[:-k] += vector[k:] * together
        for x in u:
            x = np.where(own, x, UNITS)
            order = np.argsort(x, kind="stable")
            places, begins = np.unique(x[order], return_index=True)
            if len(places):
                sums = np.add.reduceat(around[order], begins, axis=0)
                out[places[places < UNITS]] += sums[places < UNITS]
    return out


def vectors(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """The mean of the context vectors of each text's units, and the log of the number of units."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for rows, scan, own in words.framed_batches(texts, SPAN + 1):
        found.append(np.unique(np.concatenate([(rows * UNITS + x)[own] for x in units(scan)]), return_counts=True))
    # a long text has its units in several pieces
    keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, place, np.concatenate([c for _, c in found]))
    rows, total = keys // UNITS, np.zeros(len(texts))
    sums = np.zeros((len(texts), DIMENSIONS))
    np.add.at(total, rows, n)
    ends = np.searchsorted(rows, np.arange(len(texts)), "right")
    at = 0
    while at < len(keys):
        # whole texts, of which one has at most UNITS keys
        end = max(int(ends[rows[at]]), int(ends[max(0, np.searchsorted(ends, at + ROWS, "right") - 1)]))
        some, begins = np.unique(rows[at:end], return_index=True)
        sums[some] = np.add.reduceat(table[keys[at:end] % UNITS].astype(np.float64) * n[at:end, None], begins, axis=0)
        at = end
    return np.concatenate([sums / np.maximum(total, 1)[:, None], np.log1p(total)[:, None]], axis=1)


class Network:
    """Standardised inputs, one hidden layer of tanh, one output over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray) -> None:
        """Fitted to the rows that are not fresh; the fresh ones set the temperature."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        rng = np.random.default_rng(7)
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        z, t = (x[~fresh] - self.mean) / self.scale, y[~fresh]
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        for step in range(1, ROUNDS + 1):
            _, grads = self.loss(z, t)
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if fresh.any():
            s, t = self.logit(x[fresh]), y[fresh]
            loss = lambda temp: np.mean(np.logaddexp(0, s / temp) - t * s / temp)
            self.temperature = min(np.geomspace(0.5, 8, 61), key=loss)

    def loss(self, z: np.ndarray, t: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean log loss with a penalty on weights, and its gradient, at standardised inputs."""
        a = np.tanh(z @ self.w[0] + self.w[1])
        s = a @ self.w[2] + self.w[3]
        d = (1 / (1 + np.exp(-s)) - t) / len(t)
        back = np.outer(d, self.w[2]) * (1 - a * a)
        value = np.mean(np.logaddexp(0, s) - t * s) + DECAY / 2 * (np.sum(self.w[0] ** 2) + np.sum(self.w[2] ** 2))
        return float(value), [z.T @ back + DECAY * self.w[0], back.sum(axis=0), a.T @ d + DECAY * self.w[2], d.sum(keepdims=True)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x) / self.temperature))


def _texts(batches: Iterator[pa.RecordBatch], column="text", rows=256) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            b = whole.slice(i, rows)
            yield b, b.column(column).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, label="quality") -> tuple[np.ndarray, Network | None]:
    """The table of context vectors and the network; None without labelled rows."""
    sample = labelled.sample(docs, labels, label)

    def gather(t: pa.Table) -> pa.Table:
        total = sum(context_sums(texts) for _, texts in _texts(t.to_batches()))
        some = np.flatnonzero(total.any(axis=1))
        return pa.table({"unit": pa.array(some, pa.int64()), "sums": pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), DIMENSIONS).cast(pa.list_(pa.float32()))})

    gathered = sample.groupBy("part").applyInArrow(gather, "unit long, sums array<float>")
    sums = gathered.groupBy("unit").agg(F.array(*(F.sum(F.get("sums", F.lit(k))).cast("float") for k in range(DIMENSIONS))).alias("sums")).toArrow()  # at most UNITS rows
    table = np.zeros((UNITS, DIMENSIONS), np.float32)
    if not sums.num_rows:
        return table, None
    table[np.asarray(sums.column("unit"))] = np.asarray(sums.column("sums").combine_chunks().flatten()).reshape(-1, DIMENSIONS)
    table = table / (np.linalg.norm(table, axis=1, keepdims=True) + 1e-9)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches):
            x = vectors(texts, table)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("pick"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "pick", "x"])

    rows = sample.mapInArrow(pool, "y double, pick int, x array<double>").collect()  # at most SAMPLE rows of fixed size
    rows = sorted((r.pick, r.y, tuple(r.x)) for r in rows)
    pick, y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return table, Network(x, y, pick == 0)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network | None], text="text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with score, the probability of label 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    held = docs.sparkSession.sparkContext.broadcast(model)  # a table and weights of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, network = held.value
        for b, texts in _texts(batches, "__quality_text"):
            score = network.score(vectors(texts, table)) if network else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score)], [*keep, "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).alias("__quality_text")).mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    scored = score_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
