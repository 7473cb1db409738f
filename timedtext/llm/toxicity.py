"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

The features of a sentence are its words and their beginnings of 4 to 8 bytes,
hashed. Those that differ most between toxic and other documents of the sample
are kept. A sentence has probability p = sigmoid(w.x + b), or 0 without any
kept feature, and a document 1 - prod(1 - p) over all its sentences. The
weights follow from the labels of documents alone, by gradient steps on the
likelihood of that noisy-or; then the sentences over a threshold are told.

The model is fitted on at most labelled.SAMPLE labelled documents of at most
labelled.BYTES bytes each, counted and turned into numbers by tasks; counts of
fixed size and the kept features of their sentences reach the driver.

Defined cases: sentences end at . ! ? or a line feed. Null and empty texts, and
texts without kept features, have the score FLOOR. Without any labelled rows every
score is FLOOR. Repeated rows and ids are scored each; labels, lang, source and
doc_id play no part in a score. A very long text is worked on in pieces that end
where sentences do, so its score is that of the whole. An empty table gives an
empty one. All other columns are carried; those named score or offending are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timedtext.llm import labelled, shared, words

PLACES, FEATURES, LEAST = 1 << 19, 2048, 4
BEGINNINGS = (4, 5, 6, 7, 8)
ROUNDS, DECAY, THRESHOLD, FLOOR = 400, 0.05, 0.5, 1e-3
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?\n"]] = True


class Sentences:
    """Features by sentence of the pieces of some texts: row (of the text), sentence (numbered over all), place (of the feature)."""

    def __init__(self, held: list[bytes]) -> None:
        self.scan = scan = words.Scan(held, between=words.MARKS)
        n = scan.ends - scan.starts
        parts = [(np.arange(len(n)), scan.hashes)]
        for k in BEGINNINGS:
            long = np.flatnonzero(n > k)
            parts.append((long, scan.hash(scan.starts[long], scan.starts[long] + k) ^ np.uint64(k)))
        self.word = np.concatenate([w for w, _ in parts])
        self.place = (np.concatenate([h for _, h in parts]) % np.uint64(PLACES)).astype(np.int64)
        self.sentence_of = np.cumsum(_ENDS[scan.raw])


def document_counts(texts: list[str | None], y: np.ndarray) -> np.ndarray:
    """In how many documents of either label each feature is."""
    out = np.zeros((2, PLACES), np.int32)
    seen: dict[int, list[np.ndarray]] = {}
    for owners, held in words.batches(texts, between=_ENDS):
        s = Sentences(held)
        rows = np.asarray(owners)[s.scan.owners[s.word]]
        pairs = np.unique(rows * PLACES + s.place)
        for row in np.unique(pairs // PLACES):
            seen.setdefault(int(row), []).append(pairs[pairs // PLACES == row] % PLACES)
        for row in [r for r in seen if r < owners[-1]]:  # a text goes on in the next batch only if it is the last one here
            out[int(y[row]), np.unique(np.concatenate(seen.pop(row)))] += 1
    for row, parts in seen.items():
        out[int(y[row]), np.unique(np.concatenate(parts))] += 1
    return out


def kept_features(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Number of each kept feature by place, or -1."""
    rate = (counts + 0.5) / (documents[:, None] + 1)
    score = (np.log(rate[1]) - np.log(rate[0])) / np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    score[counts.sum(axis=0) < LEAST] = 0
    best = np.argsort(-score, kind="stable")[:FEATURES]
    best = best[score[best] > 1]
    out = np.full(PLACES, -1, np.int16)
    out[best] = np.arange(len(best))
    return out


def evidence(texts: list[str | None], kept: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(text, sentence, start, end, features) of each sentence with kept features; start and end in code points of the text."""
    done: dict[int, tuple[int, int]] = {}  # sentences and code points of the pieces before
    for owners, held in words.batches(texts, between=_ENDS):
        s = Sentences(held)
        feature = kept[s.place]
        hits = np.flatnonzero(feature >= 0)
        starts = np.concatenate([[1], 1 + np.cumsum([len(x) + 1 for x in held])])
        keys = s.sentence_of[s.scan.starts[s.word[hits]]]
        order = np.lexsort((feature[hits], keys))
        groups = np.split(hits[order], np.flatnonzero(np.diff(keys[order])) + 1) if len(hits) else []
        ends = np.flatnonzero(_ENDS[s.scan.raw])
        for g in groups:
            at = s.scan.starts[s.word[g[0]]]
            piece = int(s.scan.owners[s.word[g[0]]])
            sentence = int(s.sentence_of[at])
            low, high = max(int(ends[sentence - 1]) + 1, int(starts[piece])), min(int(ends[sentence]) + 1, int(starts[piece + 1]) - 1)
            row = owners[piece]
            sentences, points = done.get(row, (0, 0))
            base = int(starts[piece])
            count = lambda a, b: int(np.count_nonzero((s.scan.raw[a:b] & 0xC0) != 0x80))  # noqa: B023, E731
            begin = points + count(base, low)
            yield row, sentences + sentence - int(s.sentence_of[base - 1]), begin, begin + count(low, high), np.unique(feature[g])
        for piece, row in enumerate(owners):
            raw = s.scan.raw[starts[piece] : starts[piece + 1] - 1]
            sentences, points = done.get(row, (0, 0))
            done[row] = (sentences + int(_ENDS[raw].sum()), points + int(np.count_nonzero((raw & 0xC0) != 0x80)))


def likelihood(w: np.ndarray, b: float, y: np.ndarray, documents: np.ndarray, sentences: np.ndarray, features: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The log-likelihood of the labels under the noisy-or, and its gradient by weights and bias."""
    z = b + np.bincount(sentences, w[features], minlength=len(documents))
    p = 1 / (1 + np.exp(-z))
    # the log of 1 - p, summed, is minus this; a little more, so that a document without sentences is possible under either label
    total = np.bincount(documents, np.logaddexp(0, z), minlength=len(y)) + 1e-6
    pull = np.where(y == 1, np.exp(-total) / -np.expm1(-total), -1.0)[documents] * p
    return float(np.where(y == 1, np.log(-np.expm1(-total)), -total).sum()), np.bincount(features, pull[sentences], minlength=len(w)), float(pull.sum())


def train(y: np.ndarray, documents: np.ndarray, sentences: np.ndarray, features: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the noisy-or. documents: the document of each sentence; sentences, features: the entries of the sentences' features."""
    w, b = np.full(n, 1.0), -2.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, ROUNDS + 1):
        _, gw, gb = likelihood(w, b, y, documents, sentences, features)
        g = np.append(gw - DECAY * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w + move[:-1], b + move[-1]
    return w, float(b)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for whole in batches:
        for i in range(0, whole.num_rows, 512):
            b = whole.slice(i, 512)
            yield b, b.column(column).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, label="toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Number of each kept feature by place, weights, bias."""
    sample = labelled.sample(docs, labels, label)

    def count(t: pa.Table) -> pa.Table:
        total, n = np.zeros((2, PLACES), np.int32), np.zeros(2, np.int64)
        for b, texts in _slices(t.to_batches(), "text"):
            y = np.asarray(b.column("y"))
            total += document_counts(texts, y)
            n += np.bincount(y.astype(int), minlength=2)
        return pa.table({"counts": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n.tolist()], pa.list_(pa.int64()))})

    counts, n = np.zeros((2, PLACES), np.int32), np.zeros(2, np.int64)
    for r in sample.groupBy("part").applyInArrow(count, "counts binary, n array<long>").toLocalIterator():  # PARTS rows of fixed size
        counts += np.frombuffer(r.counts, np.int32).reshape(2, PLACES)
        n += np.array(r.n)
    kept = kept_features(counts, n)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _slices(batches, "text"):
            found: list[list[list[int]]] = [[] for _ in texts]
            for row, _, _, _, f in evidence(texts, kept):
                found[row].append(f.tolist())
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["y", "found"])

    rows = sorted((r.y, r.found) for r in sample.mapInArrow(find, "y double, found array<array<int>>").collect())  # kept features only
    flat = [(d, f) for d, (_, found) in enumerate(rows) for f in found]
    documents = np.array([d for d, _ in flat], np.int64)
    sentences = np.array([k for k, (_, f) in enumerate(flat) for _ in f], np.int64)
    features = np.array([x for _, f in flat for x in f], np.int64)
    w, b = train(np.array([y for y, _ in rows]), documents, sentences, features, int(kept.max()) + 1) if flat else (np.zeros(max(1, int(kept.max()) + 1)), -9.0)
    return kept, w, b


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text="text", keep: list[str] | None = None, threshold=THRESHOLD) -> DataFrame:
    """`docs` (or its columns `keep`) with score and offending, the sentences over the threshold as (start, end, score), worst first."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "offending")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, w, bias = held.value
        for b, texts in _slices(batches, "__toxic_text"):
            clean = np.full(len(texts), 1 - FLOOR)
            worst: list[list[dict]] = [[] for _ in texts]
            for row, _, start, end, f in evidence(texts, kept):
                p = 1 / (1 + np.exp(-(bias + w[f].sum())))
                clean[row] *= 1 - p
                if p >= threshold:
                    worst[row].append({"start": start, "end": end, "score": float(p)})
            worst = [sorted(x, key=lambda s: (-s["score"], s["start"])) for x in worst]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(1 - clean), pa.array(worst, kind)], [*keep, "score", "offending"])

    offending = T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), offending])
    return docs.select(*keep, F.col(text).alias("__toxic_text")).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
    out = scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
    return out.withColumn("n_offending", F.size("offending").cast("long")).drop("offending")
