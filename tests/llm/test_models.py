"""The classifier and the toxicity model: held-out accuracy and defined cases."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from timedtext.llm import labelled, quality, toxicity, words

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def scored(spark, query, label):
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return [(r.score, y[r.doc_id], r.predicted) for r in query(spark, SF).collect() if r.held_out and r.doc_id in y]


def auc(rows):
    good, bad = [s for s, y, _ in rows if y == 1], [s for s, y, _ in rows if y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


@needs_data
def test_quality_on_held_out_documents(spark):
    rows = scored(spark, quality.op6_quality, "quality")
    assert auc(rows) > 0.97 and np.mean([p == 1 for _, y, p in rows if y == 1]) > 0.95


@needs_data
def test_toxicity_on_held_out_documents(spark):
    rows = scored(spark, toxicity.op8_toxicity, "toxic")
    assert auc(rows) > 0.8 and np.mean([p == 1 for _, y, p in rows if y == 0]) < 0.05


def test_held_out_is_crc32(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = df.select("doc_id", labelled.held_out(df["doc_id"]).alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0 for r in got]


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "nice words here. and more of them" if i % 2 else "you idiot! what IDIOT words") for i in range(60)] + [(100, None), (101, ""), (None, "idiot"), (1, "twice"), (102, "é" * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    q = quality.score_quality(docs.withColumnRenamed("doc_id", "score"), quality.fit(docs, labels), keep=[]).collect()
    assert len(q) == 65 and all(0 <= r.score <= 1 for r in q)
    t = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert t[100].score == t[101].score == pytest.approx(toxicity.FLOOR) and t[2].score > 0.5 > t[1].score and t[None].score > 0.5
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {round(r.score, 9) for r in toxicity.score_toxicity(docs, toxicity.fit(docs, none)).collect()} == {toxicity.FLOOR}
    assert quality.score_quality(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0


def test_offending_sentences_are_located(spark):
    kept = np.full(toxicity.PLACES, -1, np.int16)
    kept[toxicity.Sentences([b"idiot"]).place[0]] = 0
    model = (kept, np.array([9.0]), -4.0)
    docs = spark.createDataFrame([(1, "Été doux. What an idiot!\nFine"), (2, "fine")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert [docs.first().text[s.start : s.end] for s in rows[1].offending] == [" What an idiot!"] and rows[1].score > 0.9 and not rows[2].offending


def test_words_of_pieces_are_those_of_the_whole():
    text = "Été one two\tthree " * 50 + "x" * 300 + " end"
    whole = words.Scan([text.encode()])
    small = [np.concatenate([words.Scan([p]).hashes for p in words.pieces(text.encode(), size)]) for size in (7, 64, 1000)]
    assert all((s == whole.hashes).all() for s in small) and len(whole.hashes) == len(text.split())
    assert words.word_hashes(["A b", "a B"])[0].tolist() == words.word_hashes(["a b"])[0].tolist() and words.word_hashes([None])[0].tolist() == []


def test_evidence_over_pieces_is_that_of_the_whole(monkeypatch):
    text = "Été. bad word here! ok\nanother bad one? fine. " * 20
    kept = np.full(toxicity.PLACES, -1, np.int16)
    kept[toxicity.Sentences([b"bad"]).place[0]] = 0
    whole = [(s, a, b) for _, s, a, b, _ in toxicity.evidence(["x", text, text], kept)]
    assert all("bad" in text[a:b] for _, a, b in whole) and len(whole) == 80
    features = [f.tolist() for *_, f in toxicity.evidence(["x", text, text], kept)]
    for size in (16, 64, 1000):
        monkeypatch.setattr(words, "PIECE", size)
        pieces = list(toxicity.evidence(["x", text, text], kept))
        assert [(s, a, b) for _, s, a, b, _ in pieces] == whole and [f.tolist() for *_, f in pieces] == features


def test_a_sentence_is_one_wherever_pieces_end(monkeypatch):
    kept = np.full(toxicity.PLACES, -1, np.int16)
    for k, w in enumerate((b"bad", b"worse")):
        kept[toxicity.Sentences([w]).place[0]] = k
    text = "fine. bad " + "word " * 100 + "worse! ok. "
    for size in (1 << 20, 64, 20):
        monkeypatch.setattr(words, "PIECE", size)
        assert [f.tolist() for *_, f in toxicity.evidence([text], kept)] == [[0, 1]]
        counts = toxicity.document_counts([text, "bad", text], np.array([1, 0, 1]))
        assert counts[1, kept == 1].tolist() == [2] and counts[0, kept == 0].tolist() == [1]


def test_toxicity_likelihood_and_gradient():
    rng = np.random.default_rng(2)
    y = np.array([1, 0, 1, 1, 0])
    entries = [(d, rng.choice(6, rng.integers(1, 4), replace=False)) for d in (0, 0, 1, 2, 2, 2, 4)]  # document 3 has no sentence
    documents = np.array([d for d, _ in entries])
    sentences, features = np.array([k for k, (_, f) in enumerate(entries) for _ in f]), np.concatenate([f for _, f in entries])
    w, b = rng.normal(size=6), -0.5

    def plain(w, b):
        out = 0.0
        for d in range(5):
            none = np.exp(-1e-6) * np.prod([1 - 1 / (1 + np.exp(-(b + w[f].sum()))) for e, f in entries if e == d])
            out += np.log(1 - none) if y[d] else np.log(none)
        return out

    value, gw, gb = toxicity.likelihood(w, b, y, documents, sentences, features)
    assert value == pytest.approx(plain(w, b))
    steps = np.eye(6) * 1e-6
    assert gw == pytest.approx(np.array([(plain(w + h, b) - plain(w - h, b)) / 2e-6 for h in steps]), abs=1e-5)
    assert gb == pytest.approx((plain(w, b + 1e-6) - plain(w, b - 1e-6)) / 2e-6, abs=1e-5)
    before, (w, b) = toxicity.likelihood(np.ones(6), -2.0, y, documents, sentences, features)[0], toxicity.train(y, documents, sentences, features, 6)
    assert toxicity.likelihood(w, b, y, documents, sentences, features)[0] > before


def test_quality_loss_and_gradient():
    rng = np.random.default_rng(2)
    x, t = rng.normal(size=(12, 5)), rng.integers(0, 2, 12).astype(float)
    net = quality.Network(x, t, np.zeros(12, bool))
    _, grads = net.loss(x, t)
    for k, g in enumerate(grads):
        for at in np.ndindex(g.shape):
            kept, sides = net.w[k][at], []
            for h in (1e-6, -1e-6):
                net.w[k][at] = kept + h
                sides.append(net.loss(x, t)[0])
            net.w[k][at] = kept
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)


def plain_units(text):
    """The units of each word of a text by themselves and after the word before."""
    w = text.encode().split()
    out = []
    for k, x in enumerate(w):
        scan = words.Scan([b" ".join(w[max(0, k - 1) : k + 1])])
        out.append(quality.units(scan)[:, -1])
    return out


TEXTS = ["One two TWO two, end2 É!", "", None, "a", "x " * 9 + "Y z\t\nq"]


@pytest.mark.parametrize("size", [1 << 20, 9])
def test_context_and_document_vectors_are_brute_force(monkeypatch, size):
    monkeypatch.setattr(words, "PIECE", size)
    index, sums = quality.index_vectors(), np.zeros((quality.UNITS, quality.DIMENSIONS))
    table = np.random.default_rng(5).normal(size=sums.shape).astype(np.float32)
    want = []
    for text in TEXTS:
        u = plain_units(text or "")
        own = [index[x].sum(axis=0) for x in u]
        for k, x in enumerate(u):
            around = sum((own[j] for j in range(max(0, k - 2), min(len(u), k + 3)) if j != k), np.zeros(quality.DIMENSIONS))
            for place in x:
                sums[place] += around
        mean = np.mean([table[p].astype(float) for x in u for p in x], axis=0) if u else np.zeros(quality.DIMENSIONS)
        want.append([*mean, np.log1p(3 * len(u))])
    assert np.array_equal(quality.context_sums(TEXTS), sums)
    assert quality.vectors(TEXTS, table) == pytest.approx(np.array(want), abs=1e-9)


def test_arrays_are_bounded_for_any_number_of_words():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k:x}" for k in rng.integers(0, 1 << 20, 400)) for _ in range(256)] + ["more " + " ".join(f"v{k:x}" for k in range(60_000))]
    table = np.zeros((quality.UNITS, quality.DIMENSIONS), np.float32)
    for step in (lambda: quality.context_sums(texts), lambda: quality.vectors(texts, table)):
        tracemalloc.start()
        step()
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < 64 << 20


def test_models_carry_columns_and_bound_their_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"you idiot {i}!" if i % 2 else f"good words {i}.", i) for i in range(40)] + [(1, "you idiot again!", 0), (2, "good " * 100, 0)], "doc_id long, text string, part int")
    docs = docs.select("*", *(docs["part"].alias(c) for c in ("y", "pick", "score", "offending", "unit", "sums")))
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)] + [(1, 0, 1)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(labelled, "BYTES", 100)
    rows = labelled.sample(docs, labels, "toxic").collect()
    assert len(rows) == len({r.text for r in rows}) == sum(not h for h in (r.h for r in spark.range(40).select(labelled.held_out(F.col("id")).alias("h")).collect()))
    q = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    t = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert all((r.part, r.y, r.pick, r.unit) == (r.y, r.y, r.y, r.y) and 0 <= r.score <= 1 for r in [*q, *t]) and len(q) == len(t) == 42
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit(docs, labels)).count() == 0
