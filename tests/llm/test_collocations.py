"""Phrases against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timedtext.llm import collocations, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_runs(docs):
    out = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    out["und" if lang is None else lang, tuple(w[i : i + n])] += 1
    return out


def plain(docs, least=10, share=50, top=2000):
    runs = plain_runs(docs)
    total = Counter()
    for (lang, w), f in runs.items():
        total[lang] += f * (len(w) == 1)
    rows = {}
    for (lang, w), a in runs.items():
        if len(w) < 2 or a < least:
            continue
        longer = [f for (x, v), f in runs.items() if x == lang and len(v) > len(w) and f >= least and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))] if len(w) == 2 else []
        if any(100 * f >= share * a for f in longer):
            continue
        score, _, l, r = min((1000000 * a * a // (runs[lang, w[:k]] * runs[lang, w[k:]]), k, runs[lang, w[:k]], runs[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -score) for lang, x in rows.items() for i, (score, a, p, l, r) in enumerate(sorted(x)[:top]))  # noqa: E741


def some_docs(n=400):
    rng = np.random.default_rng(3)
    word = np.array(["The", "the", "of", "data", "spark", "x\x00y", "日本", "Über", "a b", "-"])
    mark = np.array([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "?"])
    text = lambda k: "".join(np.char.add(rng.choice(word, k, p=[0.3, *[0.7 / 9] * 9]), rng.choice(mark, k)))
    docs = [(text(rng.integers(1, 40)), [None, "en", "fr", ""][rng.integers(4)]) for _ in range(n)]
    return [*docs, (None, "en"), ("", None), (" .\n", "zz"), (docs[0][0], docs[0][1]), ("of the data " * 3000, "en"), ("longword" * 400, "fr")]


def test_phrases_of_odd_rows(spark):
    docs = some_docs()
    df = spark.createDataFrame([(t, x, 1, "n") for t, x in docs], "text string, lang string, f long, w1 string").repartition(5)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collocations.phrases(df)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == plain(docs)
    got = collocations.phrases(df, least=2, share=80, top=7)
    assert sorted(map(tuple, got.collect())) == plain(docs, 2, 80, 7)


def test_empty_table(spark):
    assert collocations.phrases(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.phrases(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


@given(st.lists(st.tuples(st.one_of(st.none(), st.text("aAb .\t\né", max_size=40)), st.sampled_from([None, "en", "fr"])), max_size=8), st.sampled_from([3, 10, 1000]), st.sampled_from([4, 1000]))
@settings(max_examples=150, deadline=None)
def test_runs_do_not_depend_on_where_texts_are_cut(docs, together, piece):
    kept = collocations.TOGETHER, words.PIECE, words.pieces.__defaults__
    collocations.TOGETHER, words.pieces.__defaults__ = together, (piece, kept[2][1])
    try:
        batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([d[i] for d in docs], pa.string()) for i in (0, 1)], names=["text", "lang"])])
        got = Counter()
        for b in collocations._singles_and_pairs(batches()):
            for r in b.to_pylist():
                if r["w1"] is not None:
                    got[r["lang"], tuple(x for x in (r["w1"], r["w2"]) if x is not None)] += r["f"]
        every = np.full(collocations.BLOCKS, -1, np.int64).view(np.uint64)
        for b in collocations._triples(batches(), every):
            for r in b.to_pylist():
                got[r["lang"], (r["w1"], r["w2"], r["w3"])] += r["f"]
    finally:
        collocations.TOGETHER, words.pieces.__defaults__ = kept[0], kept[2]
    assert got == plain_runs(docs)


def test_filter_knows_its_pairs_and_few_others(spark):
    rows = [("en", f"w{i}", f"v{i * 7}") for i in range(3000)]
    known = collocations.pair_filter(spark.createDataFrame(rows, "lang string, w1 string, w2 string"))
    names = lambda rows: [np.array([collocations._name(r[0], r[i].encode()) for r in rows], np.uint64) for i in (1, 2)]
    block, bits = collocations._places(*names(rows))
    assert ((known[block] & bits) == bits).all()
    block, bits = collocations._places(*names([("fr", a, b) for _, a, b in rows]))
    assert ((known[block] & bits) == bits).mean() < 0.01


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_counts_across_ranges(spark, ranges):
    """A word with most of the runs, whose rows lie in many ranges."""
    rows, f = [], {}
    for a in "abh":
        f[a,] = 5000
        for b in range(60 if a == "h" else 3):
            f[a, f"p{b}"] = 400 + b
            for c in range(b % 7):
                f[a, f"p{b}", f"q{c}"] = 30 + (b * 7 + c) % 50
    rows = [("en", *k, *[None] * (3 - len(k)), n) for k, n in f.items()]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = collocations.covered(spark.createDataFrame(rows, "lang string, k1 string, k2 string, k3 string, f long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    most = {}
    for r in got:
        k = tuple(x for x in (r["k1"], r["k2"], r["k3"]) if x is not None)
        if r["f"] is None:
            most[k] = max(most.get(k, 0), r["most"])
        else:
            assert (r["f"], r["c1"], r["c2"]) == (f[k], f[k[:1]] if len(k) > 1 else None, f[k[:2]] if len(k) > 2 else None)
    assert most == {k: max(n for j, n in f.items() if len(j) == 3 and j[:2] == k) for k in f if len(k) == 2 and any(len(j) == 3 and j[:2] == k for j in f)}
    assert sum(r["f"] is not None for r in got) == len(f)
