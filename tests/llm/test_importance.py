"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timedtext.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@given(st.lists(st.one_of(st.none(), st.text("aZ9é日-_ \n\x00{@", max_size=60)), max_size=8), st.sampled_from([5, 40, None]))
@settings(max_examples=150, deadline=None)
def test_features_of_parts(texts, size):
    texts = [*texts, "x" * 150 + " Yé " + "é" * 80]
    n_words, buckets = Counter(), [[] for _ in texts]
    for word, doc, bucket in importance.features(texts, size):
        n_words.update(word.tolist())
        for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            buckets[d].append(b)
    assert [(n_words[i], sorted(b)) for i, b in enumerate(buckets)] == [(n, sorted(b)) for n, b in map(plain, texts)]


def expected(docs, target):
    corpus, wanted = Counter(), Counter()
    for _, t in docs:
        corpus.update(plain(t)[1])
    for t in target:
        wanted.update(plain(t)[1])
    many, few = sum(corpus.values()) + 10_000, sum(wanted.values()) + 10_000
    rows = []
    for i, t in docs:
        n, b = plain(t)
        weight = sum(math.floor(1000 * math.log((wanted[x] + 1) * many / ((corpus[x] + 1) * few))) for x in b)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(str, rows))


def some_docs():
    rng = np.random.default_rng(5)
    words = np.array("the a model spark data Über naïve 日本 table 7 join".split())
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(230)]
    return [*docs, (None, " ".join(words[:5]) * 9), (None, None), (900, ""), (901, "of " * 30_000), (3, docs[3][1]), (3, docs[3][1]), *[(7, docs[7][1])] * 4]


def test_resample_of_odd_rows(spark):
    docs, target = some_docs(), ["the model joins data", None, "", "data data Über table", "the model joins data"]
    df = spark.createDataFrame([(i, t, -1, "x", 5) for i, t in docs], "doc_id long, text string, rank int, key string, row long").repartition(5)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(str(list(r)) for r in got.collect()) == expected(docs, target)


def test_empty_tables(spark):
    docs, empty = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, docs).collect() == []
    rows = importance.resample(docs, empty, percent=50, min_words=0).collect()
    assert {(r["doc_id"], r["n_features"]) for r in rows} == {(1, 117), (2, 0)}
    assert sorted(str(r["rank"]) for r in rows) == ["1", "None"]


@pytest.mark.parametrize("n", [1, 7, 500, 3000])
def test_kth_is_that_of_a_sort(spark, n):
    rng = np.random.default_rng(n)
    keys = [(int(a), int(b)) for a, b in zip(rng.integers(-3, 3, n), range(n), strict=True)]
    df = spark.createDataFrame(keys, "a long, b long").select(F.struct("a", "b").alias("key"))
    for k in {1, (n + 1) // 2, n}:
        assert tuple(importance.kth(df, k)) == sorted(keys)[k - 1]
    assert importance.kth(df, n + 1) is None
    assert [r["rank"] for r in importance.ranked(df.repartition(3), "key").orderBy("key").collect()] == list(range(1, n + 1))
