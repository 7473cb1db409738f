"""Each stage of the pipeline against a plain version, on its own input."""

import os
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from timedtext.llm import bpe, mixing, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
FOLD = {c: c + 32 for c in range(65, 91)}


def after_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    n = Counter(k for d in docs for k in {key(x) for x in d.text.split("\n")} if k)
    kept = {d.doc_id: "\n".join(x for x in d.text.split("\n") if not (key(x) and n[key(x)] >= 10)) for d in docs}
    return sorted((d.doc_id, kept[d.doc_id], d.lang, d.source, len(kept[d.doc_id])) for d in docs)


def without_near_duplicates(docs):
    sets = {}
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text.translate(FOLD))
        sets[d.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sorted(tuple(d) for d in docs if low[d.doc_id] == d.doc_id)


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    first = spark.read.parquet(f"{SF}/documents.parquet")
    inputs, tables = [first.collect()], [first]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], SF)
        assert i == 4 or out.columns == first.columns
        out.write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
        inputs.append(tables[-1].collect())
    rows = lambda x: sorted(map(tuple, x))

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score_quality(first, quality.fit(first, labels), keep=["doc_id"]).collect()}
    y = {r.doc_id: r["quality"] for r in labels.collect()}
    kept = {d.doc_id for d in inputs[1]}
    assert all(i in kept for i, q in y.items() if q == 1) and not any(i in kept for i, q in y.items() if q == 0)
    assert rows(inputs[1]) == rows(d for d in inputs[0] if scores[d.doc_id] >= 0.3) and len(inputs[1]) < len(inputs[0])
    assert rows(inputs[2]) == after_lines(inputs[1]) and rows(inputs[2]) != rows(inputs[1])
    assert rows(inputs[3]) == without_near_duplicates(inputs[2]) and len(inputs[3]) < len(inputs[2])
    assert rows(inputs[4]) == rows(inputs[3])
    order = [r.doc_id for r in mixing.mix(tables[3]).orderBy("mix_slot", "mix_row").collect()]
    files = sorted((tmp_path / "3").glob("part-*.parquet"))
    assert [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == order
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    texts = {d.doc_id: d.text for d in inputs[4]}
    assert {r.doc_id: r.ids for r in inputs[5]} == {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}
    assert all(r.n_tokens == len(r.ids) for r in inputs[5])


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    long = "\n".join(f"line {i} of a very long text that goes on" for i in range(20_000))
    rows = [(i, f"Common line\nand a good sentence of number {i} that is like no other one {i * i}.", "en", "abc"[i % 3], 60) for i in range(12)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (20, "", "en", None, 0), (21, long, "en", "a", len(long)), (22, long + " end", None, "a", None), (0, rows[0][1], "en", "b", 60), (23, " \n", "", "", 2)]
    kind = "doc_id long, text string, lang string, source string, n_chars int"
    df = spark.createDataFrame(rows, kind).select("*", *(F.lit(7).alias(c) for c in ("mix_slot", "ids", "score", "node", "keep_runs", "__row")))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = df
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or out.columns == docs.columns
        got = Counter((r.doc_id, r.text) for r in out.collect()) if i < 4 else None
        if i in (0, 3):
            assert not got - Counter((r[0], r[1]) for r in rows) and (i == 0 or got == Counter((r[0], r[1]) for r in rows))
        elif i == 1:
            assert got == Counter((r[0], r[1] if r[1] is None else "\n".join(x for x in r[1].split("\n") if x != "Common line")) for r in rows)
        elif i == 2:
            assert got == Counter((r[0], r[1]) for r in rows) - Counter([(22, long + " end"), (0, rows[0][1])])
        else:
            assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows) and out.filter("n_tokens = 0").count() == 3 and out.filter("node = 7").count() == len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and out.filter(F.col("n_tokens") != F.size("ids")).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("c") + " end"), (4, text("c")), (5, text("d")), (5, text("e")), (5, text("e"))]
    rows += [(6, text("f")), (7, text("f") + " end"), (7, text("g")), (8, ""), (8, ""), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    want = [(None, text("a")), (None, text("b")), (4, text("c")), (5, text("d")), (5, text("e")), (6, text("f")), (7, text("g")), (8, ""), (8, ""), (None, None), (None, None)]
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)


def test_tokens_carry_the_place_in_the_mix(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "abcab"[i % 5], 6) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    corpus_pipeline.mix_sources(spark, df, SF).write.parquet(str(tmp_path / "mixed"))
    want = [r.doc_id for r in mixing.mix(df).orderBy("mix_slot", "mix_row").collect()]
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    for docs in (mixed, mixed.orderBy("doc_id"), mixed.withColumn("mix_row", F.lit("x"))):
        out = corpus_pipeline.encode_text(spark, docs, SF).orderBy("mix_file", "mix_row").collect()
        assert [r.doc_id for r in out] == want
    assert corpus_pipeline.encode_text(spark, df, SF).count() == 200
