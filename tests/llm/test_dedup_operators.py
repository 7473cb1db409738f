"""Line dedup, near-duplicates, vectors and mixing against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timedtext.llm import graph, line_dedup, mixing, near_dup, nearest, vector_dedup

RANDOM = random.Random(9)


def groups(nodes, links):
    low = {n: n for n in nodes}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return low


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("sampled", [0.0, 1.0])
def test_line_dedup_is_brute_force(spark, monkeypatch, sampled):
    monkeypatch.setattr(line_dedup, "SAMPLED", sampled)  # at 1, the commonest lines are dealt by document
    pool = ["Common É line", " common É LINE\t", "other", "", "  ", "\x0b", "ÉCOLE", "école", "once\r"]
    texts = ["\n".join(RANDOM.choice([*pool, f"own {i} {k}"]) for k in range(RANDOM.choice([1, 3, 200]))) for i in range(60)] + [None, "", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = [(t or "").split("\n") for t in texts]
    n = Counter(k for d in docs for k in {key(x) for x in d} if k)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for i, d in enumerate(docs):
        kept = [x for x in d if not (key(x) and n[key(x)] >= 10)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_lines) == (len(d), len(d) - len(kept), kept)
        assert got[i].keep_runs is None or [d[k] for r in got[i].keep_runs for k in range(r["at"], r["at"] + r["n"])] == kept
    assert any(r.n_dropped for r in got.values())
    lines = line_dedup.hashed_lines(df, "doc_id", "text", 1)
    assert line_dedup.heavy_hashes(lines, 4).count() == (sampled > 0) * sum(c > 8 and c * 16 >= lines.count() for c in Counter(k for d in docs for k in map(key, d) if k).values())


@pytest.mark.parametrize("sampled", [0.0, 1.0])
def test_lines_of_one_document_with_two_texts(spark, monkeypatch, sampled):
    monkeypatch.setattr(line_dedup, "SAMPLED", sampled)
    rows = [(i, "x\ny") for i in range(9)] + [(8, "own\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(df).collect())
    got = line_dedup.dedup_lines(df.union(spark.createDataFrame([(9, "x")], df.schema)))
    assert sorted((r.doc_id, r.kept_lines) for r in got.collect()) == sorted([(i, ["y"]) for i in range(9)] + [(8, ["own"]), (9, [])])


def test_line_dedup_sorts_once_and_streams(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "__line_doc long, __line_text long, n int, pos int, h1 long, h2 long")
    plan = line_dedup.streamed(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.count("Sort [") == 1 and "pos" in plan[plan.index("Sort [") :].split("\n")[0] and "hashpartitioning" not in plan


def test_line_dedup_keeps_first_and_repeated_rows(spark):
    df = spark.createDataFrame([(2, "a\nb\na", "x"), (1, "b\nA", "x"), (1, "b\nA", "x"), (None, "a", "y")], "doc_id long, text string, n_lines string")
    rows = line_dedup.dedup_lines(df, min_documents=2, keep_first=True).collect()
    assert [r.n_lines for r in rows if r.doc_id == 2] == [3]
    # a null id comes first, so its "a" is the first one
    assert sorted((r.doc_id or 0, r.kept_lines) for r in rows) == [(0, ["a"]), (1, ["b"]), (1, ["b"]), (2, [])]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_near(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], groups(range(len(sets)), links)


def variant(words, share):
    out = list(words)
    for i in RANDOM.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = f"new{RANDOM.random()}"
    return " ".join(out)


@pytest.mark.parametrize(("tile", "shingles"), [(512, 1 << 20), (5, 400)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, tile, shingles):
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "TILE_SHINGLES", shingles)
    texts = []
    for _ in range(12):
        base = [f"w{RANDOM.randrange(400)}" for _ in range(RANDOM.choice([8, 60, 300]))]
        texts += [" ".join(base), " ".join(base).upper(), *(variant(base, s) for s in (0.01, 0.02, 0.03, 0.05)), " ".join(base[: len(base) * 4 // 5])]
    texts += ["", None, " \t\n", "One", "one ", "one two", "a b c d", "A B\nC D", "a b c d e", "É b c d e", "é b c d e", "a\x0bb\x1cc"]
    order = RANDOM.sample(range(len(texts)), len(texts))
    df = spark.createDataFrame([(i, texts[i], 1) for i in order], "doc_id long, text string, n_shingles int")
    sizes, low = brute_near(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == {i: (sizes[i], low[i], low[i] == i) for i in range(len(texts))}
    assert len(set(low.values())) < len(texts) - 20


def test_names_of_sets():
    texts = ["a b c d e f", "u v w x y z", "a b c", "A  b\nC", "one", None, "p q r s t u v w x y z 1 2 3"]
    names = near_dup.names(texts, near_dup.shingle_sets(texts))
    assert len({tuple(n) for n in names}) == 6 and (names[2] == names[3]).all() and len({int(n[1]) for n in names}) == 6


def test_near_duplicates_of_one_large_group(spark):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] * 100 + [variant(base, 0.01) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, low = brute_near(texts)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == low


def test_near_duplicate_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (None, "")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(df).collect()))
    assert rows == [(0, 0, 0, True), (0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 0), *((200, 201 + i) for i in range(300)), (7, 7)]
    RANDOM.shuffle(links)
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == groups({x for p in links for x in p}, links)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows(n=300, dim=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[i % 12] + rng.normal(size=dim) * 0.25).astype(np.float32).tolist(), i % 3) for i in range(n)]
    rows += [(n + i, rows[5][1], 2) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    rows += [(n + 30, None, 0), (n + 31, [0.0] * dim, 0), (n + 32, [nan] + [1.0] * (dim - 1), 0), (n + 33, [inf] * dim, 0), (n + 34, [None] + [1.0] * (dim - 1), 0), (n + 35, rows[0][1], None), (n + 36, [1.0, 2.0], 0), (n + 37, [2.0, 4.0], 0)]
    return rows


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("chunk", [16, 1024])
def test_vector_dedup_is_brute_force(spark, chunk):
    rows = vector_rows()
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if usable(v) and lab is not None]
    links = [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[:k] if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    low, n = groups([r[0] for r in rows], links), Counter(x for p in links for x in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.link_vectors(df, chunk=chunk).collect()}
    assert got == {i: (n[i], low[i], low[i] == i) for i, _, _ in rows} and len(links) > 200
    assert vector_dedup.link_vectors(df.limit(0)).count() == 0


def test_collisions_are_counted():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(200, 32)), rng.normal(size=(300, 32))
    b[:20] = a[:20] + rng.normal(size=(20, 32)) * 0.5
    near = np.abs(a[:, None] - b) <= 0.8
    half, whole = vector_dedup.needed_collisions(16, miss=0.005), vector_dedup.needed_collisions(32, miss=0.005)
    want = np.nonzero((near[:, :, :16].sum(axis=2) >= half) & (near.sum(axis=2) >= whole))
    got = vector_dedup.colliding_pairs(a, b, 0.8, miss=0.01)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] and len(got[0]) >= 10
    assert 15 <= vector_dedup.needed_collisions() <= 25


def test_few_chunks_of_spread_vectors_meet(spark):
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    tiles = {}
    for size in (10, 40):
        rows = [(i, (centres[i % 40] + rng.normal(size=40) * 0.01).tolist(), 1, 40, i) for i in range(40 * size)]
        df = spark.createDataFrame(rows, "node long, embedding array<double>, label int, dim int, copies int").withColumn("node", F.xxhash64("node"))
        placed = vector_dedup.chunked(df, 10)
        tiles[size] = vector_dedup.near_chunks(placed, 0.374).count()
        assert placed.count() == 40 * size and placed.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 10
    assert tiles[40] < tiles[10] * 12 and tiles[40] < (40 * 4) ** 2 / 2 / 2


@pytest.mark.parametrize("axes_sample", [0, 5_000])
def test_scaled_copies_fall_into_several_chunks(spark, monkeypatch, axes_sample):
    monkeypatch.setattr(vector_dedup, "AXES_SAMPLE", axes_sample)
    rows = [(i, [float(i + 1), 2.0 * (i + 1)], 0, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = vector_dedup.link_vectors(df, chunk=8).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)} and len(got) == 100


@pytest.mark.parametrize(("query_block", "block"), [(4, 32), (512, 4096)])
def test_nearest_is_brute_force(spark, query_block, block):
    rows = vector_rows()
    df = spark.createDataFrame([*rows, rows[20]], "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, float)) for i, v, _ in rows if usable(v)]
    want = {}
    for q, x in good:
        if q % 20 == 0:
            near = sorted((-np.einsum("i,i->", x, y), i) for i, y in good if i != q and len(x) == len(y))[:20]
            want[q] = near
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, query_block=query_block, block=block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near] or np.allclose([s for s, _ in got[q]], [s for s, _ in near], rtol=1e-12)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2.0)]
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_nearest(qid, q, cid, c, k):
    """By computing every product from left to right; what is no number ranks first."""
    out = []
    for i, x in zip(qid, q, strict=True):
        with np.errstate(all="ignore"):
            scores = [(float(np.cumsum(x * y)[-1]), n) for n, y in zip(cid, c, strict=True) if n != i]
        near = sorted(scores, key=lambda s: (not np.isnan(s[0]), -s[0] if s[0] == s[0] else 0, s[1]))[:k]
        out += [(i, n, repr(s)) for s, n in near]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_nearest_of_vectors_of_any_size(seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(150, 6)) * 10.0 ** rng.choice([-300.0, -200.0, -160.0, -10.0, 0.0, 3.0, 150.0, 200.0, 300.0], (150, 1))
    m[::7, 2] = 1e300
    m[::9, 1:] = 0
    m[5], m[6] = 5e-324, 1e308
    ids = np.arange(150)
    for part in (16, 1024):
        got = nearest.tile(ids[:30], m[:30], ids, m, 5, part)
        assert [(i, n, repr(s)) for i, n, s in got] == brute_nearest(ids[:30].tolist(), m[:30], ids.tolist(), m, 5)


def test_no_candidate_is_lost(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 0.0]), (2, [1.0, 1.0]), (20, [3.0, -1.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0, k=3).collect()
    assert Counter(r.query_id for r in got) == dict.fromkeys((0, 1, 2, 20), 3)
    assert {(r.query_id, r.vec_id): r.score for r in got}[0, 1] == 1.0


def test_vectors_of_any_size_link(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] * float(10.0 ** rng.choice([-300, -200, -30, 0, 30, 200, 300]))).tolist(), 1) for i in range(60)] + [(99, [5e-324] * 8, 1), (98, [1e308] * 8, 1)]
    got = {r.vec_id: (r.component_id, r.n_links) for r in vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), chunk=7).collect()}
    assert got == {**{i: (i % 6, 9) for i in range(60)}, 98: (98, 1), 99: (98, 1)}


def test_chunks_meet_by_the_cells_of_a_grid(spark):
    rng = np.random.default_rng(6)
    low = rng.uniform(-0.5, 0.5, (300, vector_dedup.AXES))
    high = low + rng.uniform(0, 0.6, low.shape) * (rng.random(low.shape) < 0.4)
    rows = [(1, 8, i, x.tolist()) for i in range(300) for x in (low[i], high[i])]
    got = vector_dedup.near_chunks(spark.createDataFrame(rows, "label int, dim int, chunk long, at array<double>"), 0.37).collect()
    gap = np.maximum(np.maximum(low[:, None] - high, low - high[:, None]), 0)
    want = {(i, j) for i in range(300) for j in range(i, 300) if (gap[i, j] ** 2).sum() <= 0.37**2}
    assert sorted((r.i, r.j) for r in got) == sorted(want) and 310 < len(want) < 20_000


def test_quantisation_bounds():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(5, 12)), rng.normal(size=(200, 12)) * rng.uniform(0.01, 100, (200, 1))
    got = nearest.tile(np.arange(5), q, np.arange(100, 300), c, 7)
    assert all(nearest.tile(np.arange(5), q, np.arange(100, 300), c, 7, part) == got for part in (2, 5, 64))
    for i in range(5):
        assert [n for k, n, _ in got if k == i] == [100 + j for j in np.argsort(-(c @ q[i]), kind="stable")[:7]]


def test_every_source_is_less_than_a_block_off_at_every_slot():
    weights = [1 / (i + 1) for i in range(1000)]
    share = np.array(weights) / sum(weights)
    n = np.zeros(1000)
    for i, _, slot in itertools.islice(mixing.block_slots(weights, [10_000] * 1000), 20_000):
        n[i] += 1
        assert slot + 1 == n.sum() and np.abs(n - share * (slot + 1)).max() < 1 + 1e-6


@pytest.mark.parametrize(
    ("weights", "blocks"),
    [
        ([5.0, 3.0, 1.0, 0.01], [3000, 2000, 900, 9]),
        ([1.0], [50]),
        ([50.0] + [1.0] * 2000, [900] + [2] * 2000),
        ([RANDOM.random() + 0.01 for _ in range(60)], [RANDOM.randrange(400) for _ in range(60)]),
    ],
)
def test_slots_are_less_than_a_block_off_the_target_weights(weights, blocks):
    total = sum(weights)
    seen, last = [], -1
    for i, j, slot in mixing.block_slots(weights, blocks):
        w = weights[i] / total
        assert slot > last and int(j / w - 1e-3) <= slot < (j + 1) / w + 1 + 1e-3  # the window of an error below one block
        seen.append((i, j))
        last = slot
    assert sorted(seen) == [(i, j) for i, n in enumerate(blocks) for j in range(n)]


def test_mix_is_less_than_a_block_off_the_target_weights(spark):
    sizes = {"hot": 6400} | {f"s{i}": 1 for i in range(1000)}
    df = spark.createDataFrame([(k, s) for s, n in sizes.items() for k in range(n)], "doc_id long, source string")
    share = 80 / (80 + 1000)
    for r in mixing.mix(df, block_rows=4).filter("source = 'hot'").collect():
        assert int(r.mix_block / share - 1e-3) <= r.mix_slot < (r.mix_block + 1) / share + 1


def test_empty_slots_are_passed_over():
    found = list(mixing.block_slots([1.0, 1e-9], [100, 100]))
    assert len(found) == 200 and found[-1][2] > 10**10
    assert [slot for i, _, slot in found if i == 0][-1] < 110
    assert sum(1 for _ in mixing.block_slots([3.0, 2.0, 1.0], [200_000] * 3)) == 600_000


def test_plan_is_written_in_pieces(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "a").otherwise("b").alias("source"))
    whole = sorted(map(tuple, mixing.mix(df, block_rows=2).collect()))
    monkeypatch.setattr(mixing, "PIECE", 7)
    assert sorted(map(tuple, mixing.mix(df, block_rows=2).collect())) == whole
    assert Counter(Counter((r[1], r[2]) for r in whole).values()) == {2: 500} and len({r[3] for r in whole}) == 500


def test_mix_keeps_every_row(spark):
    rows = [(i % 40 if i < 300 else i, RANDOM.choice(["hot"] * 5 + ["a", "b", None]), i) for i in range(500)] + [(None, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_n int")
    out = mixing.mix(df, block_rows=4).collect()
    assert Counter((r.doc_id, r.source, r.mix_n) for r in out) == Counter(rows)
    assert len({(r.mix_slot, r.mix_row) for r in out}) == len(rows)
    for s in {r.source or "" for r in out}:
        blocks = defaultdict(set)
        for r in out:
            if (r.source or "") == s:
                blocks[r.mix_block].add((r.mix_slot, r.mix_row))
        assert all(len({x[0] for x in b}) == 1 for b in blocks.values()) and [len(blocks[k]) for k in sorted(blocks)][:-1] == [4] * (len(blocks) - 1)
    assert mixing.mix(df.limit(0)).count() == 0
    named = spark.createDataFrame([("hot", 3.0)], "source string, weight double")
    assert mixing.mix(df, named, default_weight=1.0).count() == len(rows)
    with pytest.raises(ValueError):
        mixing.mix(df, spark.createDataFrame([("hot", 0.0)], "source string, weight double"))


def test_mix_refuses_sources_without_a_weight(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, source string")
    given = lambda *rows: spark.createDataFrame(list(rows), "source string, weight double")
    for w in (given(("a", 1.0), ("b", 1.0)), given(("a", 1.0), (None, 1.0))):
        with pytest.raises(ValueError, match="no target weight"):
            mixing.mix(df, w)
    assert mixing.mix(df, given(("a", 1.0), ("b", 2.0), (None, 1.0))).count() == 3


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "s", 7, {"k": 1})] * 3, "doc_id long, text string, source string, n int, m map<string,int>")
    odd = df.select("*", *(F.col("n").alias(c) for c in ("quota", "period", "slots", "slot", "mix_block", "turn", "weight")))
    assert [(r.quota, r.slots, r.m) for r in mixing.mix(odd).collect()] == [(7, 7, {"k": 1})] * 3
    odd = df.select("*", *(F.col("n").alias(c) for c in ("drop_bitmap", "kept_lines", "pos", "line", "key", "h1", "n_lines", "word")))
    assert [(r.pos, r.kept_lines, r.n_lines) for r in line_dedup.dedup_lines(odd).collect()] == [(7, ["a"], 1)] * 3
    odd = df.select("*", *(F.col("n").alias(c) for c in ("node", "key", "a", "b", "s", "component_id", "kept")))
    assert [tuple(r) for r in near_dup.near_duplicates(odd).collect()] == [(1, 1, 1, True)] * 3


def test_digest_of_kept_lines(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert line_dedup.op9_line_dedup(spark, str(tmp_path)).first().kept_sha256 == hashlib.sha256(b"a\nb").hexdigest()


def test_vectors_with_clashing_names(spark):
    rows = [(i, [1.0, float(i % 3)], 0) for i in range(9)] * 2 + [(None, [1.0, 0.0], 0), (50, None, None)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    odd = plain.select("*", *(F.lit("x").alias(c) for c in ("q", "c", "asks", "rank", "score", "query_id", "is_query", "dim", "copies", "first_id", "node", "chunk", "mine", "i", "j", "at", "sides", "slab", "kept", "n_links")))
    for op in (lambda d: nearest.nearest(d, F.col("vec_id") % 4 == 0, k=3), vector_dedup.link_vectors):
        want = Counter(map(tuple, op(plain).collect()))
        assert Counter(map(tuple, op(odd).collect())) == want and sum(want.values()) in (9, 20)
