"""Streams that begin where a batch ended, and state that grows by what is new."""

import numpy as np
from pyspark.sql import functions as F

from timedtext.operators import audio, recognize
from timedtext.operators import timeline as tl
from timedtext.streaming import operators as streams
from timedtext.streaming import windows
from timedtext.streaming.ordered import use_rocksdb

FRAMES = "rec long, seq long, pts long, n_samples long, delay long, tolerance long, transport boolean"


def through(spark, tmp_path, df, make, files=3):
    use_rocksdb(spark)
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    out = make(streams.stream_table(spark, str(tmp_path / "in"), df.schema))
    streams.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_a_timeline_goes_on_from_a_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(r, i + 1, None if rng.random() < 0.1 else int(i * 1024 + rng.choice([0, 900, -5000, 200_000])), 1024, 0, 1, r == 1) for r in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, FRAMES)
    first, rest = df.filter("seq <= 25 and rec < 2"), df.filter("seq > 25 or rec = 2")
    begin = streams.timeline_state(first)
    assert {r.rec: r.next for r in begin.collect()} == {0: 26, 1: 26}
    got = through(spark, tmp_path, rest, lambda s: streams.stream_align_timeline(s, begin=begin))
    take = lambda x: sorted(map(tuple, x.collect()))
    assert take(tl.align_timeline(first).union(got)) == take(tl.align_timeline(df))


def runs(x):
    """A segment for every run of equal samples."""
    edges = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    return "en", [(a / 16_000, b / 16_000, f"{x[a]:.0f}", 0.1) for a, b in zip(edges, edges[1:], strict=False)]


def sounds(spark, n=300):
    rng = np.random.default_rng(12)
    rows = [(r, i, float(v)) for r in ("a", "b", "c") for i, v in enumerate(np.repeat(rng.integers(0, 5, n), rng.integers(1, 9, n))[: n + ord(r) % 7])]
    blocks = audio.pcm_blocks(spark.createDataFrame(rows, "rec string, i long, x float"), 13)
    ends = blocks.groupBy("rec").agg(F.max(F.col("start_sample") + F.size("samples")).alias("start_sample")).withColumn("samples", F.array().cast("array<float>"))
    return blocks, blocks.unionByName(ends)


def cut(x):
    return len(x) - 2


def test_windows_go_on_from_a_batch(spark, tmp_path):
    blocks, closed = sounds(spark)
    whole = recognize.recognize_windows(blocks, runs, cut, 40, 3)
    done = whole.filter("idx < 4 and rec <> 'c'")
    begin = done.groupBy("rec").agg(F.max("end_sample").alias("samples"), F.count("*").alias("chunks"))
    places = {r.rec: r.samples for r in begin.collect()}
    # what is committed is not sent again, but for a block that is committed in part
    rest = closed.filter(" or ".join([f"(rec = '{r}' and (size(samples) = 0 or start_sample + size(samples) > {n}))" for r, n in places.items()] + ["rec = 'c'"]))
    got = through(spark, tmp_path, rest, lambda s: streams.stream_windows(s, runs, cut, 40, 3, begin=begin))
    take = lambda x: sorted(map(str, x.collect()))
    assert take(done.union(got)) == take(whole) and 0 < got.count() < whole.count()


class Value:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x


class Map:
    def __init__(self):
        self.d, self.written = {}, 0

    def containsKey(self, k):  # noqa: N802
        return k in self.d

    def getValue(self, k):  # noqa: N802
        return self.d[k]

    def updateValue(self, k, v):  # noqa: N802
        self.d[k] = v
        self.written += len(v[0])

    def removeKey(self, k):  # noqa: N802
        del self.d[k]


def test_the_tail_is_written_once():
    """In any order, with repeats: each sample goes into state once, and only a window's blocks stay there."""
    import pandas as pd

    x = np.repeat(np.arange(200) % 5, 7).astype(np.float32)
    names = ["rec", "idx", "start_sample", "end_sample", "silent", "whole", "recognized", "language", "segments"]
    plain = recognize.Windows(60, 3, runs, cut)
    want = [recognize.committed_row("r", w) for w in [*plain.push(x), *plain.finish()]]
    starts = list(range(0, len(x), 11))
    for seed in range(5):
        order = starts if seed == 0 else [s for k in range(0, len(starts), 6) for s in np.random.default_rng(seed).permutation(starts[k : k + 6]).tolist()]
        p = windows._Windows("rec", runs, cut, 60, 3, names, 0)
        p.state, p.blocks, got, most = Value(), Map(), [], 0
        for at in [*order, order[3], order[-1]]:
            rows = pd.DataFrame({"start_sample": [at, at], "samples": [x[at : at + 11].tolist()] * 2})
            for out in p.handleInputRows(("r",), iter([rows]), None):
                got += [tuple(r) for r in out.itertuples(index=False)]
            most = max(most, len(p.blocks.d))
        end = pd.DataFrame({"start_sample": [len(x)], "samples": [[]]})
        for out in p.handleInputRows(("r",), iter([end]), None):
            got += [tuple(r) for r in out.itertuples(index=False)]
        assert list(map(str, got)) == list(map(str, want))
        assert p.blocks.written == len(x) and most <= 60 // 11 + 8


def test_windows_of_rows_make_no_frames(monkeypatch):
    """Blocks as rows, with a start that is null, go in, and rows come out, without a frame for each recording."""
    from pyspark.sql import Row

    x = np.repeat(np.arange(200) % 5, 7).astype(np.float32)
    names = ["rec", "idx", "start_sample", "end_sample", "silent", "whole", "recognized", "language", "segments"]
    plain = recognize.Windows(60, 3, runs, cut)
    want = [recognize.committed_row("r", w) for w in [*plain.push(x), *plain.finish()]]
    monkeypatch.setattr(windows.pd, "DataFrame", None)
    p = windows._RowWindows("rec", runs, cut, 60, 3, names, 0)
    p.state, p.blocks, got = Value(), Map(), []
    calls = [[Row(start_sample=at, samples=x[at : at + 11].tolist()) for at in (k + 11, k) if at < len(x)] for k in range(0, len(x), 22)]
    for rows in [*calls, [Row(start_sample=None, samples=None), Row(start_sample=len(x), samples=[])]]:
        got += list(p.handleInputRows(("r",), iter(rows), None))
    assert all(list(r.__fields__) == names for r in got) and list(map(str, map(tuple, got))) == list(map(str, want))
    assert not p.blocks.d


class Calls(Map):
    """A map that counts what is asked of it."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def containsKey(self, k):  # noqa: N802
        self.calls += 1
        return k in self.d

    def updateValue(self, k, v):  # noqa: N802
        self.calls += 1
        self.d[k] = v


def test_calls_to_the_state_do_not_follow_the_rows():
    import pandas as pd
    from pyspark.sql import types as T

    from timedtext.streaming import ordered

    row = T.StructType([T.StructField("rec", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("x", T.LongType())])
    state = T.StructType([T.StructField("sum", T.LongType())])
    step = lambda s, r: ((s[0] + (r[2] or 0),), [(r[0], int(r[1]), s[0] + (r[2] or 0))])
    n = 2000
    for order in (list(range(1, n + 1)), list(range(n, 0, -1)), np.random.default_rng(3).permutation(np.arange(1, n + 1)).tolist()):
        p = ordered._Ordered(["rec", "seq", "x"], 1, 1, lambda r: int(r[1]) + 1, lambda: (0,), step, ["rec", "seq", "sum"], 0, row, state)
        p.state, p.held, got = Value(), Calls(), []
        for part in np.array_split(order, 4):
            rows = pd.DataFrame({"rec": 7, "seq": [*part, part[0]], "x": [None if k % 5 == 0 else float(k) for k in [*part, part[0]]]})
            for out in p.handleInputRows((7,), iter([rows]), None):
                got += [tuple(r) for r in out.itertuples(index=False)]
        assert [(int(r), int(k), int(s)) for r, k, s in got] == [(7, k, sum(i for i in range(1, k + 1) if i % 5)) for k in range(1, n + 1)]
        assert not p.held.d and p.held.calls <= 4 * 2 * (n // 2**ordered.BITS + 2)


def test_publishing_writes_a_file_a_bucket(spark, tmp_path):
    df = spark.range(0, 3000, 1, 6).selectExpr("concat('r', id % 1500) as rec", "'srt' as format", "cast(id % 1500 as string) as content")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for content, differs in (("content", 0), ("concat(content, if(rec = 'r7', '!', ''))", 1)):
            changed = streams.publish_batch(df.selectExpr("rec", "format", f"{content} as content"), str(tmp_path / "out"))
            assert changed.count() == differs
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1500
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= streams.BUCKETS
