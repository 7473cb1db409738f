"""Parallel forms against the serial ones."""

import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timedtext.operators import audio, paragraphs, recognize, scan
from timedtext.operators import timeline as tl
from timedtext.sources import media

FRAMES = "rec long, seq long, pts long, n_samples long, delay long, tolerance long, transport boolean"
frame = st.tuples(st.one_of(st.none(), st.integers(-400_000, 900_000)), st.sampled_from([None, 0, 700, 1024]), st.sampled_from([None, 0, 9]), st.sampled_from([None, 1, 4000, 200_000]), st.booleans())


def serial(frames, gaps):
    state, states, out = None, [], []
    for f in frames:
        states.append(state)
        state, placed = tl.place_frame(state, *f, gaps)
        out.append(placed)
    return [*states, state], out


def same(a, b):
    """One state of a timeline, whose end is 0 as long as there is none."""
    return (a is None) == (b is None) and (a is None or ((a[0] or 0), a[1]) == ((b[0] or 0), b[1]))


@given(st.lists(frame, min_size=1, max_size=60), st.sampled_from([1, 7, 1000]), st.sampled_from(["auto", "preserve"]))
@settings(max_examples=400, deadline=None)
def test_blocks_of_a_timeline(frames, size, gaps):
    states, _ = serial(frames, gaps)
    state = None
    for at in range(0, len(frames), size):
        assert same(state, states[at])
        state = tl.timeline_after(state, tl.timeline_sums([(0, 0, *f) for f in frames[at : at + size]], gaps))
    assert same(state, states[-1])


def drifting(n, seed):
    """Frames with jitter, jumps to and fro, and lost timestamps."""
    rng = np.random.default_rng(seed)
    ideal = np.arange(n) * 1024
    pts = ideal + rng.integers(-1500, 1500, n) + np.where(rng.random(n) < 0.02, rng.choice([-60_000, 30_000, 190_000], n), 0)
    return [(None if rng.random() < 0.1 else int(p), 1024, 0, 1, bool(seed % 2)) for p in pts]


@pytest.mark.parametrize("bits", [0, 3, 7])
def test_long_recordings_are_placed_in_blocks(spark, bits):
    recs = {r: drifting(n, r) for r, n in ((1, 700), (2, 900), (3, 4), (4, 1))}
    recs[5] = [(0, 10, 0, 1, False), (2**61, 10, 0, 1, False), (20, 10, 0, 1, False)] * 10  # out of range
    recs[6] = [(0, 1000, 0, 1, False), (500, 10, -600, 1, False)] * 40  # a negative delay
    rows = [(r, i, *f) for r, frames in recs.items() for i, f in enumerate(frames)]
    got = tl.align_timeline(spark.createDataFrame(rows, FRAMES).repartition(5), bits=bits)
    found = {(x.rec, x.seq): tuple(x)[2:6] for x in got.collect()}
    assert found == {(r, i): p for r, frames in recs.items() for i, p in enumerate(serial(frames, "auto")[1])}


line = st.tuples(st.sampled_from([0.0, 0.5, 2.0, 3.0, None, float("nan")]), st.sampled_from(["en", "en", "en", "ru", None]), st.sampled_from([1, 90, 200, 599, 700]), st.booleans())


@given(st.lists(line, min_size=1, max_size=60), st.sampled_from([1, 3, 30]))
@settings(max_examples=100, deadline=None)
def test_blocks_of_paragraphs(lines, size):
    t, rows = 0.0, []
    for pause, language, n, ends in lines:
        start = None if pause is None else t + pause
        t += 4.0
        rows.append((0, len(rows), start, t, language, n, ends))
    state = block = (0, False, None, None, 0)
    for i, row in enumerate(rows):
        if i % size == 0:
            assert repr(tuple(block)) == repr(state)
            block = paragraphs.count_after(block, paragraphs.count_sums(rows[i : i + size], 2000), 2000)
        state, _ = paragraphs.count_step(state, row, 2000)
    assert repr(tuple(block)) == repr(state)


@pytest.mark.parametrize("bits", [2, 5])
def test_long_transcripts_are_broken_in_blocks(spark, bits):
    rng = np.random.default_rng(7)
    rows, t = [], 0.0
    for i in range(400):
        start = t + float(rng.choice([0.0, 0.5, 2.5], p=[0.6, 0.37, 0.03]))
        t = start + 1.0
        rows.append(("r", i, start, t, " " if rng.random() < 0.1 else "x" * int(rng.integers(1, 200)) + str(rng.choice([".", ""])), "en" if rng.random() < 0.98 else "ru"))
    df = spark.createDataFrame([*rows, ("short", 0, 0.0, 1.0, "a.", "en")], "rec string, seq long, start_s double, end_s double, text string, language string")
    take = lambda bits: sorted((r.rec, r.seq, r.breaks, r.paragraph) for r in paragraphs.paragraphs(df, 2000, bits=bits).collect())
    got = take(bits)
    assert got == take(13) and len({r[3] for r in got}) > 20
    hard = {r.seq for r in paragraphs.paragraph_breaks(df, 2000).filter("hard").collect()}
    assert hard <= {r[1] for r in got if r[2]}


def test_a_recording_is_many_tasks(spark):
    """All rows of one recording, and no task with more than some blocks of it."""
    rows = spark.range(40_000).select(F.lit(1).alias("rec"), F.col("id").alias("seq"), (F.col("id") * 1024).alias("pts"), F.lit(1024).alias("n_samples"), F.lit(0).alias("delay"), F.lit(1).alias("tolerance"), F.lit(False).alias("transport"))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        placed = tl.align_timeline(rows, bits=10)
        by_task = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(by_task) == 40_000 and len(by_task) == 4 and max(by_task) < 20_000
    assert placed.filter("start <> seq * 1024").count() == 0
    assert scan.BITS == 13


def bursts(x):
    """A segment for every run of sound, as pauses part them."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (x != 0).astype(int), [0]])))
    return "en", [(a / 16_000, b / 16_000, f"{x[a]:.2f}", 0.1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def sound(n, seed, pauses=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0.1, 1, n), 2).astype(np.float32)
    at = 0
    while pauses and at < n:
        at += int(rng.integers(3, 15))
        x[at : at + 2] = 0
        at += 2
    return x


@pytest.mark.parametrize(("region", "rounds"), [(40, 8), (60, 8), (40, 0), (40, 1)])
def test_windows_in_regions_are_those_in_a_row(spark, region, rounds):
    recs = {"a": sound(700, 1), "b": sound(333, 2), "c": sound(20, 3), "quiet": np.zeros(200, np.float32), "loud": sound(300, 4, pauses=False), "d": sound(40, 5)}
    rows = [(r, i, float(v)) for r, x in recs.items() for i, v in enumerate(x)]
    blocks = audio.pcm_blocks(spark.createDataFrame(rows, "rec string, i long, x float"), 17)
    want = sorted(map(tuple, recognize.recognize_windows(blocks, bursts, lambda x: len(x) - 3, 32, 4).collect()))
    got = recognize.recognize_in_regions(blocks, bursts, lambda x: len(x) - 3, 32, 4, region, rounds).collect()
    assert sorted(tuple(r)[:-1] for r in got) == want
    if rounds == 8:
        assert 0 < sum(r.redone for r in got) < len(got)


def wav(x, rate, channels=1, bits=16, riff=b"RIFF", size=None):
    data = np.asarray(x, f"<i{bits // 8}").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH", riff, 0, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return head + struct.pack("<4sI", b"LIST", 3) + b"abc\0" + struct.pack("<4sI", b"data", len(data) if size is None else size) + data


@pytest.mark.parametrize(("rate", "channels"), [(16_000, 1), (48_000, 2), (44_100, 1), (8000, 2)])
@pytest.mark.parametrize("size", [1000, 7777, 10**9])
def test_ranges_of_a_file_give_its_samples(spark, tmp_path, rate, channels, size):
    rng = np.random.default_rng(rate)
    for name, n in (("long", 9001), ("short", 3), ("none", 0)):
        (tmp_path / f"{name}.wav").write_bytes(wav(rng.integers(-3000, 3000, n * channels), rate, channels))
    whole = lambda rows: {r.rec.rsplit("/", 1)[-1]: r.samples for r in rows.groupBy("rec").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_sample", "samples"))), lambda x: x["samples"])).alias("samples")).collect()}
    got = media.read_wav(spark, str(tmp_path), "*.wav", range_bytes=size, block=256)
    want = media.read_media(spark, str(tmp_path), "*.wav", block=256)
    a, b = whole(got), whole(want)
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)
    assert len(a["long.wav"]) == -(-9001 * 16_000 // rate) and got.filter(F.size("samples") > 256).count() == 0
    assert got.rdd.getNumPartitions() >= min(20, 9001 * channels * 2 // size)


def test_file_of_more_than_two_gigabytes(spark, tmp_path):
    """A sparse file; ranges far behind the first are read on their own."""
    path, frames = tmp_path / "big.wav", 1_200_000_000
    with path.open("wb") as f:
        f.write(wav([], 16_000, size=0xFFFFFFFF))
        head = f.tell()
        f.seek(head + 2 * 1_150_000_000)
        f.write(np.arange(1, 6, dtype="<i2").tobytes())
        f.truncate(head + 2 * frames)
    reader = media.WavRanges({"path": str(path), "range_bytes": str(64 << 20), "block": "65536"}).reader(None)
    parts = reader.partitions()
    assert len(parts) == 36
    place = 2 * 1_150_000_000 // (64 << 20)
    found = [(s, np.asarray(x)) for b in reader.read(parts[place]) for s, x in zip(b.column("start_sample").to_pylist(), b.column("samples"), strict=True) for x in [x.values]]
    assert sum(len(x) for _, x in found) == (64 << 20) // 2
    start, x = next((s, x) for s, x in found if x.any())
    at = int(np.flatnonzero(x)[0])
    assert start + at == 1_150_000_000 and (x[at : at + 5] * 32_768).tolist() == [1, 2, 3, 4, 5]
    last = [b for b in reader.read(parts[-1])]
    assert last[-1].column("start_sample")[-1].as_py() + len(last[-1].column("samples")[-1]) == frames


def test_small_ranges_share_tasks(tmp_path):
    """Their number follows neither that of files nor that of ranges, and nothing is read twice or left out."""
    for i in range(900):
        (tmp_path / f"{i}.wav").write_bytes(wav(np.full(100, i), 16_000))
    reader = media.WavRanges({"path": str(tmp_path), "range_bytes": "64", "block": "12"}).reader(None)
    parts = reader.partitions()
    assert len(parts) <= 1.2 * media.TASKS
    seen = {}
    for part in parts:
        for b in reader.read(part):
            for rec, start, x in zip(*(b.column(c).to_pylist() for c in ("rec", "start_sample", "samples")), strict=True):
                assert len(x) <= 12 and set(x) == {int(rec.rsplit("/", 1)[1][:-4]) / 32_768}
                seen.setdefault(rec, []).extend(range(start, start + len(x)))
    assert len(seen) == 900 and all(sorted(x) == list(range(100)) for x in seen.values())


@settings(max_examples=1, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.just(0))
def test_wav_that_is_none(spark, tmp_path, _):
    (tmp_path / "x.wav").write_bytes(b"no sound")
    with pytest.raises(Exception, match="WAV"):
        media.read_wav(spark, str(tmp_path)).collect()


def test_sums_of_a_block_of_paragraphs_are_small():
    rng = np.random.default_rng(4)
    rows = [("r", i, float(i), i + 3 * rng.random(), "en" if rng.random() < 0.8 else "ru", int(rng.integers(0, 300)), bool(rng.random() < 0.7)) for i in range(4096)]
    for size in (16, 4096):
        assert sum(len(x) * (1 if isinstance(x, bytes) else 8) for x in paragraphs.count_sums(rows[:size], 2000)[:2]) < 2048
