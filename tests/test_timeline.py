"""Golden cases of timelines, decoder damage, cuts and windows; the folds against plain loops."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timedtext.operators import audio, cuts, recognize
from timedtext.operators import timeline as tl

FRAMES = "rec long, seq long, pts long, n_samples long, delay long, tolerance long, transport boolean"


def place(frames, gaps="auto", transport=False):
    """(start, discontinuity, reset) of frames (pts, n) through the step function."""
    state, out = None, []
    for pts, n in frames:
        state, placed = tl.place_frame(state, pts, n, 0, 1, transport, gaps)
        out.append(placed[:3])
    return out


def test_jitter_and_gaps():
    assert place([(0, 1000), (2600, 10)])[1] == (1000, False, False)
    assert place([(0, 1000), (2601, 10)])[1] == (2601, True, False)
    assert place([(0, 1000), (-601, 10)])[1] == (1000, True, True)
    assert place([(0, 1000), (161_000, 10)], transport=True)[1] == (161_000, True, False)
    assert place([(0, 1000), (161_001, 10)], transport=True)[1] == (1000, True, True)
    assert place([(0, 1000), (161_001, 10)], "preserve", True)[1] == (161_001, True, False)
    assert place([(5, 1000), (None, 10)]) == [(5, True, False), (1005, False, False)]


def test_frames_without_samples_and_out_of_range():
    assert place([(0, 1000), (50_000, 0), (1000, 10)]) == [(0, False, False), (50_000, True, False), (1000, False, False)]
    # what has no samples does not begin the timeline, but its timestamp is the first
    assert place([(500, 0), (700, 10), (710, 5)]) == [(500, True, False), (0, False, False), (10, False, False)]
    assert place([(0, 1000), (2**62, 10), (1000, 10)]) == [(0, False, False), (None, None, None), (1000, False, False)]
    assert place([(0, None), (0, 10)])[1] == (0, False, False)
    with pytest.raises(ValueError, match="out of range"):
        tl.place_frame((0, 0), 2**62, 1, 0, 1, False, "auto", strict=True)


@pytest.mark.parametrize("ppm", [20, 100, 1000])
def test_slow_clock_loses_nothing(ppm):
    state, resets, total = None, 0, 0
    for i in range(60_000):
        state, (start, _, reset, _) = tl.place_frame(state, i * 1600 * (1_000_000 - ppm) // 1_000_000, 1600, 0, 1, False, "auto")
        resets += reset
        assert start == total
        total += 1600
    assert state[0] == total and 0 < resets < 60


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-5000, 400_000)), st.integers(1, 3000)), max_size=40))
def test_align_timeline_is_the_loop(spark, rows):
    seq, data = {}, []
    for rec, pts, n in rows:
        seq[rec] = seq.get(rec, 0) + 1
        data.append((rec, seq[rec], pts, n, 0, 1, rec == 1))
    got = {(r.rec, r.seq): (r.start, r.discontinuity, r.reset) for r in tl.align_timeline(spark.createDataFrame(data, FRAMES)).collect()}
    for rec in seq:
        own = [(d[2], d[3]) for d in data if d[0] == rec]
        assert [got[rec, i + 1] for i in range(len(own))] == place(own, transport=rec == 1)


def budget(events, strict, limit):
    spent, damaged, stuck = 0.0, False, 0
    for i, (kind, seconds, code) in enumerate(events):
        error = kind == "error" and code == -22
        if kind == "packet":
            stuck, spent = 0, spent + (seconds if seconds and seconds > 0 and np.isfinite(seconds) else 0)
        elif kind == "frame":
            spent, damaged, stuck = 0.0, False, 0
        elif error:
            if strict:
                return i, "strict"
            damaged, stuck = True, stuck + 1
            if stuck >= tl.STALLED:
                return i, "stalled"
        if limit and damaged and spent >= limit and (error or kind == "await"):
            return i, "time"
    return None


def test_events_are_sorted_once_without_a_time_rule(spark):
    n = tl.STALLED
    kinds = ["error"] * (n - 1) + ["packet"] + ["error"] * (n - 1) + ["await", "other", None, "error", "error"]
    events = spark.createDataFrame([(1, i, k, None, -22) for i, k in enumerate(kinds)] + [(2, i, "error", None, -11) for i in range(n)], "rec long, seq long, kind string, seconds double, code int")
    got = tl.decode_budget(events.repartition(3), limit_s=0)
    assert [tuple(r) for r in got.collect()] == [(1, 2 * n + 2, "stalled")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    windows = {line.split("windowspecdefinition(")[1].split("specifiedwindowframe")[0] for line in plan.splitlines() if "windowspecdefinition(" in line}
    assert len(windows) == 1


def test_decode_budget_is_the_loop(spark):
    rng = np.random.default_rng(5)
    data, want = [], {}
    for rec in range(40):
        events = [(k, float(rng.choice([0.5, 1.0, -1.0, np.inf, np.nan])) if k == "packet" else None, int(rng.choice([-22, -11])) if k == "error" else 0) for k in rng.choice(["packet", "frame", "error", "await"], 60, p=[0.4, 0.05, 0.3, 0.25])]
        data += [(rec, i, *e) for i, e in enumerate(events)]
        if hit := budget(events, False, 5):
            want[rec] = hit
    data += [(99, i, "error", None, -22) for i in range(1024)]
    want[99] = (1023, "stalled")
    got = {r.rec: (r.seq, r.reason) for r in tl.decode_budget(spark.createDataFrame(data, "rec long, seq long, kind string, seconds double, code int"), limit_s=5).collect()}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("rate", [1, 50, 100])
def test_budget_does_not_depend_on_the_packet_rate(spark, rate):
    events = [e for _ in range(40 * rate) for e in (("await", None, 0), ("packet", 1 / rate, 0), ("error", None, -22))]
    rows = spark.createDataFrame([(0, i, *e) for i, e in enumerate(events)], "rec long, seq long, kind string, seconds double, code int")
    assert abs(tl.decode_budget(rows, limit_s=30).first().seq - 90 * rate) <= 3


def plain_pause(n, speech, least):
    """By trying every silence of a window; null where the intervals are wrong."""
    edges = [0, *(x for s in sorted(speech) for x in s), n]
    if any(a > b for a, b in zip(edges, edges[1:], strict=False)):
        return None
    silences = list(zip(edges[::2], edges[1::2], strict=True))
    middles = [a + (b - a) // 2 for a, b in silences if b > a and b - a >= least]
    return max([m for m in middles if n * 3 // 4 <= m < n], default=n)


def test_pause_cut_is_the_loop(spark):
    rng = np.random.default_rng(21)
    speech, windows = {}, {}
    for w in range(150):
        n = windows[w] = int(rng.integers(50, 900))
        edges = np.sort(rng.choice(np.arange(n + 1), 2 * int(rng.integers(0, 6)), replace=False)).tolist()
        speech[w] = list(zip(edges[::2], edges[1::2], strict=True))
        if w % 10 == 0 and speech[w]:
            a, b = speech[w][-1]
            speech[w][-1] = [(a, n + 1), (b, a), (speech[w][0][0] - 1, b)][w // 10 % 3]
    rows = spark.createDataFrame([("r", w, a, b) for w, x in speech.items() for a, b in x], "rec string, win long, start_sample long, end_sample long")
    df = spark.createDataFrame([("r", w, n) for w, n in windows.items()], "rec string, win long, n_samples long")
    want = {w: plain_pause(n, speech[w], 3 * 16) for w, n in windows.items()}
    assert {r.win: r.cut for r in cuts.pause_cut(rows, df, 3).collect()} == want
    assert sum(x is None for x in want.values()) >= 5 and sum(x != windows[w] for w, x in want.items() if x is not None) > 20
    with pytest.raises(Exception, match="invalid speech"):
        cuts.pause_cut(rows, df, 3, strict=True).collect()


def plain_cut(n, preferred, segments, guard):
    """By trying every end of a segment."""
    if not 0 < preferred <= n:
        return None
    found = n
    for i in range(len(segments)):
        end = max(b for _, b in segments[: i + 1])
        at = int(np.ceil(end * 16_000))
        later = [a for a, _ in segments[i + 1 :]]
        if 0 < at <= min(preferred, max(n - guard, 0)) and all(a >= at / 16_000 for a in later):
            found = at
    return found


def test_safe_cut_is_the_loop(spark):
    rng = np.random.default_rng(22)
    cases = []
    for w in range(150):
        n = int(rng.integers(1, 80)) * 1000
        starts = np.sort(rng.integers(0, n + 1, int(rng.integers(0, 7))))
        segments = [(a / 16_000, min(n, a + int(rng.integers(0, 20_000))) / 16_000) for a in starts.tolist()]
        cases.append((w, n, int(rng.integers(-1000, n + 1000)) if w % 5 else n, int(rng.integers(0, n)), segments))
    windows = spark.createDataFrame([("r", w, n, p, g) for w, n, p, g, _ in cases], "rec string, win long, n_samples long, preferred long, guard long")
    rows = spark.createDataFrame([("r", w, i, a, b) for w, *_, x in cases for i, (a, b) in enumerate(x)], "rec string, win long, seq long, start_s double, end_s double")
    want = {w: plain_cut(n, p, x, g) for w, n, p, g, x in cases}
    assert {r.win: r.cut for r in cuts.safe_cut(rows, windows).collect()} == want
    assert sum(x is None for x in want.values()) > 3 and sum(want[w] not in (None, n) for w, n, *_ in cases) > 20
    for w, n, p, g, x in cases:
        if want[w] is not None:
            assert recognize.boundary(n, p, [(a, b, "", 0.0) for a, b in x], g) == want[w]
        else:
            with pytest.raises(ValueError, match="no such boundary"):
                recognize.boundary(n, p, [(a, b, "", 0.0) for a, b in x], g)


def test_audio_that_is_too_short(spark):
    done = spark.createDataFrame([("r", 100, 4), ("gone", 0, 0), ("none", 5, 1)], "rec string, samples long, chunks long")
    short = blocks(spark, [1.0] * 35)
    with pytest.raises(Exception, match="before the committed place"):
        recognize.recognize_windows(short, fake, len, 16, 4, done).collect()
    found = recognize.short_recordings(short, done)
    assert {(r.rec, r.reason) for r in found.collect()} == {("r", "short"), ("gone", "empty"), ("none", "short")}


def test_wide_tolerance_snaps_before_a_reset():
    state, _ = tl.place_frame(None, 0, 1000, 0, 1, True, "auto")
    assert tl.place_frame(state, 171_000, 10, 0, 200_000, True, "auto")[1] == (1000, False, False, 1010)
    assert tl.place_frame(state, 201_001, 10, 0, 200_000, True, "auto")[1] == (1000, True, True, 1010)


@pytest.mark.parametrize("times", [(float("nan"), 1.0), (0.0, float("inf")), (-0.1, 1.0), (1.0, 0.5), (0.0, 4.1)])
def test_times_outside_the_window_are_refused(times):
    with pytest.raises(ValueError):
        recognize.boundary(64_000, 64_000, [(*times, "x", 0.0)], 0)
    w = recognize.Windows(64_000, 0, lambda x: ("en", [(*times, "x", 0.0)]), len)
    with pytest.raises(ValueError):
        list(w.push(np.ones(64_000, np.float32)))
    w = recognize.Windows(80_000, 0, lambda x: ("en", [(*times, "x", 0.0)]), len)
    with pytest.raises(ValueError):
        list(w.push(np.ones(64_000, np.float32))) + list(w.finish())


def test_windows_with_times_outside_have_no_cut(spark):
    windows = spark.createDataFrame([("r", i, 64_000, 64_000, 0) for i in range(7)], "rec string, win long, n_samples long, preferred long, guard long")
    times = [(float("nan"), 1.0), (0.0, float("inf")), (-0.1, 1.0), (1.0, 0.5), (0.0, 4.1), (0.0, 2.0)]
    rows = spark.createDataFrame([("r", i, k, *t) for i, x in enumerate(times) for k, t in enumerate([x, (2.0, 4.0)])], "rec string, win long, seq long, start_s double, end_s double")
    assert {r.win: r.cut for r in cuts.safe_cut(rows, windows).collect()} == {**dict.fromkeys(range(5)), 5: 64_000, 6: 64_000}
    with pytest.raises(Exception, match="not within its window"):
        cuts.safe_cut(rows, windows, strict=True).collect()


def fake(samples):
    step = 4
    return "en", [(i / 16_000, min(i + step, len(samples)) / 16_000, f"s{i}", 0.0) for i in range(0, len(samples), step)]


def blocks(spark, samples):
    df = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(samples)], "rec string, i long, x float")
    return audio.pcm_blocks(df, 7)


def test_windowed_fold_and_resume(spark):
    run = lambda m=None: recognize.recognize_windows(blocks(spark, [1.0] * 35), fake, lambda x: len(x) - 4, 16, 4, m).orderBy("idx").collect()
    rows = run()
    assert rows[0].end_sample == 12 and sum(r.recognized for r in rows) == 43 and sum(len(r.segments) for r in rows) == 9 and rows[-1].end_sample == 35
    again = run(spark.createDataFrame([("r", 12, 1)], "rec string, samples long, chunks long"))
    assert sum(r.recognized for r in again) == 27 and [r[1:] for r in again] == [r[1:] for r in rows[1:]]


def test_silence(spark):
    rows = recognize.recognize_windows(blocks(spark, [-0.0] * 35), fake, lambda x: len(x) - 4, 16, 4).collect()
    assert len(rows) == 3 and all(r.silent and not r.segments for r in rows)
    for x in (1e-12, 1e-45, float("nan")):
        assert recognize.recognize_windows(blocks(spark, [0.0, x]), fake, len, 16, 4).first().recognized == 2
    d = spark.createDataFrame([([-0.0, 0.0],), ([],), ([float("nan")],), ([1e-45],)], "s array<float>").select(audio.digital_silence("s"))
    assert [r[0] for r in d.collect()] == [True, False, False, False]


def test_overlapping_windows_cover_all(spark):
    rows = recognize.recognize_overlapping(blocks(spark, [1.0] * 50), fake, 16, 8).orderBy("seq").collect()
    assert [round(r.start_s * 16_000) for r in rows] == list(range(0, 50, 4))
    assert recognize.overlapping_windows(blocks(spark, list(range(50))), 16, 8).filter(F.col("win") == 1).first().samples == [float(x) for x in range(8, 24)]


def test_windows_are_recognized_in_batches(spark):
    samples = np.where(np.arange(90) // 10 % 4 == 1, 0.0, 1.0).tolist()
    sizes = []
    windows = [np.array(x, np.float32) for x in ([1, 1], [0, 0], [1], [2, 2, 2], [0], [3])]
    found = recognize.in_batches(lambda xs: sizes.append(len(xs)) or [(str(len(x)), []) for x in xs], windows, 3)
    assert [x for x, _ in found] == ["2", "", "1", "3", "", "1"] and sizes == [3, 1]
    one = recognize.recognize_overlapping(blocks(spark, samples), fake, 16, 8)
    many = recognize.recognize_overlapping(blocks(spark, samples), lambda xs: [fake(x) for x in xs], 16, 8, batch=3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    with pytest.raises(ValueError):
        recognize.recognize_overlapping(blocks(spark, samples), fake, 16, 8, batch=0)


def test_recognizers_have_a_place_of_their_own(spark):
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    profile = ResourceProfileBuilder().require(ExecutorResourceRequests().cores(4).resource("gpu", 1)).require(TaskResourceRequests().cpus(4).resource("gpu", 1)).build
    df = recognize.recognize_overlapping(blocks(spark, [1.0] * 30), fake, 16, 8, profile=profile)
    todo, found = [df._jdf.queryExecution().analyzed()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "MapInArrow":
            found.append(node.profile().isDefined())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert found == [True]


def test_clip_intervals_over_cells(spark):
    rng = np.random.default_rng(8)
    speech = [("r", int(a), int(a + n)) for a, n in zip(rng.integers(0, 500, 60), rng.integers(1, 120, 60), strict=True)]
    windows = [("r", i, i * 37, 50) for i in range(15)]
    got = cuts.clip_intervals(spark.createDataFrame(speech, "rec string, start_sample long, end_sample long"), spark.createDataFrame(windows, "rec string, win long, from_sample long, n_samples long"), cell=20)
    want = sorted((w, max(a - f, 0), min(b - f, n)) for _, a, b in speech for _, w, f, n in windows if a < f + n and b > f)
    assert sorted(tuple(r)[1:] for r in got.collect()) == want
