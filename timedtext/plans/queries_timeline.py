"""Queries on frames, timelines, cuts and windows. Q: name to (query on the views, DuckDB SQL or None)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from timedtext.functions import text as t
from timedtext.operators import audio, cuts, recognize
from timedtext.operators import timeline as tl
from timedtext.operators.fold import fold

MIN_SILENCE_MS, GRID_S = 500, 30
ALIGNED = """
  f AS MATERIALIZED (SELECT * FROM frames_v), st AS (
    SELECT rec, seq, n_samples, coalesce(pts, delay)::BIGINT AS s, coalesce(pts, delay) <> delay AS disc, false AS rs,
           CASE WHEN n_samples > 0 THEN (coalesce(pts, delay) + n_samples)::BIGINT END AS pos, 0::BIGINT AS sh
    FROM f WHERE seq = 1
    UNION ALL
    SELECT rec, seq, n_samples, s2, rst OR s2 <> e, rst, CASE WHEN n_samples > 0 THEN greatest(pos, s2 + n_samples) ELSE pos END, CASE WHEN rst THEN sh - d ELSE sh END
    FROM (SELECT *, CASE WHEN snap OR rst THEN e ELSE e + d END AS s2
      FROM (SELECT *, d BETWEEN -j AND j AS snap, d < -j OR ({auto}transport AND d > 160000) AS rst
        FROM (SELECT f.rec, f.seq, f.n_samples, f.transport, st.pos, st.sh, coalesce(st.pos, 0) + f.delay AS e,
                     coalesce(f.pts + st.sh - (coalesce(st.pos, 0) + f.delay), 0) AS d, greatest(1600, f.tolerance) AS j
              FROM st JOIN f ON f.rec = st.rec AND f.seq = st.seq + 1))))"""
ORIGIN = """
  b AS (SELECT rec, seq, pts - delay - coalesce(sum(n_samples) OVER (PARTITION BY rec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM frames_v),
  o AS (SELECT rec, CAST(arg_min(place, seq) FILTER (WHERE place IS NOT NULL) AS BIGINT) AS origin FROM b GROUP BY rec)"""
SHOWN = "SELECT rec, seq, s AS start, disc AS discontinuity, rs AS reset, coalesce(pos, 0) AS timeline_end FROM st"
#: Decoder events in order, as three of each frame.
SECONDS = """
  p AS (SELECT *, last_value(CASE WHEN code >= 0 AND n_samples > 0 THEN n_samples / 16000.0::DOUBLE END IGNORE NULLS)
                    OVER (PARTITION BY rec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_frame_seconds FROM frames_v),
  q AS (SELECT *, coalesce(CASE WHEN packet_seconds > 0 THEN packet_seconds END, last_frame_seconds, 0.0::DOUBLE) AS seconds FROM p)"""
EVENTS = SECONDS + """,
  e AS (SELECT rec, seq * 3 + i AS seq, CASE i WHEN 0 THEN 'await' WHEN 1 THEN 'packet' ELSE CASE WHEN code < 0 THEN 'error' ELSE 'frame' END END AS kind,
               CASE WHEN i = 1 THEN seconds END AS seconds FROM q, (SELECT unnest([0, 1, 2]) AS i))"""
BUDGET = """,
  g AS (SELECT *, count(*) FILTER (WHERE kind = 'frame') OVER w AS frames FROM e WINDOW w AS (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT *, coalesce(sum(seconds) FILTER (WHERE kind = 'packet' AND seconds > 0) OVER w, 0) AS spent, bool_or(kind = 'error') OVER w AS damaged
        FROM g WINDOW w AS (PARTITION BY rec, frames ORDER BY seq ROWS UNBOUNDED PRECEDING))
  SELECT rec, min(seq) AS seq, '{reason}' AS reason FROM h WHERE {cond} GROUP BY rec"""
#: The first event at which the time rule fails, with packets that are twenty times as long as those of the frames.
LATE = BUDGET.format(reason="time", cond="damaged AND round(spent, 9) >= 3 AND kind IN ('await', 'error')").replace("coalesce(sum(seconds)", "coalesce(sum(seconds * 20)")
#: Each error of a frame of even number as 600 without a packet between them, so that two in a row are too many.
STALLED = """s AS (SELECT rec, seq * 600 + k AS seq, kind FROM e, (SELECT unnest(range(600)) AS k) WHERE kind IN ('error', 'frame') AND (k = 0 OR kind = 'error'))"""
WINDOWS = "w AS MATERIALIZED (SELECT rec, win, max(n_samples) AS n_samples, max(preferred) AS preferred, max(guard) AS guard FROM windows_v GROUP BY ALL)"
SAFE = WINDOWS + """,
  d AS (SELECT *, start_sample / 16000.0::DOUBLE AS a, end_sample / 16000.0::DOUBLE AS b, n_samples / 16000.0::DOUBLE AS whole FROM windows_v),
  r AS (SELECT *, ceil(max(b) OVER (PARTITION BY rec, win ORDER BY seq ROWS UNBOUNDED PRECEDING) * 16000) AS upto,
               least(coalesce(min(a) OVER (PARTITION BY rec, win ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), whole), whole) AS nxt FROM d),
  cuts AS (SELECT rec, win, coalesce(CAST(arg_max(upto, seq) FILTER (WHERE upto > 0 AND upto <= least(preferred, greatest(n_samples - guard, 0)) AND nxt >= upto / 16000) AS BIGINT), max(n_samples)) AS cut FROM r GROUP BY ALL)"""


def windows(v):
    return v.windows_v.groupBy("rec", "win").agg(*(F.max(c).alias(c) for c in ("n_samples", "preferred", "guard")))


def window_segments(v):
    return v.windows_v.select("rec", "win", "seq", t.samples_to_seconds("start_sample").alias("start_s"), t.samples_to_seconds("end_sample").alias("end_s"))


def speech(v):
    """Segments as speech intervals of their window."""
    return v.windows_v.select("rec", "win", "start_sample", "end_sample")


def long_packets(v):
    """Decoder events whose packets are twenty times as long as those of the frames."""
    return tl.frame_events(v.frames_v).withColumn("seconds", F.col("seconds") * 20)


def stalled_events(v):
    """Frames and errors only, each error 600 times."""
    e = tl.frame_events(v.frames_v).filter("kind in ('error', 'frame')")
    times = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == "error", 599).otherwise(0)))
    return e.withColumn("k", times).withColumn("seq", F.col("seq") * 600 + F.col("k")).drop("k")


def fake_recognizer(samples):
    """A segment for every eight samples, and the rest as one."""
    edges = [*range(0, len(samples), 8), len(samples)]
    return "en", [(a / 16000, b / 16000, f"{float(np.sum(samples[a:b])):.3f}", 0.1) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def choose_cut(samples):
    return len(samples) - 4


def counting_step(state, row):
    """Greedy sums: a group ends before the row that takes it over 5000 samples."""
    rec, seq, n = row
    group, held = state
    group, held = (group + 1, n) if held + n > 5000 else (group, held + n)
    return (group, held), [(rec, seq, group)]


Q = {
    "classify_code": (
        lambda v: v.frames_v.select("rec", "seq", tl.classify_code(F.when(F.col("seq") % 5 == 0, -11).when(F.col("seq") % 7 == 0, -12).otherwise(F.col("code"))).alias("kind")),
        """SELECT rec, seq, CASE WHEN c >= 0 THEN 'ok' WHEN c IN (-11, -541478725) THEN 'flow' WHEN c IN (-12, -1414092869, -4) THEN 'fatal' ELSE 'recoverable' END AS kind
           FROM (SELECT rec, seq, CASE WHEN seq % 5 = 0 THEN -11 WHEN seq % 7 = 0 THEN -12 ELSE code END AS c FROM frames_v)""",
    ),
    "rescale_pts": (
        lambda v: v.frames_v.select("rec", "seq", tl.rescale_pts("pts", 1, 44100).alias("samples")),
        "SELECT rec, seq, CAST(sign(pts) * ((abs(pts)::HUGEINT * 16000 * 2 + 44100) // 88200) AS BIGINT) AS samples FROM frames_v",
    ),
    "rescale_pts_origin": (
        lambda v: v.frames_v.join(tl.origin(v.frames_v), "rec").select("rec", "seq", tl.rescale_pts("pts", 1, 44100, origin="origin").alias("samples")),
        f"WITH {ORIGIN} SELECT rec, seq, CAST(sign(pts) * ((abs(pts)::HUGEINT * 16000 * 2 + 44100) // 88200) AS BIGINT) - coalesce(origin, 0) AS samples FROM frames_v JOIN o USING (rec)",
    ),
    "origin": (lambda v: tl.origin(v.frames_v), f"WITH {ORIGIN} SELECT rec, origin FROM o"),
    "last_frame_seconds": (lambda v: tl.last_frame_seconds(v.frames_v).select("rec", "seq", "last_frame_seconds"), f"WITH {SECONDS} SELECT rec, seq, last_frame_seconds FROM q"),
    "packet_seconds": (lambda v: tl.packet_seconds(v.frames_v).select("rec", "seq", "seconds"), f"WITH {SECONDS} SELECT rec, seq, seconds FROM q"),
    "decode_error_totals": (lambda v: tl.decode_error_totals(v.frames_v), "SELECT rec, count(*) FILTER (WHERE code < 0) AS errors FROM frames_v GROUP BY rec"),
    "align_timeline": (lambda v: tl.align_timeline(v.frames_v).drop("n_samples"), f"WITH {ALIGNED.format(auto='')} {SHOWN}"),
    "align_timeline_preserve": (lambda v: tl.align_timeline(v.frames_v, "preserve").drop("n_samples"), f"WITH {ALIGNED.format(auto='false AND ')} {SHOWN}"),
    "align_timeline_in_blocks": (lambda v: tl.align_timeline(v.frames_v, bits=3).drop("n_samples"), f"WITH {ALIGNED.format(auto='')} {SHOWN}"),
    "silence_fill": (
        lambda v: tl.silence_fill(tl.align_timeline(v.frames_v)).select("rec", "seq", "silence", "drop"),
        f"""WITH {ALIGNED.format(auto='')}, x AS (SELECT *, greatest(0, coalesce(max(s + n_samples) FILTER (WHERE n_samples > 0) OVER (PARTITION BY rec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS e FROM st)
            SELECT rec, seq, CAST(greatest(0, s - e) AS BIGINT) AS silence, CAST(CASE WHEN s < e THEN least(e - s, n_samples) ELSE 0 END AS BIGINT) AS "drop" FROM x""",
    ),
    "decode_budget": (
        lambda v: tl.decode_budget(long_packets(v), limit_s=3).select("rec", "seq", "reason"),
        f"WITH {EVENTS} {LATE}",
    ),
    "decode_budget_stalled": (
        lambda v: tl.decode_budget(stalled_events(v), limit_s=0).select("rec", "seq", "reason"),
        f"""WITH {EVENTS}, {STALLED},
            m AS (SELECT *, count(*) FILTER (WHERE kind <> 'error') OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS moves FROM s),
            n AS (SELECT *, row_number() OVER (PARTITION BY rec, moves ORDER BY seq) - CASE WHEN moves > 0 THEN 1 ELSE 0 END AS stuck FROM m)
            SELECT rec, min(seq) AS seq, 'stalled' AS reason FROM n WHERE kind = 'error' AND stuck >= 1024 GROUP BY rec""",
    ),
    "decode_budget_strict": (lambda v: tl.decode_budget(tl.frame_events(v.frames_v), strict=True).select("rec", "seq", "reason"), f"WITH {EVENTS} {BUDGET.format(reason='strict', cond='''kind = 'error' ''')}"),
    "with_tail_interval": (
        lambda v: cuts.with_tail_interval(speech(v), windows(v)),
        f"WITH {WINDOWS} SELECT rec, win, start_sample, end_sample FROM windows_v UNION ALL SELECT rec, win, n_samples, n_samples FROM w",
    ),
    "pause_cut": (
        lambda v: cuts.pause_cut(speech(v), windows(v), MIN_SILENCE_MS),
        f"""WITH {WINDOWS},
            a AS (SELECT rec, win, start_sample AS s, end_sample AS e FROM windows_v UNION ALL SELECT rec, win, n_samples, n_samples FROM w),
            b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY rec, win ORDER BY s, e), 0) AS p FROM a),
            c AS (SELECT *, p + (s - p) // 2 AS m FROM b)
            SELECT c.rec, c.win, CASE WHEN bool_or(s < p OR e < s OR e > n_samples) THEN NULL ELSE coalesce(max(m) FILTER (WHERE s > p AND s - p >= {MIN_SILENCE_MS * 16} AND m >= n_samples * 3 // 4 AND m < n_samples), any_value(n_samples)) END AS cut
            FROM c JOIN w ON w.rec = c.rec AND w.win = c.win GROUP BY c.rec, c.win""",
    ),
    "safe_cut": (lambda v: cuts.safe_cut(window_segments(v), windows(v)), f"WITH {SAFE} SELECT rec, win, cut FROM cuts"),
    "commit_segments": (
        lambda v: cuts.commit_segments(window_segments(v), cuts.safe_cut(window_segments(v), windows(v))).select("rec", "win", "seq"),
        f"WITH {SAFE} SELECT rec, win, seq FROM windows_v JOIN cuts USING (rec, win) WHERE end_sample / 16000.0::DOUBLE <= cut / 16000.0::DOUBLE",
    ),
    "clip_intervals": (
        lambda v: cuts.clip_intervals(v.seg_v.select("rec", (F.col("start_ms") * 16).alias("start_sample"), (F.col("end_ms") * 16).alias("end_sample")), windows(v).withColumn("from_sample", F.col("win") * 480000)),
        f"""WITH {WINDOWS}
            SELECT rec, win, least(greatest(start_ms * 16 - win * 480000, 0), n_samples) AS start_sample, least(greatest(end_ms * 16 - win * 480000, 0), n_samples) AS end_sample
            FROM seg_v JOIN w USING (rec) WHERE start_ms * 16 < win * 480000 + n_samples AND end_ms * 16 > win * 480000""",
    ),
    "grid_speech": (
        lambda v: cuts.grid_speech(v.seg_v.select("rec", (F.col("start_ms") * 16).alias("start_sample"), (F.col("end_ms") * 16).alias("end_sample")), GRID_S),
        """SELECT rec, win, greatest(s - win * 480000, 0) AS start_sample, least(e - win * 480000, 480000) AS end_sample
           FROM (SELECT rec, s, e, unnest(range(s // 480000, greatest(e - 1, s) // 480000 + 1)) AS win FROM (SELECT rec, start_ms * 16 AS s, end_ms * 16 AS e FROM seg_v))""",
    ),
    "fold": (
        lambda v: fold(v.frames_v.select("rec", "seq", "n_samples"), "rec", ["seq"], lambda: (0, 0), counting_step, _fold_type(v)),
        """WITH f AS MATERIALIZED (SELECT rec, seq, n_samples AS n FROM frames_v),
             st AS (SELECT rec, seq, 0::BIGINT AS g, n AS h FROM f WHERE seq = 1 UNION ALL
                    SELECT f.rec, f.seq, CASE WHEN st.h + f.n > 5000 THEN st.g + 1 ELSE st.g END, CASE WHEN st.h + f.n > 5000 THEN f.n ELSE st.h + f.n END FROM st JOIN f ON f.rec = st.rec AND f.seq = st.seq + 1)
           SELECT rec, seq, g AS grp FROM st""",
    ),
    "recognize_windows": (
        lambda v: recognize.recognize_windows(audio.pcm_blocks(v.pcm_v, 32), fake_recognizer, choose_cut, 16, 4).select("rec", "idx", "start_sample", "end_sample", "silent", "whole", F.size("segments").cast("long").alias("n")),
        """WITH r AS (SELECT rec, max(i) + 1 AS n, bool_and(x = 0) AS silent FROM pcm_v GROUP BY rec),
             -- a window of 16 with segments at 8 and 16 is cut at 8, a silent one is committed whole, and the last one ends with the recording
             st AS (SELECT rec, n, silent, 0::BIGINT AS idx, 0::BIGINT AS a, CAST(CASE WHEN n < 16 THEN n WHEN silent THEN 16 ELSE 8 END AS BIGINT) AS b FROM r UNION ALL
                    SELECT rec, n, silent, idx + 1, b, CAST(CASE WHEN n - b < 16 THEN n WHEN silent THEN b + 16 ELSE b + 8 END AS BIGINT) FROM st WHERE b < n)
           SELECT rec, idx, a AS start_sample, b AS end_sample, silent, false AS whole, CASE WHEN silent THEN 0 ELSE (b - a + 7) // 8 END AS n FROM st""",
    ),
    "recognize_in_regions": (
        # cuts at every second segment of eight, from wherever a region begins
        lambda v: recognize.recognize_in_regions(audio.pcm_blocks(v.pcm_v, 32), fake_recognizer, choose_cut, 16, 4, 20).select("rec", "idx", "start_sample", "end_sample", "silent", "whole", F.size("segments").cast("long").alias("n")),
        """WITH r AS (SELECT rec, max(i) + 1 AS n, bool_and(x = 0) AS silent FROM pcm_v GROUP BY rec),
             st AS (SELECT rec, n, silent, 0::BIGINT AS idx, 0::BIGINT AS a, CAST(CASE WHEN n < 16 THEN n WHEN silent THEN 16 ELSE 8 END AS BIGINT) AS b FROM r UNION ALL
                    SELECT rec, n, silent, idx + 1, b, CAST(CASE WHEN n - b < 16 THEN n WHEN silent THEN b + 16 ELSE b + 8 END AS BIGINT) FROM st WHERE b < n)
           SELECT rec, idx, a AS start_sample, b AS end_sample, silent, false AS whole, CASE WHEN silent THEN 0 ELSE (b - a + 7) // 8 END AS n FROM st""",
    ),
    "short_recordings": (
        lambda v: recognize.short_recordings(audio.pcm_blocks(v.pcm_v.filter("rec % 5 <> 1"), 32), v.pcm_v.groupBy("rec").agg((F.max("i") + F.when(F.col("rec") % 3 == 0, 2).otherwise(1)).alias("samples"))),
        "SELECT rec, 'short' AS reason FROM pcm_v GROUP BY rec HAVING rec % 5 = 1 OR rec % 3 = 0",
    ),
    "recognize_overlapping": (
        lambda v: recognize.recognize_overlapping(audio.pcm_blocks(v.pcm_v, 32), fake_recognizer, 24, 8).select("rec", "seq", "win", t.seconds_to_samples("start_s").alias("a"), t.seconds_to_samples("end_s").alias("b")),
        """WITH r AS (SELECT rec, max(i) + 1 AS n FROM pcm_v GROUP BY rec HAVING NOT bool_and(x = 0)),
             -- windows of 24 at every 16, cut at 24 each, so all segments of eight stay and those seen twice are taken from the first
             g AS (SELECT rec, n, unnest(range(0, (n + 7) // 8)) AS k FROM r)
           SELECT rec, k AS seq, CASE WHEN k < 3 THEN 0 ELSE (k - 1) // 2 END AS win, k * 8 AS a, least(k * 8 + 8, n) AS b FROM g""",
    ),
}


def _fold_type(v):
    from pyspark.sql import types as T

    return T.StructType([*v.frames_v.select("rec", "seq").schema, T.StructField("grp", T.LongType())])
