"""Text, captions and paragraphs against plain Python."""

import html
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timedtext.functions import text as t
from timedtext.operators import paragraphs as p
from timedtext.operators import segments as s
from timedtext.plans.views import Views
from timedtext.sources import sinks, tables

SEG = "rec string, seq long, start_s double, end_s double, text string, no_speech_prob double, language string"


def segs(spark, rows):
    return spark.createDataFrame([("r", i, *r[:3], 0.125, r[3] if len(r) > 3 else "en") for i, r in enumerate(rows)], SEG)


def one(df):
    return df.first()[0]


def test_times(spark):
    df = spark.createDataFrame([(3661.234,), (0.0,), (360_000.0005,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(t.srt_time("x")).collect()] == ["01:01:01,234", "00:00:00,000", "100:00:00,001", None, None, None, None]


def test_seconds_are_rounded_as_c_does(spark):
    """By the exact value of the double and half to even, as Python's `%.1f` does."""
    rng = random.Random(5)
    xs = [k / 20 + d for k in range(0, 400) for d in (0.0, 700.0, 123_456.0)] + [rng.uniform(0, 10 ** rng.randint(0, 17)) for _ in range(300)]
    xs += [math.nextafter(k / 20, d) for k in range(1, 40) for d in (0, 9)] + [0.0, 9.95, 99.95, 2.0**52 + 0.5, 2.0**53, float("inf"), 1e-300]
    xs += [-x for x in xs] + [float("nan")]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").select("x", t.format_seconds("x"))
    got = [r[1] for r in df.collect()]
    assert got == [f"{x:.1f}" for x in xs] + [None]


def test_every_catalog_of_a_file_is_read(spark, tmp_path):
    one = lambda *names: [{"name": n, "file": f"{n}] [.bin", "url": "u", "sha256": "0", "bytes": 3} for n in names]
    for source, text in (("x", f"{json.dumps(one('a', 'b'))}\n[]\n{json.dumps(one('c'), indent=1)}\n\n{json.dumps(one('d'))}\n"), ("y", json.dumps(one("e"))), ("z", ""), ("bad", "[{")):
        (tmp_path / f"source={source}").mkdir()
        (tmp_path / f"source={source}" / "part.txt").write_text(text)
    got = tables.read_catalog(spark, str(tmp_path)).select("name", "file", "bytes", "source").collect()
    assert sorted(map(str, map(tuple, got))) == sorted([str((n, f"{n}] [.bin", 3, "y" if n == "e" else "x")) for n in "abcde"] + [str((None, None, None, "bad"))])


def test_text(spark):
    df = spark.createDataFrame([(" A \n & <B> ",), (" x ",), ("",), (None,), ("a\x00b",)], "x string")
    assert [r[0] for r in df.select(t.normalize_text("x")).collect()] == ["A & <B>", " x ", "", None, "a\x00b"]
    assert [r[0] for r in df.select(t.cue_escape("x")).collect()] == ["A &amp; &lt;B&gt;", " x ", "", None, "ab"]
    ends = spark.createDataFrame([("Yes.",), ("Yes.”)",), ("No",), ("a.\n",), ("好。",), ("…",), ("",)], "x string").select(t.sentence_end("x"))
    assert [r[0] for r in ends.collect()] == [True, True, False, False, True, True, False]
    assert one(spark.createDataFrame([("😀é",)], "x string").select(t.code_points("x"))) == 2


def stamp(ms, point):
    return f"{ms // 3600000:02}:{ms // 60000 % 60:02}:{ms // 1000 % 60:02}{point}{ms % 1000:03}"


def random_segments(seed, n=30):
    """Segments in whole milliseconds, some of which go back, with marks that captions escape."""
    rng = random.Random(seed)
    words = ["über", "x<y", "R&D", "tab\tstop", "10 > 9", "日本", "plain", "\r\n", " "]
    out, at = [], 0
    for _ in range(n):
        at = max(0, at + rng.randint(-900, 250_000))
        out.append((at / 1000, (at + rng.randint(0, 4000)) / 1000, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))), rng.choice(["de", "ja"])))
    return out


def test_formats_against_plain_text(spark):
    rows = random_segments(3)
    df, lines = segs(spark, rows), [" ".join(x.split()) for _, _, x, _ in rows]
    ms = [(round(a * 1000), round(b * 1000)) for a, b, *_ in rows]
    srt = "".join(f"{i + 1}\n{stamp(a, ',')} --> {stamp(b, ',')}\n{x}\n\n" for i, ((a, b), x) in enumerate(zip(ms, lines, strict=True)))
    assert "".join(r.value + "\n" for r in sinks.srt_rows(df).orderBy("cue").collect()) == srt
    vtt, last = "WEBVTT\n\n", 0
    for i, ((a, b), x) in enumerate(zip(ms, lines, strict=True)):
        last = max(last, a)
        vtt += f"{i + 1}\n{stamp(last, '.')} --> {stamp(max(b, last + 1), '.')}\n{html.escape(x, quote=False)}\n\n"
    assert "".join(r.value + "\n" for r in sinks.vtt_rows(df).orderBy("cue").collect()) == vtt
    headers = spark.createDataFrame([("r", "s3a://b/k.opus", None, 7.5, False, "cuda")], "rec string, source string, model string, duration double, vad boolean, v string").withColumn("run", F.struct(F.col("v").alias("device"))).drop("v")
    value = sinks.json_documents(df, headers).first().value
    got = json.loads(value)
    assert list(got) == ["schema_version", "source", "model", "language", "languages", "language_probability", "duration", "duration_after_vad", "text", "segments", "run"]
    assert list(got["segments"][0]) == ["id", "start", "end", "text", "language", "avg_logprob", "compression_ratio", "no_speech_prob"]
    assert [(x["id"], x["start"], x["end"], x["text"], x["language"]) for x in got["segments"]] == [(i, *r) for i, r in enumerate(rows)]
    assert (got["schema_version"], got["model"], got["language"], got["duration"], got["duration_after_vad"], got["run"]) == (2, None, None, 7.5, 7.5, {"device": "cuda"})
    assert got["languages"] == list(dict.fromkeys(r[3] for r in rows)) and got["text"] == p.transcript_text(df, 2000).first().text
    assert ("\n\n".join("\n\n".join(r.value for r in sinks.text_rows(df).orderBy("paragraph").collect()).split("\n\n\n"))) == got["text"]


def test_captions_refuse_times(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0, "a"), (nan, 3.0, "b"), (2.0, inf, "c"), (-0.5, 1.5, "d"), (None, 1.0, "e"), (4.0, 5.0, "f")]
    df = segs(spark, rows)
    assert [(r.seq, r.reason) for r in sinks.refused_cues(df, "srt").orderBy("seq").collect()] == [(1, "not finite"), (2, "not finite"), (3, "negative"), (4, "not finite")]
    assert [r.seq for r in sinks.refused_cues(df, "vtt").orderBy("seq").collect()] == [1, 2, 4]
    assert [r.value.split("\n")[2] for r in sinks.srt_rows(df).orderBy("cue").collect()] == ["a", "f"]
    assert [r.value.split("\n")[1] for r in sinks.vtt_rows(df).filter("cue > 0").orderBy("cue").collect()][1] == "00:00:01.000 --> 00:00:01.500"
    cues = s.vtt_cues(df).orderBy("cue").collect()
    assert [r.start for r in cues] == ["00:00:01.000", None, None, "00:00:01.000", None, "00:00:04.000"] and cues[1].end is None
    with pytest.raises(Exception, match="invalid time"):
        sinks.refused_cues(df, "srt", strict=True).collect()


def test_publish_by_default(spark, tmp_path):
    rows = [("good", 0, 0.5, 2.25, "Fine.", 0.0, "fr"), ("bad", 0, 0.0, float("nan"), "Lost?", 0.0, "fr"), ("blank", 0, 0.0, 1.0, "\t", 0.0, "fr")]
    failed = sinks.publish_all(spark.createDataFrame(rows, SEG), str(tmp_path))
    assert {(r.rec, r.reason) for r in failed.collect()} == {("bad", "invalid time"), ("blank", "no text")}
    assert [(r.source, r.end_s) for r in tables.read_transcripts(spark, str(tmp_path / "json")).collect()] == [("good", 2.25)]
    failed = sinks.publish_all(spark.createDataFrame(rows, SEG), str(tmp_path / "t"), ("text",))
    assert {(r.rec, r.reason) for r in failed.collect()} == {("blank", "no text")}
    with pytest.raises(ValueError, match="doc"):
        sinks.publish_all(spark.createDataFrame(rows, SEG), str(tmp_path / "u"), ("doc",))


def test_paragraphs(spark):
    for pause_ms in (300, 60_000):
        rows = random_segments(11, 40)
        want, last = [], None
        for a, b, x, language in rows:
            if not (x := " ".join(x.split())):
                continue
            if last and ((a - last[0]) * 1000 >= pause_ms or language != last[1]):
                want.append([])
            want = want or [[]]
            want[-1].append(x)
            last = (b, language)
        df = segs(spark, rows)
        assert p.transcript_text(df, pause_ms).first().text == "\n\n".join(map(" ".join, want))
        assert p.transcript_text(df, pause_ms, "line").first().text == " ".join(x for w in want for x in w)
    for n in range(597, 603):
        made = segs(spark, [(0.0, 1.0, "é" * (n // 2)), (1.0, 2.0, "漢" * (n - n // 2 - 1) + "!"), (2.0, 2.5, "then")])
        assert (p.transcript_text(made, 5000).first().text.count("\n\n") == 1) == (n >= 600)


def test_languages_and_validation(spark):
    df = segs(spark, [(0.0, 1.0, "a", "ru"), (1.0, 2.0, "b", "en"), (2.0, 3.0, "c", "ru"), (3.0, 2.0, "d", "")])
    assert s.languages(df, "rec").first().languages == ["ru", "en"]
    assert s.language_summary(df, "rec").first().language is None
    good, bad = s.quarantine(s.validate_segments(df, low=0.0, high=10.0, probability="no_speech_prob"))
    assert good.count() == 3 and bad.first().reason == "ends before its start"
    assert s.validate_segments(segs(spark, [(float("nan"), 1.0, "a")])).first().reason == "not finite"
    c = s.clamp_segment(spark.createDataFrame([(-5, 5000, 30.0), (2000, 1000, 30.0)], "start_cs long, end_cs long, d double"), "d").collect()
    assert [(r.start_s, r.end_s) for r in c] == [(0.0, 30.0), (20.0, 20.0)]


def test_sinks_round_trip(spark, tmp_path):
    df = segs(spark, [(2.5, 4.125, "Erst?"), (64.0, 65.5, "Dann!"), (65.5, 66.0, "")]).unionByName(segs(spark, [(0.0, 1.0, " ")]).withColumn("rec", F.lit("silent")))
    headers = df.select("rec").distinct().select("rec", F.lit("x.wav").alias("source"), F.lit("m").alias("model"), F.lit(10.0).alias("duration"), F.lit(False).alias("vad"), F.create_map(F.lit("vad"), F.lit("false")).alias("run"))
    failed = sinks.publish_all(df, str(tmp_path), headers=headers)
    assert [r.rec for r in failed.collect()] == ["silent"]
    read = lambda f: "".join(x.read_text() for x in sorted((tmp_path / f / "rec=r").glob("*.txt")))
    assert read("text") == "Erst?\n\nDann!\n"
    assert read("srt").startswith("1\n00:00:02,500 --> 00:00:04,125\nErst?\n\n2\n00:01:04,000 --> 00:01:05,500\nDann!\n\n3\n")
    assert read("vtt").startswith("WEBVTT\n\n1\n00:00:02.500 --> 00:00:04.125\nErst?\n\n2\n")
    loud = sinks.publish_all(df, str(tmp_path / "loud"), ("text",), render=lambda d: F.upper(d["text"]))
    assert [r.rec for r in loud.collect()] == ["silent"] and spark.read.text(str(tmp_path / "loud" / "text")).filter("value <> ''").count() == 2
    assert spark.read.text(str(tmp_path / "loud" / "text")).filter("value = 'ERST?'").count() == 1
    jobs = df.select("rec").distinct().select(F.col("rec").alias("path"), F.lit(1).alias("n"), F.lit("srt").alias("format"), F.concat("rec", F.lit(".srt")).alias("target"))
    sinks.write_mapping(jobs.withColumn("n", F.when(F.col("path") == "r", 2).otherwise(1)), "talk", "n", str(tmp_path / "mapping"))
    assert [(r.number, r.name, r.source) for r in spark.read.json(str(tmp_path / "mapping")).orderBy("number").collect()] == [(1, "talk_001", "silent"), (2, "talk_002", "r")]
    (tmp_path / "json" / "rec=bad").mkdir()
    (tmp_path / "json" / "rec=bad" / "bad.txt").write_text('{"schema_version": 1, "segments": []}\n{"schema_version": 2, "segm\n')
    assert sorted(r.reason for r in tables.refused_transcripts(spark, str(tmp_path / "json")).collect()) == ["other schema", "unreadable"]
    back = tables.read_transcripts(spark, str(tmp_path / "json")).orderBy("seq").collect()
    assert [(r.seq, r.start_s, r.end_s, r.text, r.language) for r in back] == [(0, 2.5, 4.125, "Erst?", "en"), (1, 64.0, 65.5, "Dann!", "en"), (2, 65.5, 66.0, "", "en")]


def test_a_long_recording_is_several_documents(spark, tmp_path):
    n = 2 * sinks.SEGMENTS + 9
    rows = [("long", i, i * 3.0, i * 3.0 + (0.5 if i % 700 == 0 else 2.5), f"w{i}" + "." * (i % 3 == 0), 0.0, "en") for i in range(n)] + [("short", 0, 0.0, 1.0, "x", 0.0, "en")]
    df = spark.createDataFrame(rows, SEG)
    docs = [json.loads(r.value) for r in sinks.json_documents(df, sinks.default_headers(df)).orderBy("rec", "place").collect()]
    assert [(d["source"], len(d["segments"]), d.get("first_segment")) for d in docs] == [("long", sinks.SEGMENTS, None), ("long", sinks.SEGMENTS, sinks.SEGMENTS), ("long", 9, 2 * sinks.SEGMENTS), ("short", 1, None)]
    assert "\n\n".join(d["text"] for d in docs[:3] if d["text"]) == p.transcript_text(df, 2000).filter("rec = 'long'").first().text
    sinks.write_json(df, sinks.default_headers(df), str(tmp_path / "out"))
    back = tables.read_transcripts(spark, str(tmp_path / "out")).filter("source = 'long'").orderBy("seq").collect()
    assert [(r.seq, r.text) for r in back] == [(r[1], r[4]) for r in rows[:-1]]


def test_recordings_share_files(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", 0, 0.0, 1.0, "x", 0.0, "en") for i in range(300)], SEG)
    sinks.write_json(df, sinks.default_headers(df), str(tmp_path / "out"))
    assert tables.read_transcripts(spark, str(tmp_path / "out")).count() == 300 and len(list((tmp_path / "out").rglob("*.txt"))) < 50


def test_a_long_recording_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE", 16, raising=False)
    monkeypatch.setattr(sinks, "SEGMENTS", 8)
    rows = [("long", i, i * 3.0, i * 3.0 + (0.5 if i % 7 == 0 else 2.5), f"w{i}" if i % 5 else " ", 0.0, "en") for i in range(100)] + [(f"s{i}", 0, 0.0, 1.0, "x", 0.0, "en") for i in range(20)]
    df = spark.createDataFrame(rows, SEG).repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sinks.publish_all(df, str(tmp_path)).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    parts = lambda f, rec="long": [x.read_text() for x in sorted((tmp_path / f / f"rec={rec}").glob("*.txt"))]
    assert all(len(parts(f)) > 1 and len(parts(f, "s7")) == 1 for f in ("srt", "vtt"))
    lines = lambda df, order: "".join(r.value + "\n" for r in df.filter("rec = 'long'").orderBy(order).collect())
    assert "".join(parts("text")) == lines(sinks.text_rows(df), "paragraph")
    assert "".join(parts("srt")) == lines(sinks.srt_rows(df), "cue") and "".join(parts("vtt")) == lines(sinks.vtt_rows(df), "cue")
    docs = [json.loads(x) for f in (tmp_path / "json").glob("*.txt") for x in f.read_text().splitlines()]
    docs = sorted((d for d in docs if d["source"] == "long"), key=lambda d: d.get("first_segment", 0))
    want = sorted((json.loads(r.value) for r in sinks.json_documents(df, sinks.default_headers(df)).filter("rec = 'long'").collect()), key=lambda d: d.get("first_segment", 0))
    assert all(len(d["segments"]) <= 8 and d["segments"][0]["id"] == d.get("first_segment", 0) for d in docs) and len(want) == 13
    assert [x for d in docs for x in d["segments"]] == [x for d in want for x in d["segments"]] and len(docs) < 20
    assert all("\n\n".join(d["text"] for d in x if d["text"]) == p.transcript_text(df, 2000).filter("rec = 'long'").first().text for x in (docs, want))
    assert all({k: v for k, v in d.items() if k not in ("segments", "text", "first_segment")} == {k: v for k, v in want[0].items() if k not in ("segments", "text")} for d in docs)


def test_published_input_is_in_few_plans(spark, tmp_path):
    """What is published is written once, and the formats' plans don't hold the steps that led to it."""
    df = segs(spark, [(0.0, 1.0, "one"), (1.0, 2.0, "two")]).withColumn("text", F.max("text").over(W.partitionBy("rec", "seq")))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    sinks.publish_all(df, str(tmp_path))
    plans = [store.executionsList(int(before), 1000).apply(i).physicalPlanDescription() for i in range(int(store.executionsCount() - before))]
    assert plans and sum("max(text" in x for x in plans) == 1


def test_segments_of_one_place_are_published_once(spark, tmp_path):
    rows = [("r", 0, 0.0, 1.0, "One.", 0.0, "en"), ("r", 1, 1.0, 2.0, "two", 0.0, "en"), ("r", 1, 1.0, 2.0, "too", 0.0, "en")]
    sinks.publish_all(spark.createDataFrame(rows, SEG), str(tmp_path))
    words = {f: sorted(w for x in (tmp_path / f).rglob("*.txt") for w in ("One", "two", "too") for _ in range(x.read_text().count(w))) for f in ("text", "srt", "vtt")}
    assert set(map(tuple, words.values())) == {("One", "too", "two")}
    assert sorted(r.text for r in tables.read_transcripts(spark, str(tmp_path / "json")).collect()) == ["One.", "too", "two"]


def test_texts_of_a_source_go_through_no_window(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    plan = Views(spark, "/root/testdata/sf0.001").docseg_v._jdf.queryExecution().optimizedPlan().toString()
    below = [x for x in plan[plan.index("Window") :].splitlines() if "Project" in x]
    assert "text#" not in below[0] and "Join" in plan


def test_sentence_end_behind_many_quotes(spark):
    texts = ["a." + "\"" * k for k in (0, 1, 30, 31, 32, 33, 90)] + ["a. b" + ")" * 40, ")" * 40, "." * 40, "", None, "é。" + "”" * 35]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(t.sentence_end("x")).collect()] == [True] * 7 + [False, False, True, False, None, True]


def test_a_segment_without_text_is_a_blank_cue(spark, tmp_path):
    sinks.publish_all(segs(spark, [(0.0, 1.0, None), (1.0, 2.0, "b")]), str(tmp_path), ("srt", "vtt"))
    read = lambda f: "".join(x.read_text() for x in (tmp_path / f).rglob("*.txt"))
    assert read("srt") == "1\n00:00:00,000 --> 00:00:01,000\n\n\n2\n00:00:01,000 --> 00:00:02,000\nb\n\n"
    assert read("vtt") == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\n\n\n2\n00:00:01.000 --> 00:00:02.000\nb\n\n"
