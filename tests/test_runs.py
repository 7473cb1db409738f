"""Jobs, journals, settings, media and streams."""

import hashlib
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from timedtext.operators import audio, jobs, journal, runs
from timedtext.plans.queries_audio import as_wav
from timedtext.sources import media, sinks, tables
from timedtext.streaming import operators as streams
from timedtext.streaming.ordered import use_rocksdb


def test_paths(spark):
    df = spark.createDataFrame([("d/a.b.MP4", 1), ("d/.wav", 1), ("d/x.txt", 1), ("d/Z.wav", 1), ("e/ü.m2ts", 1)], "path string, bytes long")
    assert sorted(r.path for r in jobs.discover_media(df).collect()) == ["d/Z.wav", "d/a.b.MP4", "e/ü.m2ts"]
    assert [r.path for r in jobs.discover_media(df).filter("path like 'd/%'").orderBy("position").collect()] == ["d/Z.wav", "d/a.b.MP4"]
    assert [r.target for r in jobs.output_paths(df.limit(1), "srt").collect()] == ["d/a.b.srt"]
    assert {r.format for r in jobs.output_paths(df.limit(1)).collect()} == {"text", "srt", "vtt", "json"}
    with pytest.raises(ValueError):
        jobs.expand_formats(df, "doc")
    with pytest.raises(ValueError):
        jobs.numbered_names(df, "a b", ["path"])
    many = spark.range(1000).select(F.lit("d/x.wav").alias("path"), "id")
    assert jobs.numbered_names(many, "p", ["id"]).filter("id in (0, 999)").orderBy("id").select("name").collect() == [("p_001",), ("p_1000",)]


def test_chain_detects_every_damage(spark):
    chunks = spark.createDataFrame([("r", i, i * 10, i * 10 + 10, "en", [(float(i), i + 0.5, "x", 0.1)]) for i in range(4)], "rec string, idx long, start_sample long, end_sample long, language string, segments array<struct<start: double, `end`: double, text: string, no_speech_prob: double>>")
    linked = journal.chunk_records(chunks).orderBy("idx").collect()
    assert linked[1].previous_hash == hashlib.sha256(linked[0].raw.encode()).hexdigest()
    assert [json.loads(r.raw)["index"] for r in linked] == [0, 1, 2, 3]
    rows = [("r", i, i * 10, i * 10 + 10, x.previous_hash, "en", x.raw) for i, x in enumerate(linked)]
    names = "rec string, idx long, start_sample long, end_sample long, previous_hash string, language string, raw string"
    reasons = lambda r: [x.reason for x in journal.verify_chain(spark.createDataFrame(r, names), 10).orderBy("idx").collect()]
    assert reasons(rows) == [None] * 4
    assert reasons([*rows[:1], (*rows[1][:6], rows[1][6] + " "), *rows[2:]]) == [None, None, "hash", None]
    assert reasons([rows[0], rows[2]])[1] == "index"
    assert reasons([(*rows[0][:3], 30, *rows[0][4:])]) == ["length"]
    m = spark.createDataFrame([("r", 4, 40, hashlib.sha256(linked[3].raw.encode()).hexdigest()), ("s", 0, 0, "")], "rec string, chunks long, samples long, last_hash string")
    assert {r.rec: r.valid for r in journal.valid_recordings(spark.createDataFrame(rows, names), 10, m).collect()} == {"r": True, "s": True}
    assert not journal.valid_recordings(spark.createDataFrame(rows[:3], names), 10, m).filter("rec = 'r'").first().valid


def test_append_and_read_journal(spark, tmp_path):
    seg = "array<struct<start_s: double, end_s: double, text: string, no_speech_prob: double>>"
    results = spark.createDataFrame([("r", 0, 0, 160_000, "en", [(0.0, 1.0, " a ", 0.1), (1.0, 2.0, " \n", 0.1), (5.0, 4.0, "bad", 0.1)]), ("r", 1, 160_000, 320_000, "en", [])], f"rec string, idx long, start_sample long, end_sample long, language string, segments {seg}")
    records, bad = sinks.append_rows(results)
    assert [r.reason for r in bad.collect()] == ["ends before its start"]
    seen, watch = journal.observed(records.withColumn("start_sample", F.lit(0)).withColumn("end_sample", F.lit(16_000)))
    assert seen.count() == 2 and watch.get["chunks"] == 2 and watch.get["samples"] == 32_000
    (tmp_path / "r").mkdir()
    for r in records.collect():
        (tmp_path / "r" / f"chunk-{r.idx}.json").write_text(r.raw)
    (tmp_path / "r" / "manifest.json").write_text(json.dumps({"schema_version": 3, "chunks": 2, "samples": 320_000, "languages": ["en"], "last_hash": "x", "finished": True, "published_hashes": {}}))
    manifests, chunks = tables.read_journal(spark, str(tmp_path))
    got = chunks.orderBy("index").collect()
    assert [(r["index"], r.language, [s.text for s in r.segments]) for r in got] == [(0, "en", ["a"]), (1, "", [])]
    assert [x.reason for x in journal.verify_chain(chunks.withColumnRenamed("index", "idx"), 160_000).orderBy("idx").collect()] == [None, None]
    assert manifests.first().samples == 320_000
    (tmp_path / "r" / "chunk-2.json").write_text('{"index": 2, "start')
    (tmp_path / "r" / "chunk-3.json").write_text("no record")
    checked = journal.verify_chain(tables.read_journal(spark, str(tmp_path))[1].withColumnRenamed("index", "idx"), 160_000)
    assert sorted((r.idx is None, r.reason or "") for r in checked.collect()) == [(False, ""), (False, ""), (True, "unreadable"), (True, "unreadable")]
    large = tables._parsed(spark.createDataFrame([('{"index": 5}',), ('{"index":5}',), (None,)], "raw string"), tables.CHUNK, limit=11)
    assert sorted((r.reason or "", r.raw or "", r["index"] or 0) for r in large.collect()) == [("", '{"index":5}', 5), ("too large", "", 0), ("unreadable", "", 0)]


def test_whole_records_are_checked(spark):
    kind = "rec string, idx long, start_sample long, end_sample long, previous_hash string, language string, raw string, segments array<struct<start: double, `end`: double, text: string, no_speech_prob: double>>"
    good = ("r", 0, 0, 16_000, "", "en", "{}", [(0.0, 0.5, "x", 0.1), (0.5, 1.0, "y", 0.1)])
    reason = lambda **c: journal.verify_chain(spark.createDataFrame([tuple(c.get(n, v) for n, v in zip(kind_names, good, strict=True))], kind), 16_000).first().reason
    kind_names = ("rec", "idx", "start_sample", "end_sample", "previous_hash", "language", "raw", "segments")
    assert reason() is None and reason(segments=[], language="") is None
    for name in kind_names[1:]:
        assert reason(**{name: None}) == "unreadable"
    assert reason(language="") == "language" and reason(segments=[]) == "language" and reason(previous_hash="x") == "hash"
    assert reason(segments=[good[7][0], (0.5, 1.5, "y", 0.1)]) == "ends too late" and reason(segments=[(-0.1, 0.5, "x", 0.1)]) == "starts too early"
    assert reason(segments=[(0.5, 0.4, "x", 0.1)]) == "ends before its start" and reason(segments=[(float("nan"), 1.0, "x", 0.1)]) == "not finite"
    assert reason(segments=[(0.0, 1.0, "", 0.1)]) == "text" and reason(segments=[(0.0, 1.0, None, 0.1)]) == "text"
    chunks = spark.createDataFrame([good], kind)
    for languages, valid in ((["en"], True), (["ru"], False), ([], False)):
        m = spark.createDataFrame([("r", 1, 16_000, hashlib.sha256(b"{}").hexdigest(), languages, True)], "rec string, chunks long, samples long, last_hash string, languages array<string>, finished boolean")
        assert journal.valid_recordings(chunks, 16_000, m).first().valid is valid
    assert journal.recording_totals(chunks, m).first().finished is True


def leaves(text):
    """The plain form of flatten_json: (pointer, value) of one text, or None."""
    try:
        todo = [("", json.loads(text, parse_float=str, parse_int=str, parse_constant=lambda x: 1 / 0))]
    except (ValueError, ZeroDivisionError):
        return None
    out = []
    while todo:
        at, x = todo.pop()
        if isinstance(x, (dict, list)) and x:
            todo += [(f"{at}/{str(n).replace('~', '~0').replace('/', '~1')}", v) for n, v in (x.items() if isinstance(x, dict) else enumerate(x))]
        else:
            out.append((at, x if x is None or isinstance(x, str) else json.dumps(x)))
    return sorted(out, key=str)


TEXTS = [
    '{"a": {"b/c": [1, {"~": null}], "d": {}}, "e": true, "f": "x"}', "{", None, "", "3", " [ ] ", "null", '"s"', '{"a":{ }}', "[1] 2", "1, 2", "1] [2", "1} {", "{'a': 1}", "[1,]", "nul",
    r'{"q\"{": "\\", "\\\"": "[1]", "s": "{\"a\": 1}", "": "", "éé": "\n\\\\\""}', '{"a": 1, "b": 2, "a": {"c": 3}}', "[1.50, -0, 1e400, 12345678901234567890123, 0.10]", '[[[], [[]]], {"a": [{"b": [{"c": [{}]}]}]}]',
    "[01]", "[1.]", "[-]", "[+1]", "[1e]", "[.5]", "[NaN]", "[-Infinity]", "[1-2]", "[tru]", '[1"a"]', '["|", "1|", "|1", "-1|"]', '{"1": 1, "-2|": -2e-3}', r'[\"]', r'["\""]', r'["\x"]',
    '{"a":' * 30 + "1.50" + "}" * 30, '[{"s1": "sx", "s": "s"}, "s", "true", true, "null"]', "\"a\tb\"", '{"a": "x"} y', '{"a\\/b": "\\u0041\\t"}', '["' + "x" * 100_000 + '"]',
]


def test_flatten_json(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "job int, doc string")
    for levels in (4, 11):
        got = {}
        for r in runs.flatten_json(df, "doc", "job", levels).collect():
            got.setdefault(r.job, []).append((r.pointer, r.value))
        for i, text in enumerate(TEXTS):
            assert sorted(got.get(i, []), key=str) == (leaves(text) or [] if text else []), text
    assert runs.flatten_json(df.limit(0), "doc", "job").count() == 0
    plan = runs.flatten_json(df, "doc", "job")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_settings(spark):
    a, b = spark.createDataFrame([(1, "x", 5), (2, "y", None)], "job long, model string, beam int"), spark.createDataFrame([(1, "x", 6), (2, "y", None), (3, "z", 1)], "job long, model string, beam int")
    diff = runs.diff_settings(a, b)
    assert {(r.job, r.fields) for r in runs.changed_fields(diff).collect()} == {(1, "/beam"), (3, "/beam, /model")}
    assert {(r.job, r.model, r.beam) for r in runs.freeze_metadata(b, a).collect()} == {(1, "x", 5), (2, "y", None), (3, "z", 1)}
    run = spark.createDataFrame([({"beam": "5", "threads": "8", "version": "2"},)], "run map<string,string>").select(runs.strip_execution_keys("run"))
    assert run.first()[0] == {"beam": "5"}


def test_catalog_and_audit(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"name": n, "file": f"{n}.bin", "url": "u", "sha256": "h", "bytes": 10} for n in "abcd"]))
    files = spark.createDataFrame([("a.bin", 10, "h"), ("b.bin", 9, "h"), ("c.bin", 10, "x")], "file string, size long, hash string")
    got = runs.audit_artifacts(tables.read_catalog(spark, str(tmp_path / "c.json")), files)
    assert {r.name: r.status for r in got.collect()} == {"a": "cached", "b": "partial", "c": "corrupt", "d": "missing"}


def test_wav(spark, tmp_path):
    import struct

    data = np.full(2 * 48_000, 1000, "<i2").tobytes()
    (tmp_path / "s.wav").write_bytes(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 2, 48_000, 192_000, 4, 16, b"data", len(data)) + data)
    (tmp_path / "m.wav").write_bytes(as_wav(np.arange(5, dtype=np.float32)))
    rows = media.read_media(spark, str(tmp_path), "*.wav", block=10_000).collect()
    stereo = np.concatenate([r.samples for r in sorted((r for r in rows if r.rec.endswith("s.wav")), key=lambda r: r.start_sample)])
    assert len(stereo) == 16_000 and np.allclose(stereo, np.sqrt(2) * 1000 / 32_768, atol=1e-4) and all(len(r.samples) <= 10_000 for r in rows)
    assert [r.samples for r in rows if r.rec.endswith("m.wav")] == [[0.0, 1.0, 2.0, 3.0, 4.0]]
    with pytest.raises(ValueError):
        media.decode_wav(b"nothing")


def test_resampling_keeps_a_tone(spark):
    t = np.arange(44_100) / 44_100
    tone = np.sin(2 * np.pi * 440 * t)
    rows = spark.createDataFrame([("r", i, tone[a : a + 5000].tolist(), 44_100, 1) for i, a in enumerate(range(0, 44_100, 5000))], "rec string, seq long, samples array<double>, rate int, channels int")
    got = np.concatenate([r.samples for r in audio.downmix_resample(rows).orderBy("start_sample").collect()])
    want = np.sin(2 * np.pi * 440 * np.arange(len(got)) / 16_000)
    assert len(got) == 16_000 and np.sum((got - want)[:-5] ** 2) / np.sum(want**2) < 0.005


@pytest.mark.parametrize("rate", [44_100, 48_000])
def test_resampling_takes_out_what_lies_above(spark, rate):
    t = np.arange(rate) / rate
    low, high = np.sin(2 * np.pi * 3000 * t), np.sin(2 * np.pi * 11_000 * t)
    rows = spark.createDataFrame([("r", i, (low + high)[a : a + 5000].tolist(), rate, 1) for i, a in enumerate(range(0, rate, 5000))], "rec string, seq long, samples array<double>, rate int, channels int")
    got = np.concatenate([r.samples for r in audio.downmix_resample(rows).orderBy("start_sample").collect()])
    want = np.sin(2 * np.pi * 3000 * np.arange(16_000) / 16_000)
    assert len(got) == 16_000 and np.sum((got - want)[100:-100] ** 2) / np.sum(want**2) < 0.005


def test_format_change_keeps_samples(spark):
    rows = spark.createDataFrame([("r", 0, [0.5] * 4800, 48_000, 1), ("r", 1, [0.25] * 1600, 16_000, 1)], "rec string, seq long, samples array<double>, rate int, channels int")
    got = np.concatenate([r.samples for r in audio.downmix_resample(rows).orderBy("start_sample").collect()])
    assert len(got) == 3200 and np.allclose(got[:1600], 0.5) and np.allclose(got[1600:], 0.25)


def test_publish_batch_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("r", "srt", "a"), ("r", "vtt", "b")], "rec string, format string, content string")
    sink = str(tmp_path / "sink")
    assert streams.publish_batch(df, sink).count() == 0
    assert streams.publish_batch(df, sink).count() == 0
    changed = df.withColumn("content", F.concat("content", F.lit("!")))
    assert streams.publish_batch(changed.filter("format = 'srt'"), sink).count() == 1
    assert spark.read.parquet(sink).count() == 2
    assert streams.publish_batch(changed.filter("format = 'srt'"), sink).count() == 1
    # several contents of one key in a batch: one is published, also for a null key
    many = spark.createDataFrame([("s", None, x) for x in ("a", "b", "a", "c")] + [("t", "srt", "z")] * 2, "rec string, format string, content string")
    for _ in range(2):
        assert streams.publish_batch(many, sink).groupBy("rec").count().orderBy("rec").collect() == [("r", 1), ("s", 2)]
        assert spark.read.parquet(sink).groupBy("rec").count().orderBy("rec").collect() == [("r", 2), ("s", 1), ("t", 1)]


def test_idle_state_expires_and_repeats_are_skipped(spark, tmp_path):
    use_rocksdb(spark)
    schema = "rec long, seq long, pts long, n_samples long, delay long, tolerance long, transport boolean"
    frame = lambda rec, seq: (rec, seq, None, 10, 0, 1, False)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([frame(1, 1), frame(1, 3), frame(1, 3), frame(1, 1), frame(1, 4), frame(2, None)])
    out = streams.stream_align_timeline(streams.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), idle=2.0)
    query = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    got = lambda: [(r.seq, r.start) for r in spark.table("idle").collect()]
    try:
        for _ in range(120):
            if len(got()) == 3:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    # what was held for the sake of frame 2 is placed when the recording is given up
    assert got() == [(1, 0), (3, 10), (4, 20)]


def test_resume_refuses_other_settings(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "job long, model string"), spark.createDataFrame([(1, "y")], "job long, model string")
    with pytest.raises(ValueError, match="/model"):
        streams.resume(a, str(tmp_path / "o"), str(tmp_path / "c"), a, b)


def write_saved(folder, **changes):
    """The files of one recording: `manifest` updates its manifest, c0, c1, ... are a record's text, `drop` names files that are missing. Returns its fingerprint of now."""
    n = changes.pop("n", 2)
    raws, last = [], ""
    for i in range(n):
        record = {"index": i, "start_sample": i * 16_000, "end_sample": (i + 1) * 16_000, "previous_hash": last, "language": "en", "segments": [{"start": float(i), "end": i + 0.5, "text": "x", "no_speech_prob": 0.1}]}
        raws.append(json.dumps(record))
        last = hashlib.sha256(raws[-1].encode()).hexdigest()
    print_ = {"source": "a", "outputs": {"srt": "a.srt"}, "run": {"beam": "5", "list": ["1", "2"]}}
    manifest = {"schema_version": 3, "fingerprint": print_, "output_metadata": {"model": "m", "run": {}}, "chunks": n, "samples": n * 16_000, "languages": ["en"] if n else [], "last_hash": last, "finished": False, "published_hashes": {}}
    files = {"manifest.json": json.dumps(manifest | changes.get("manifest", {})), **{f"chunk-{i}.json": x for i, x in enumerate(raws)}}
    files |= {f"chunk-{k[1:]}.json": v for k, v in changes.items() if k[0] == "c"}
    folder.mkdir(parents=True)
    for name, x in files.items():
        if name not in changes.get("drop", ()):
            (folder / name).write_text(x)
    return print_ | changes.get("fingerprint", {})


NOTHING = {"chunks": 0, "samples": 0, "languages": [], "last_hash": ""}
SAVED = [
    ({}, ("resume", None)),
    ({"manifest": {"finished": True}}, ("publish", None)),
    ({"manifest": {"schema_version": 2}}, ("refuse", "schema")),
    ({"manifest": {"samples": -1}}, ("refuse", "manifest")),
    ({"manifest": {"output_metadata": {"model": None, "run": {}}}}, ("refuse", "manifest")),
    ({"manifest": {"last_hash": "zz"}}, ("refuse", "corrupt")),
    ({"manifest": {"languages": []}}, ("refuse", "corrupt")),
    ({"c1": "{"}, ("refuse", "corrupt")),
    ({"drop": ("chunk-1.json",)}, ("refuse", "corrupt")),
    ({"drop": ("manifest.json",)}, ("refuse", "manifest missing")),
    ({"c2": '{"index": 2}'}, ("resume", None)),  # not committed
    ({"fingerprint": {"run": {"beam": "6", "list": ["1"]}, "extra": None}}, ("refuse", "changed: /extra, /run/beam, /run/list/1")),
    # what has begun only
    ({"n": 0}, ("start", None)),
    ({"n": 1, "manifest": NOTHING}, ("start", None)),
    ({"n": 2, "manifest": NOTHING}, ("refuse", "unknown contents")),
    ({"n": 1, "manifest": NOTHING, "c0": '{"index": 0, "start_sample": 3}'}, ("refuse", "corrupt")),
    ({"n": 0, "manifest": {"last_hash": "zz"}}, ("refuse", "corrupt")),
    ({"n": 0, "manifest": {"languages": ["en"]}}, ("refuse", "corrupt")),
]


def test_restoring(spark, tmp_path):
    jobs = [(f"r{i}", json.dumps(write_saved(tmp_path / f"r{i}", **dict(changes)))) for i, (changes, _) in enumerate(SAVED)]
    manifests, chunks = tables.read_journal(spark, str(tmp_path))
    df = spark.createDataFrame([*jobs, ("new", "{}")], "rec string, fingerprint string")
    go = lambda **how: {x.rec: (x.action, x.reason) for x in journal.restore(manifests, chunks.withColumnRenamed("index", "idx"), df, 16_000, **how).collect()}
    want = {"new": ("start", None), **{f"r{i}": x for i, (_, x) in enumerate(SAVED)}}
    assert go() == want
    refused = {r: x if x[0] in ("refuse", "start") and not (x[1] or "").startswith("changed") else ("refuse", "saved progress") for r, x in want.items()}
    assert go(resume=False) == refused
    assert set(go(resume=False, overwrite=True).values()) == {("start", None)}


def test_languages_of_records(spark):
    kind = "rec string, idx long, start_sample long, end_sample long, previous_hash string, language string, raw string, n_segments int"
    reason = lambda x: journal.verify_chain(spark.createDataFrame([("r", 0, 0, 10, "", x, "{}", 1)], kind), 10).first().reason
    assert [reason(x) for x in ("en", "zh-hant", "EN", "e n", "x" * 17, "en?")] == [None, None, "language", "language", "language", "language"]


def test_files_are_whole(spark, tmp_path):
    df = spark.createDataFrame([("a/1.txt", "x"), ("a/2.txt", None), ("b.txt", "é")], "name string, content string").repartition(2)
    assert sinks.write_files(df, str(tmp_path)) == 3
    assert {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*") if f.is_file()} == {"a/1.txt": "x", "a/2.txt": "", "b.txt": "é"}
    with pytest.raises(Exception, match="no name"):
        sinks.write_files(spark.createDataFrame([("../x", "y")], "name string, content string"), str(tmp_path))


def plain_diff(a, b, at=""):
    """Pointers of what differs, member by member; numbers by value."""
    if isinstance(a, dict) and isinstance(b, dict):
        names = [(n.replace("~", "~0").replace("/", "~1"), a.get(n, ...), b.get(n, ...)) for n in {**a, **b}]
    elif isinstance(a, list) and isinstance(b, list):
        names = [(str(i), a[i] if i < len(a) else ..., b[i] if i < len(b) else ...) for i in range(max(len(a), len(b)))]
    else:
        same = a is not ... and b is not ... and isinstance(a, bool) == isinstance(b, bool) and a == b
        return [] if same else [at]
    return [p for n, x, y in names for p in plain_diff(x, y, f"{at}/{n}")]


def test_nested_differences(spark):
    rng = np.random.default_rng(31)

    def made(depth):
        kind = rng.integers(0, 7 if depth else 5)
        if kind < 5:
            return [None, int(rng.integers(3)), "x", True, {}][kind]
        n = int(rng.integers(0, 4))
        return {str(k): made(depth - 1) for k in rng.choice(["a", "b/c", "~", "d"], n, replace=False)} if kind == 5 else [made(depth - 1) for _ in range(n)]

    def changed(x):
        if isinstance(x, dict):
            return {k: changed(v) for k, v in x.items() if rng.random() < 0.9}
        if isinstance(x, list):
            return [changed(v) for v in x][: None if rng.random() < 0.8 else 1]
        return x if rng.random() < 0.8 else made(1)

    docs = [{"top": made(4), "l": [made(2), made(2)]} for _ in range(60)]
    pairs = [(i, d, changed(d)) for i, d in enumerate(docs)]
    side = lambda n: spark.createDataFrame([(p[0], json.dumps(p[n])) for p in pairs], "job long, json string")
    got = runs.diff_json(side(1), side(2), "job").collect()
    assert sorted((r.job, r.pointer) for r in got) == sorted((i, p) for i, a, b in pairs for p in plain_diff(a, b)) and len(got) > 20
    fields = {r.job: r.fields for r in runs.differing_fields(side(1), side(2), "job").collect()}
    assert fields == {i: ", ".join(sorted(plain_diff(a, b))) for i, a, b in pairs if plain_diff(a, b)}


def test_a_journal_is_few_files(spark, tmp_path):
    n = sinks.RECORDS + 5
    made = spark.range(n).selectExpr("if(id % 2 = 0, 'a', 'b') as rec", "id div 2 as idx", """concat('{"index":', id div 2, ',"language":"é"}') as raw""").union(spark.range(n).selectExpr("'c'", "id", """concat('{"index":', id, '}')"""))
    sinks.write_journal(made, spark.createDataFrame([("c", "{}")], "rec string, raw string"), str(tmp_path))
    assert sorted(f.name for f in (tmp_path / "c").iterdir()) == ["chunks-0.jsonl", "chunks-1.jsonl", "manifest.json"] and len(list((tmp_path / "a").iterdir())) == 1
    (tmp_path / "a" / "chunk-7777.json").write_text('{"index":\n7777}')
    manifests, chunks = tables.read_journal(spark, str(tmp_path))
    got = {(r.rec, r["index"], r.raw) for r in chunks.collect()}
    assert got == {tuple(r) for r in made.collect()} | {("a", 7777, '{"index":\n7777}')} and [r.rec for r in manifests.collect()] == ["c"]
