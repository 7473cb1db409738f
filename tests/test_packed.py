"""Publishing as versions: all or nothing, few files, ranges that can be read."""

import json

import pytest
from pyspark.sql import functions as F

from timedtext.sources import packed, sinks

SEG = "rec string, seq long, start_s double, end_s double, text string, no_speech_prob double, language string"


def transcripts(spark, n, mark=""):
    rows = [(f"r{k:03}", i, float(i), i + 0.5, f"line {i} of {k}{mark}.", 0.1, "en") for k in range(n) for i in range(k % 4 + 1)]
    rows += [("blank", 0, 0.0, 1.0, " ", 0.0, ""), ("bad", 0, float("nan"), 1.0, "x", 0.0, "en")]
    return spark.createDataFrame(rows, SEG)


def contents(spark, path):
    return {(r.rec, r.format): r.content for r in packed.read_published(spark, path).collect()}


def test_many_recordings_in_few_files(spark, tmp_path):
    df, path = transcripts(spark, 200), str(tmp_path / "out")
    failed, differs = packed.publish_packed(df, path)
    assert {(r.rec, r.reason) for r in failed.collect()} == {("blank", "no text"), ("bad", "invalid time")} and differs.count() == 0
    got = contents(spark, path)
    assert len(got) == 800 and len(list((tmp_path / "out").rglob("*.txt"))) <= 16
    lines = sinks.srt_rows(df.filter("rec = 'r007'")).orderBy("cue").collect()
    assert got["r007", "srt"] == "".join(r.value + "\n" for r in lines)
    assert got["r007", "vtt"].startswith("WEBVTT\n\n1\n00:00:00.000 --> ") and got["r003", "text"] == "line 0 of 3. line 1 of 3. line 2 of 3. line 3 of 3.\n"
    assert json.loads(got["r010", "json"])["source"] == "r010"
    # one of them by its place alone
    x = packed.index(spark, path).filter("rec = 'r150' and format = 'text'").first()
    with (tmp_path / "out" / x.file).open("rb") as f:
        f.seek(x.offset)
        assert f.read(x.length).decode() == got["r150", "text"]
    assert {r.rec for r in packed.read_published(spark, path, "rec = 'r150'").collect()} == {"r150"}


def test_a_killed_run_publishes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    packed.publish_packed(transcripts(spark, 5), path, ("text", "srt"))
    before, known = contents(spark, path), packed.versions(path)
    # a task fails between two formats
    lines = packed.renderings(transcripts(spark, 5, "!").filter("rec like 'r%'"), ("text", "srt"))
    broken = lines.withColumn("value", F.when((F.col("format") == "text") & (F.col("rec") == "r003"), F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):
        packed.stage(broken, path, "v-broken")
    assert contents(spark, path) == before and packed.versions(path) == known and packed.unfinished(path) == []
    # the driver dies behind the last task, before the version counts
    monkeypatch.setattr(packed, "promote", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        packed.publish_packed(transcripts(spark, 5, "!"), path, ("text", "srt"), version="v-2", overwrite=True)
    monkeypatch.undo()
    assert contents(spark, path) == before and packed.unfinished(path) == ["v-2"]
    # and the same run again goes through
    packed.publish_packed(transcripts(spark, 5, "!"), path, ("text", "srt"), version="v-2", overwrite=True)
    assert contents(spark, path)["r000", "text"] == "line 0 of 0!.\n" and packed.unfinished(path) == []


def test_what_differs_is_refused(spark, tmp_path):
    path = str(tmp_path / "out")
    packed.publish_packed(transcripts(spark, 4), path, ("text",), version="a")
    changed = transcripts(spark, 6).withColumn("text", F.when(F.col("rec") == "r002", F.lit("other")).otherwise(F.col("text")))
    _, differs = packed.publish_packed(changed, path, ("text",), version="b")
    assert [tuple(r) for r in differs.collect()] == [("r002", "text")]
    assert packed.versions(path) == ["a"] and packed.unfinished(path) == [] and len(contents(spark, path)) == 5
    # a repeat of what is there, and recordings that are new
    for version in ("c", "c"):
        assert packed.publish_packed(transcripts(spark, 6), path, ("text",), version=version)[1].count() == 0
    assert packed.versions(path) == ["a", "c"] and len(contents(spark, path)) == 7
    packed.publish_packed(changed, path, ("text",), version="d", overwrite=True)
    assert contents(spark, path)["r002", "text"] == "other other other\n"


def test_batches_of_a_stream_are_published_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        transcripts(spark, 6).filter(F.col("rec").isin(f"r00{2 * k}", f"r00{2 * k + 1}")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SEG).option("maxFilesPerTrigger", 1).parquet(source)
    for checkpoint in ("c", "c", "other"):  # the last one goes through all batches again
        packed.stream_packed(stream, path, str(tmp_path / checkpoint), ("text", "vtt")).awaitTermination()
        assert len(contents(spark, path)) == 12 and packed.versions(path) == ["batch-0", "batch-1", "batch-2"]


def test_nothing_to_publish(spark, tmp_path):
    path = str(tmp_path / "out")
    failed, _ = packed.publish_packed(transcripts(spark, 0), path)
    assert failed.count() == 2 and contents(spark, path) == {} and packed.index(spark, path).count() == 0
    assert contents(spark, str(tmp_path / "never")) == {}
