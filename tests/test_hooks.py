"""Progress hooks on streams and batches."""

import pytest
from pyspark.sql import functions as F

from timedtext.operators import journal
from timedtext.streaming import hooks
from timedtext.streaming import operators as streams


def commits(spark, low, high):
    return spark.range(low, high).select(F.lit("r").alias("rec"), F.col("id").alias("idx"), (F.col("id") * 160_000).alias("start_sample"), ((F.col("id") + 1) * 160_000).alias("end_sample")).coalesce(1)


def test_progress_is_that_of_the_operator(spark):
    clock = iter([10.0, 12.0, 20.0, 21.0])
    p = hooks.Progress(30.0, lambda: next(clock))
    got = [p.add(160_000, 1) for _ in range(4)]
    rows = [("r", i, (i + 1) * 160_000, 30.0, e) for i, e in enumerate([0.0, 2.0, 10.0, 11.0])]
    want = journal.progress(spark.createDataFrame(rows, "rec string, idx long, end_sample long, total double, spent double"), "total", "spent").orderBy("idx").collect()
    assert [(x["position_s"], x["percent"], x["left_s"]) for x in got] == [(w.position_s, w.percent, w.eta_s) for w in want]
    assert got[-1]["percent"] is None and got[2]["percent"] == 99


def test_a_stream_tells_how_far_it_has_come(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        commits(spark, 4 * k, 4 * k + 4).write.mode("append").parquet(source)
    told = []
    listener = hooks.listen(spark, told.append, 120.0)
    try:
        stream, _ = journal.observed(streams.stream_table(spark, source, commits(spark, 0, 1).schema))
        streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert [x["position_s"] for x in told] == [40.0, 80.0, 120.0, 120.0] and [x["percent"] for x in told] == [33, 66, 99, 100]
    assert told[0]["left_s"] is None and told[1]["left_s"] > 0 and told[2]["left_s"] == 0 and told[-1]["chunks"] == 12
    assert listener.error is None


def test_batches_tell_how_far_they_have_come(spark, tmp_path):
    told = []
    parts = [commits(spark, 0, 3), commits(spark, 3, 4)]
    hooks.run_in_batches(parts, lambda df: df.write.mode("append").parquet(str(tmp_path / "out")), told.append, 40.0)
    assert [(x["position_s"], x["chunks"], x["percent"]) for x in told] == [(30.0, 3, 75), (40.0, 4, 99)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    with pytest.raises(ZeroDivisionError):
        hooks.run_in_batches(parts, lambda df: 1 / 0, told.append)
