"""Tables in the shared folder."""

import os

import pytest

from timedtext.functions import scratch


def test_tables_are_written_and_removed(spark):
    df = scratch.written(spark.range(5), "numbers")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    scratch.clear(spark)
    assert not os.path.isdir(path)


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Elsewhere)
