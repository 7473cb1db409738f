"""Tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="timedtext-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where the session names none and all of it runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return folder or f"file://{_own_dir()}"


def fresh_path(spark: SparkSession, name: str, made: list[str] = _made) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made.append(path)
    return path


def written(df: DataFrame, name: str, made: list[str] = _made) -> DataFrame:
    """`df` as a Parquet table: it survives lost executors, and its size is known to the planner. `made` gets its path, for `clear`."""
    path = fresh_path(df.sparkSession, name, made)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, made: list[str] = _made) -> None:
    """Removes the tables that were written so far, or those of `made`; no DataFrame that was made from them can be used after that."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)
