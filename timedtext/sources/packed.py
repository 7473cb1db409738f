"""Publishing renderings of many recordings as few files, all at once or not at all.

Renderings are written in ranges of recordings, one file a task and format, with an
index of where each recording lies in its file, how long it is and what its hash is.
All of that is a version in a folder of its own that nobody reads yet. When it is
whole and does not differ from what was published before, one small file, which names
the versions that count, is replaced. A run that is killed at any place before that
leaves what is published as it was; its folder is removed when it is noticed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from timedtext.functions import text as t
from timedtext.functions.scratch import written
from timedtext.sources import sinks

CURRENT = "current.json"
INDEX = pa.schema([("rec", pa.string()), ("format", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("hash", pa.string())])
_DDL = "rec string, format string, file string, offset long, length long, hash string"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: the name that its files have in common."""

    name: str
    rows: int


class PackedSink(DataSource):
    """Rows (rec, format, value), sorted by format and recording, as files of a version. Options: path, version."""

    @classmethod
    def name(cls) -> str:
        return "packed_text"

    def writer(self, schema: T.StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], self.options["version"])


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, version: str) -> None:
        self.path, self.version = path, version

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, top = store_of(self.path)
        top, name = f"{top}/{self.version}", f"part-{uuid.uuid4().hex}"
        out, file, key, begin, digest, size = None, "", None, 0, None, 0
        found: list[tuple] = []

        def close_recording() -> None:
            if key is not None:
                found.append((*key, file, begin, size - begin, digest.hexdigest()))

        try:
            for b in iterator:
                for rec, form, value in zip(*(b.column(c).to_pylist() for c in ("rec", "format", "value")), strict=True):
                    if key != (rec, form):
                        close_recording()
                        if key is None or key[1] != form:
                            if out is not None:
                                out.close()
                            file, size = f"{self.version}/{form}/{name}.txt", 0
                            store.create_dir(f"{top}/{form}")
                            out = store.open_output_stream(f"{top}/{form}/{name}.txt")
                        key, begin, digest = (rec, form), size, hashlib.sha256()
                    data = (value or "").encode() + b"\n"
                    out.write(data)
                    digest.update(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        close_recording()
        if found:
            store.create_dir(f"{top}/index")
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), INDEX, strict=True)]
            pq.write_table(pa.Table.from_arrays(columns, schema=INDEX), f"{top}/index/{name}.parquet", filesystem=store)
        return Part(name, len(found))

    def commit(self, messages: list[Part | None]) -> None:
        """Lists the parts that count, one a task; those of tasks that ran twice don't."""
        store, top = store_of(self.path)
        names = sorted(m.name for m in messages if m and m.rows)
        store.create_dir(f"{top}/{self.version}")
        _put(store, f"{top}/{self.version}/parts.json", json.dumps(names))

    def abort(self, messages: list[Part | None]) -> None:
        discard(self.path, self.version)


def _put(store: fs.FileSystem, path: str, text: str) -> None:
    """Replaces a file as a whole."""
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(text.encode())
    store.move(part, path)


def _get(store: fs.FileSystem, path: str, default):
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return default
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def versions(path: str) -> list[str]:
    """The versions that count, in the order in which they were published."""
    store, top = store_of(path)
    return _get(store, f"{top}/{CURRENT}", [])


def discard(path: str, version: str) -> None:
    """Removes a version that does not count."""
    store, top = store_of(path)
    if version not in versions(path) and store.get_file_info(f"{top}/{version}").type == fs.FileType.Directory:
        store.delete_dir(f"{top}/{version}")


def unfinished(path: str) -> list[str]:
    """The versions of runs that were killed, or are still at work."""
    store, top = store_of(path)
    if store.get_file_info(top).type == fs.FileType.NotFound:
        return []
    known = set(versions(path))
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.Directory and f.base_name not in known)


def renderings(segs: DataFrame, formats=("text", "srt", "vtt", "json"), headers: DataFrame | None = None, pause_ms=2000, key="rec") -> DataFrame:
    """(rec, format, place, value): the lines of each recording in each format, in the order of place."""
    headers = sinks.default_headers(segs, key) if headers is None else headers
    rows = {
        "text": lambda: sinks.text_rows(segs, pause_ms, key=key).withColumnRenamed("paragraph", "place"),
        "srt": lambda: sinks.srt_rows(segs, key).withColumnRenamed("cue", "place"),
        "vtt": lambda: sinks.vtt_rows(segs, key).withColumnRenamed("cue", "place"),
        "json": lambda: sinks.json_documents(segs, headers, pause_ms, key=key),
    }
    out = None
    for f in formats:
        part = rows[f]().select(F.col(key).cast("string").alias("rec"), F.lit(f).alias("format"), F.col("place").cast("long").alias("place"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def stage(lines: DataFrame, path: str, version: str) -> None:
    """Writes (rec, format, place, value) as a version that does not count yet."""
    lines.sparkSession.dataSource.register(PackedSink)
    order = ["format", "rec"]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order, "place").select("rec", "format", "value")
    rows.write.format("packed_text").option("path", path).option("version", version).mode("append").save()


def _indexed(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The index of some versions, with `turn`, their number."""
    store, top = store_of(path)
    out = spark.createDataFrame([], f"{_DDL}, turn int")
    for i, v in enumerate(names):
        parts = _get(store, f"{top}/{v}/parts.json", [])
        if parts:
            rows = spark.read.schema(_DDL).parquet(*[f"{path}/{v}/index/{p}.parquet" for p in parts])
            out = out.unionByName(rows.withColumn("turn", F.lit(i)))
    return out


def index(spark: SparkSession, path: str) -> DataFrame:
    """(rec, format, file, offset, length, hash) of what is published; of a recording in several versions, the last counts."""
    rows = _indexed(spark, path, versions(path))
    last = F.row_number().over(W.partitionBy("rec", "format").orderBy(F.desc("turn")))
    return rows.withColumn("n", last).filter("n = 1").drop("n", "turn")


def promote(spark: SparkSession, path: str, version: str, overwrite=False) -> DataFrame:
    """Makes a staged version count, and returns (rec, format) of what differs from what was published before. Unless `overwrite`, the version is refused where there are any, and discarded."""
    known = versions(path)
    if version in known:  # a repeat
        return spark.createDataFrame([], "rec string, format string")
    new, old = _indexed(spark, path, [version]), index(spark, path)
    differs = new.join(old.select("rec", "format", F.col("hash").alias("was")), ["rec", "format"]).filter("hash <> was").select("rec", "format")
    differs = spark.createDataFrame(differs.toArrow()) if not overwrite else differs  # it is read before the version goes
    if not overwrite and differs.limit(1).count():
        discard(path, version)
        return differs
    store, top = store_of(path)
    _put(store, f"{top}/{CURRENT}", json.dumps([*known, version]))
    return differs


def publish_packed(segs: DataFrame, path: str, formats=("text", "srt", "vtt", "json"), headers: DataFrame | None = None, pause_ms=2000, key="rec", version: str | None = None, overwrite=False) -> tuple[DataFrame, DataFrame]:
    """Publishes every requested format of all recordings at once. Returns (rec, reason) of recordings that are refused, as publish_all does, and (rec, format) of what differs from an earlier publication, which is not published unless `overwrite`.

    With a `version` of the caller's, such as a batch of a stream, a repeat of it
    changes nothing. One run at a time may publish to a path.
    """
    version = version or f"v-{uuid.uuid4().hex}"
    segs = segs.persist()
    try:
        blank = segs.groupBy(key).agg(F.max((t.trim_text("text") != "").cast("int")).alias("n")).filter("coalesce(n, 0) = 0").select(key, F.lit("no text").alias("reason"))
        for caption in ("srt", "vtt"):
            if caption in formats:
                blank = blank.unionByName(sinks.refused_cues(segs, caption, key=key).select(key, F.lit("invalid time").alias("reason")))
        failed = blank.groupBy(key).agg(F.max("reason").alias("reason"))
        failed = written(failed, "refused")
        if version not in versions(path):
            discard(path, version)  # what a killed run of this version has left
            stage(renderings(segs.join(failed, key, "left_anti"), formats, headers, pause_ms, key), path, version)
        return failed, promote(segs.sparkSession, path, version, overwrite)
    finally:
        segs.unpersist()


def read_published(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """(rec, format, content) of what is published; `where` picks rows of the index, and only their ranges of files are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(path)
        name, file = None, None
        for b in batches:
            out = []
            for at, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if at != name:
                    if file is not None:
                        file.close()
                    name, file = at, store.open_input_file(f"{top}/{at}")
                out.append(file.read_at(length, offset).decode())
            yield pa.RecordBatch.from_arrays([b.column("rec"), b.column("format"), pa.array(out, pa.string())], ["rec", "format", "content"])

    rows = index(spark, path).filter(where).repartition("file").sortWithinPartitions("file", "offset")
    return rows.select("rec", "format", "file", "offset", "length").mapInArrow(run, "rec string, format string, content string")


def stream_packed(segs: DataFrame, path: str, checkpoint: str, formats=("text", "srt", "vtt", "json"), **how) -> StreamingQuery:
    """publish_packed for each batch of a stream of whole recordings; a batch is a version, so that one that is run again is published once."""
    return segs.writeStream.foreachBatch(lambda df, n: publish_packed(df, path, formats, version=f"batch-{n}", **how) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
