"""Planning of jobs: discovering media, naming outputs, and finding conflicts and finished work."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timedtext.functions.scratch import written

#: Extensions that count as media.
MEDIA = ("3gp", "aac", "aif", "aiff", "asf", "avi", "flac", "m2ts", "m4a", "m4b", "m4v", "mka", "mkv", "mov", "mp3", "mp4", "mpeg", "mpg", "mts", "oga", "ogg", "opus", "ts", "wav", "webm", "wma", "wmv")
#: Formats and their extensions.
FORMATS = {"json": ".json", "srt": ".srt", "text": ".txt", "vtt": ".vtt"}


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def directory(path: Column | str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def stem(path: Column | str) -> Column:
    """The file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(file_name(path), r"(?<=[^/])\.[^.]*\z", "")


def by_name_bytes(path: Column | str) -> Column:
    """Sort key: the file name's UTF-8 bytes, whatever the locale."""
    return F.encode(file_name(path), "UTF-8")


def sort_by_name_bytes(files: DataFrame, path="path") -> DataFrame:
    """`files` in the order of their names' bytes within each directory, numbered from 1 as `position`."""
    w = W.partitionBy(directory(path)).orderBy(by_name_bytes(path), *[c for c in files.columns if c != path])
    return files.withColumn("position", F.row_number().over(w).cast("long"))


def discover_media(files: DataFrame, path="path", extensions=MEDIA) -> DataFrame:
    """The media files of a listing by extension, whatever its case, sorted and numbered by directory."""
    extension = F.lower(F.regexp_extract(file_name(path), r"(?<=[^/])\.([^.]*)\z", 1))
    return sort_by_name_bytes(files.filter(extension.isin(*extensions)), path)


def explicit_inputs(lists: DataFrame, paths="paths") -> DataFrame:
    """One row for each path of an array, numbered from 1 in the given order."""
    others = [c for c in lists.columns if c != paths]
    return lists.select(*others, F.posexplode(paths).alias("pos", "path")).select(*others, (F.col("pos") + 1).cast("long").alias("position"), "path")


def expand_formats(jobs: DataFrame, formats="all") -> DataFrame:
    """One row for each job and format; `all` stands for every format."""
    wanted = sorted(FORMATS) if formats == "all" else [formats]
    if unknown := set(wanted) - set(FORMATS):
        raise ValueError(f"unknown format: {sorted(unknown)}")
    return jobs.withColumn("format", F.explode(F.array(*map(F.lit, wanted))))


def global_number(df: DataFrame, order: list[str], name="number") -> DataFrame:
    """`df` with numbers from 1 in the order of all rows.

    Rows are range-partitioned and numbered within; the counts of the partitions
    before, a row for each, give the rest. No task sorts the whole table.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(name, within).join(before, "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__before")


def numbered_names(inputs: DataFrame, prefix: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """`number` and `name`, prefix_001 and so on in the order of the inputs (of each group `by`); long numbers are never cut."""
    if not re.fullmatch("[A-Za-z0-9_-]+", prefix):
        raise ValueError("a prefix has letters, digits, underscores and hyphens only")
    numbered = inputs.withColumn("number", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")) if by else global_number(inputs, order)
    return numbered.withColumn("name", F.format_string(f"{prefix}_%03d", "number"))


def output_paths(jobs: DataFrame, formats="all", source="path", name: str | None = None, output_dir: str | None = None) -> DataFrame:
    """(job columns, format, target): stem, or the column `name`, with the format's extension, beside the source or in output_dir."""
    suffix = F.coalesce(*(F.when(F.col("format") == f, F.lit(x)) for f, x in FORMATS.items()))
    parent = F.lit(output_dir) if output_dir is not None else directory(source)
    return expand_formats(jobs, formats).withColumn("target", F.concat(parent, F.lit("/"), F.col(name) if name else stem(source), suffix))


def overwrites_input(outputs: DataFrame, inputs: DataFrame, target="target", path="path") -> DataFrame:
    """The outputs whose target is one of the inputs."""
    there = inputs.select(F.col(path).alias("__path"))
    return outputs.join(there, outputs[target] == there["__path"], "left_semi")


def output_collisions(outputs: DataFrame, target="target", source="source", job: str | None = None) -> DataFrame:
    """(target, n_sources, first_source) of the targets that several jobs have, or sources where jobs have no column; a target that one has twice is none."""
    return outputs.groupBy(target).agg(F.count_distinct(job or source).alias("n_sources"), F.min(source).alias("first_source")).filter("n_sources > 1")


def complete_sets(outputs: DataFrame, files: DataFrame, key="job") -> DataFrame:
    """(key, complete): whether all outputs of a job exist with bytes. outputs: key, target; files: path, bytes."""
    sizes = files.groupBy(F.col("path").alias("__path")).agg(F.max("bytes").alias("__bytes"))
    there = outputs.join(sizes, outputs["target"] == sizes["__path"], "left")
    return there.groupBy(key).agg(F.bool_and(F.coalesce(F.col("__bytes") > 0, F.lit(False))).alias("complete"))


def skip_existing(jobs: DataFrame, outputs: DataFrame, files: DataFrame, key="job", overwrite=False) -> DataFrame:
    """The jobs without a complete set of outputs; all of them with `overwrite`."""
    return jobs if overwrite else jobs.join(complete_sets(outputs, files, key).filter("complete"), key, "left_anti")


def missing_outputs(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of `requested` that `existing` does not have."""
    return requested.subtract(existing.select(requested.columns))


def check_mapping(saved: DataFrame, planned: DataFrame) -> DataFrame:
    """(number, saved_source, planned_source, status): same, changed, removed or added. A mapping holds if all are the same."""
    a, b = saved.select("number", F.col("source").alias("saved_source")), planned.select("number", F.col("source").alias("planned_source"))
    status = F.when(F.col("saved_source").eqNullSafe(F.col("planned_source")), "same").when(F.col("planned_source").isNull(), "removed").when(F.col("saved_source").isNull(), "added").otherwise("changed")
    return a.join(b, "number", "full_outer").withColumn("status", status)


def outputs_map(outputs: DataFrame, *key: str) -> DataFrame:
    """(key, outputs): a map of format to target, in the order of the formats."""
    return outputs.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "target")))).alias("outputs"))


def job_key(outputs: DataFrame, *key: str) -> DataFrame:
    """(key, job_key): SHA-256 of the output map as JSON with sorted keys."""
    return outputs_map(outputs, *key).select(*key, F.sha2(F.to_json("outputs"), 256).alias("job_key"))
