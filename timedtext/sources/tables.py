"""Reading journals, transcripts and catalogs with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a larger record is refused.
RECORD_BYTES = 16 << 20
SEGMENT = "struct<start: double, `end`: double, text: string, no_speech_prob: double>"
CHUNK = f"index long, start_sample long, end_sample long, previous_hash string, language string, segments array<{SEGMENT}>"
MANIFEST = (
    "schema_version int, fingerprint struct<source: string, size: long, sha256: string, outputs: map<string, string>, run: map<string, string>, language: string, backend: string>, "
    "output_metadata struct<model: string, run: map<string, string>>, chunks long, samples long, languages array<string>, last_hash string, finished boolean, published_hashes map<string, string>"
)
TRANSCRIPT = (
    "schema_version int, source string, model string, language string, languages array<string>, language_probability double, duration double, duration_after_vad double, text string, "
    "segments array<struct<id: long, start: double, `end`: double, text: string, language: string, avg_logprob: double, compression_ratio: double, no_speech_prob: double>>, run map<string, string>, first_segment long"
)
CATALOG = "name string, file string, url string, sha256 string, bytes long"


def _parsed(raw: DataFrame, schema: str, limit: int = RECORD_BYTES) -> DataFrame:
    """`raw` with the fields of its records and `reason`, too large or unreadable: such a record has null fields, and one that is too large no text."""
    large = F.octet_length("raw") > limit
    rows = raw.withColumn("reason", F.when(large, "too large")).withColumn("raw", F.when(~large, F.col("raw"))).withColumn("r", F.from_json("raw", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(bad, "unreadable"))).withColumn("r", F.when(~bad, F.col("r")))
    return rows.select(*raw.columns, "reason", "r.*").drop("__bad")


def _records(spark: SparkSession, path: str, schema: str, names: str, whole: bool) -> DataFrame:
    """The records of the files of some names, one a file or one a line. Other files are not opened."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    raw = files.text(path, wholetext=whole, lineSep=None if whole else "\n").select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    return _parsed(raw.select("file", "raw"), schema).withColumn("rec", F.regexp_extract("file", r"([^/]+)/[^/]+\z", 1))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(rec, file, raw, reason, record fields) of the chunk records in a folder for each recording, one a file (chunk-N.json) or one a line (chunks-N.jsonl); `raw` keeps the bytes that the chain hashes, and reason tells records that are refused."""
    single = _records(spark, path, CHUNK, "chunk-*.json", True).filter(F.col("file").rlike(r"/chunk-\d+\.json\z"))
    lines = _records(spark, path, CHUNK, "chunks-*.jsonl", False).filter(F.col("file").rlike(r"/chunks-\d+\.jsonl\z"))
    return single.unionByName(lines)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, MANIFEST, "manifest.json", True)


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Manifests and chunk records of all recordings."""
    return read_manifests(spark, path), read_chunks(spark, path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """(rec, raw, reason, record fields) of a table of records that append_journal has written."""
    return _parsed(spark.read.parquet(path).select("rec", "raw"), CHUNK)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(source, seq, start_s, end_s, text, no_speech_prob, language) of schema-2 transcript documents, one a line; of those that are a part of a recording, seq goes on from first_segment."""
    docs = spark.read.schema(TRANSCRIPT).option("recursiveFileLookup", True).json(path).filter("schema_version = 2")
    rows = docs.select("source", F.coalesce("first_segment", F.lit(0).cast("long")).alias("first"), F.posexplode("segments").alias("pos", "s"))
    return rows.select("source", (F.col("first") + F.col("pos")).alias("seq"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.text", "s.no_speech_prob", "s.language")


def refused_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(raw, reason) of the documents that read_transcripts has no rows of: too large, unreadable, or of another schema."""
    rows = _parsed(spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("raw")), TRANSCRIPT)
    other = F.when(F.coalesce("schema_version", F.lit(0)) != 2, "other schema")
    return rows.select("raw", F.coalesce("reason", other).alias("reason")).filter("reason is not null")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, url, sha256, bytes) of artifact catalogs: a file has a JSON array or several, each beginning on a line of its own. What cannot be read is a row of nulls."""
    raw = spark.read.text(path, wholetext=True)
    others = [c for c in raw.columns if c != "value"]
    # a line feed is in no JSON string, and no array follows another but at the top
    arrays = raw.select(*others, F.explode(F.split("value", r"(?<=\])[ \t\r]*\n\s*(?=\[)")).alias("value")).filter(F.btrim("value", F.lit(" \t\r\n")) != "")
    kind = f"array<struct<{CATALOG.replace(' ', ': ').replace(',:', ',')}>>"
    rows = F.coalesce(F.from_json("value", kind), F.array(F.lit(None).cast(kind[6:-1])))
    return arrays.select(*others, F.explode(rows).alias("c")).select("c.*", *others)
