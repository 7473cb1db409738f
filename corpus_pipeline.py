"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's `docs`. All but the last return
the columns of documents. Extra columns are carried; one that has a name of an
operator's result gets that result.

Defined cases, in all stages: rows are told apart as rows, so repeated rows and
rows with one id or a null id are handled each. A null or empty text has a score
like others, loses no line, links with nothing, has its place in the mix and no
tokens; a text that was null stays null. Very long texts are worked on whole. A
null source is one of its own. Ties between near-duplicates go to the smaller
id, then to the row that comes first. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import bpe, line_dedup, mixing, near_dup, quality, shared

def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).filter(F.col("score") >= quality.THRESHOLD).select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the lines out that at least ten documents share; no document goes."""
    done = line_dedup.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.array_join("kept_lines", "\n")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("new_text", text).withColumn("n_chars", n_chars).withColumn("text", F.col("new_text")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each group of near-duplicates, the one of smallest id (a null id comes last); rows are told apart by a number, not by doc_id."""
    number = max(docs.columns, key=len) + "_row"  # a name that no column has
    rows = shared.written(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(number).alias("row")).alias("key")
    found = near_dup.near_duplicates(rows.select(key, "text"), doc_id="key")
    # the rows that go are far fewer than those that stay
    gone = shared.written(found.filter("NOT kept").select(F.col("doc_id.row").alias(number)), "gone")
    return rows.join(gone, number, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays all documents out in the order of the mix: files and their rows follow the interleaved blocks."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("mix_slot", "mix_row").sortWithinPartitions("mix_slot", "mix_row").select(docs.columns)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number, and mix_file and mix_row, the document's place in the mix.

    The stage before has laid the mix out in files and rows, so that is a document's
    place, however readers deal files and rows out; it is not worked out again.
    """
    placed = docs.drop("mix_file", "mix_row")
    try:
        placed = placed.select("*", F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:  # a table that is not in files has the order of its rows
        placed = placed.select("*", F.lit("").alias("mix_file"), F.monotonically_increasing_id().alias("mix_row"))
    coded = bpe.encode(placed, keep=[c for c in placed.columns if c not in ("text", "ids", "n_tokens")])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_common_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_text),
]
#: The classifier and BPE are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.written(docs, f"stage-{i}")
    return docs
