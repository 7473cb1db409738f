"""Line dedup by range-partitioned line hashes, in DataFrame operations only.

1. Lines are hashed to 128 bits and written once.
2. The hashes are dealt by range and sorted by hash, document and position. A
   window over that order streams the first line of each document under a hash
   and counts the documents; it asks for no other exchange or sort. A hash that
   holds a large share of a sample of the lines is dealt by document, too, so
   that it is many tasks; its counts are added up from one row for each part.
3. What comes back is a keep bitmap for each document that loses a line, as the
   runs of lines that stay, and never text.

Defined cases: null or empty text is one empty line. Rows of one doc_id are one
document, also where their texts differ: a line that they share counts once, and
each row loses its own lines. A null doc_id is a value like any other. A very
long text is one row of hashes for each line. Repeated rows all get the same
result, and an empty table gives an empty one. Extra columns are carried; those
named kept_lines, n_lines, n_dropped or keep_runs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timedtext.llm import shared

MIN_DOCUMENTS, MIN_CODE_POINTS = 10, 1
#: Share of the lines that is looked at to find hashes that need many tasks; it has no effect on the result.
SAMPLED = 0.02
_ID, _TEXT = "__line_doc", "__line_text"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return shared.ascii_lower(F.btrim(line, F.lit(shared.BLANKS)))


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_code_points: int) -> DataFrame:
    """A row for each line that can be dropped: document, its number of lines, position and the key's hash."""
    rows = docs.select(F.col(doc_id).alias(_ID), F.xxhash64(text).alias(_TEXT), split_lines(F.col(text)).alias("lines"))
    lines = rows.select(_ID, _TEXT, F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select(_ID, _TEXT, "n", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.filter(F.char_length("key") >= min_code_points)
    return keyed.select(_ID, _TEXT, "n", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def heavy_hashes(lines: DataFrame, parts: int) -> DataFrame:
    """(h1, h2) of a quarter of a partition's share or more of a sample, so of at most 4 x `parts` hashes."""
    some = lines.select("h1", "h2").sample(SAMPLED, seed=9)
    counts = some.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 8")
    counts = shared.written(counts, "line-counts")
    total = some.agg(F.count("*").alias("all"))
    return counts.join(F.broadcast(total), F.col("c") * 4 * parts >= F.col("all")).select("h1", "h2", F.lit(True).alias("heavy"))


def streamed(lines: DataFrame) -> DataFrame:
    """`lines` with part, the task's share of a heavy hash (-1: all of the hash), documents, their number there, first, which tells the first line of all there, and lead, which tells one row of those.

    Repeated rows are first together, as they get the same result.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = shared.written(heavy_hashes(lines, parts), "heavy-lines")
    part = F.when(F.col("heavy"), F.pmod(F.xxhash64(_ID), F.lit(parts)).cast("int")).otherwise(F.lit(-1))
    dealt = lines.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("part", part).drop("heavy")
    order = [_ID, _TEXT, "pos"]
    ranged = dealt.repartitionByRange(parts, "h1", "h2", "part").sortWithinPartitions("h1", "h2", "part", *order)
    here = W.partitionBy("h1", "h2", "part")
    before = here.orderBy(*order)
    rows = ranged.withColumn("lead", F.row_number().over(before) == 1).withColumn("first", F.rank().over(before) == 1)
    rows = rows.withColumn("same", F.lag(F.struct(_ID)).over(before).eqNullSafe(F.struct(_ID)))
    return rows.withColumn("documents", F.count_if(~F.col("same")).over(here)).drop("same")


def dropped_lines(lines: DataFrame, min_documents: int, keep_first: bool) -> DataFrame:
    """The lines that go. Without heavy hashes, the window knows all; the parts of a heavy hash meet in a table of a row each."""
    found = streamed(lines).filter((F.col("part") >= 0) | (F.col("documents") >= min_documents))
    found = shared.written(found, "common-lines")
    parts = found.filter(F.col("lead") & (F.col("part") >= 0))
    whole = parts.groupBy("h1", "h2").agg(F.sum("documents").alias("all"), F.min(F.struct(_ID, _TEXT, "pos")).alias("low"))
    joined = found.join(F.broadcast(shared.written(whole, "heavy-totals")), ["h1", "h2"], "left")  # as many rows as heavy hashes
    gone = joined.filter(F.coalesce("all", "documents") >= min_documents)
    if keep_first:
        gone = gone.filter(~F.when(F.col("low").isNull(), F.col("first")).otherwise(F.struct(_ID, _TEXT, "pos").eqNullSafe(F.col("low"))))
    return gone.select(_ID, _TEXT, "n", "pos")


def keep_bitmaps(docs: DataFrame, doc_id="doc_id", text="text", min_documents=MIN_DOCUMENTS, min_code_points=MIN_CODE_POINTS, keep_first=False) -> DataFrame:
    """Per document and text with something to drop: its keep bitmap in run lengths, an array of (at, n) for each run of lines that stay.

    A line whose key is in at least `min_documents` documents goes everywhere; with `keep_first`, its first occurrence by document and position stays.
    """
    lines = shared.written(hashed_lines(docs, doc_id, text, min_code_points), "lines")
    gone = dropped_lines(lines, min_documents, keep_first)
    # repeated rows have the same positions more than once
    places = gone.groupBy(_ID, _TEXT).agg(F.max("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("gone"))
    edges = places.select(_ID, _TEXT, F.expr("concat(array(-1), gone, array(n))").alias("e"))
    runs = F.expr("filter(transform(e, (x, i) -> named_struct('at', x + 1, 'n', if(i + 1 < size(e), e[i + 1] - x - 1, 0))), r -> r.n > 0)")
    return edges.select(_ID, _TEXT, runs.alias("keep_runs"))


def dedup_lines(docs: DataFrame, doc_id="doc_id", text="text", **rule) -> DataFrame:
    """`docs` with the columns kept_lines, n_lines, n_dropped and keep_runs (null: all lines stay)."""
    docs = docs.drop("kept_lines", "n_lines", "n_dropped", "keep_runs")
    b = keep_bitmaps(docs, doc_id, text, **rule).select(F.col(_ID).alias("__b_id"), F.col(_TEXT).alias("__b_text"), "keep_runs")
    whole = docs.withColumn(_TEXT, F.xxhash64(text))
    joined = whole.join(b, whole[doc_id].eqNullSafe(b["__b_id"]) & (whole[_TEXT] == b["__b_text"]), "left").drop("__b_id", "__b_text", _TEXT)
    lines = split_lines(F.col(text))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["at"] + 1, r["n"])))
    out = joined.withColumn("kept_lines", F.when(F.col("keep_runs").isNull(), lines).otherwise(kept)).withColumn("n_lines", F.size(lines).cast("long"))
    return out.withColumn("n_dropped", F.col("n_lines") - F.size("kept_lines"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(shared.documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"))


_KEY = r"translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The kept text of each document of the relation {docs}.
KEPT_SQL = f"""
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE n IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n IS NULL), '') AS kept
  FROM (SELECT doc_id, pos, line, {_KEY} AS k FROM (
          SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {{docs}})))
  LEFT JOIN (SELECT k, count(DISTINCT doc_id) AS n FROM (
          SELECT doc_id, {_KEY} AS k FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {{docs}}))
        WHERE length(k) >= {MIN_CODE_POINTS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}) USING (k)
  GROUP BY doc_id"""
SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({KEPT_SQL.format(docs='documents')})"
