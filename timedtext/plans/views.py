"""The fixture views over the driver's tables, for Spark and for DuckDB.

Each view is written once, in the common subset of both dialects; only the
names of the hash function and of the sample view differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("conversations", "documents", "events", "embeddings", "customer", "orders", "lineitem", "nation", "region", "part", "supplier")

_RUNNING = "OVER (PARTITION BY rec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
VIEWS = {
    "seg_v": f"""
  SELECT rec, seq, end_ms - dur_ms AS start_ms, end_ms,
         CAST(end_ms - dur_ms AS DOUBLE) / 1000 AS start_s, CAST(end_ms AS DOUBLE) / 1000 AS end_s, text, language, no_speech_prob
  FROM (SELECT *, CAST(SUM(gap_ms + dur_ms) {_RUNNING} AS BIGINT) AS end_ms
        FROM (SELECT conv_id AS rec, turn AS seq, text, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'ru' ELSE 'en' END AS language,
                     CAST(200 + (40 * length(text)) % 9000 AS BIGINT) AS dur_ms,
                     CAST((conv_id * 7919 + turn * 104729) % 4000 AS BIGINT) AS gap_ms,
                     CAST((conv_id + turn) % 10 AS DOUBLE) / 10 AS no_speech_prob FROM conversations) AS b) AS t""",
    "docseg_v": f"""
  SELECT rec, seq, doc_id, end_ms - dur_ms AS start_ms, end_ms,
         CAST(end_ms - dur_ms AS DOUBLE) / 1000 AS start_s, CAST(end_ms AS DOUBLE) / 1000 AS end_s,
         text, language, CAST(doc_id % 10 AS DOUBLE) / 10 AS no_speech_prob
  FROM (SELECT *, CAST(SUM(gap_ms + dur_ms) {_RUNNING} AS BIGINT) AS end_ms
        FROM (SELECT source AS rec, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS seq,
                     doc_id, text, lang AS language, CAST(100 + n_chars % 7000 AS BIGINT) AS dur_ms,
                     CAST(doc_id * 7919 % 2600 AS BIGINT) AS gap_ms FROM documents) AS b) AS t""",
    "frames_v": f"""
  SELECT rec, seq,
         CASE WHEN event_type = 'signup' THEN NULL
              ELSE ideal + (event_id * 7919) % 2801 - 1400
                   + CASE WHEN event_id % 97 = 0 THEN 200000 WHEN event_id % 89 = 0 THEN -50000 ELSE 0 END END AS pts,
         n_samples, CAST(0 AS BIGINT) AS delay, CAST(1 AS BIGINT) AS tolerance, rec % 2 = 1 AS transport,
         CASE WHEN event_type = 'error' THEN -22 ELSE 0 END AS code,
         CASE WHEN event_type = 'view' THEN NULL ELSE CAST(n_samples AS DOUBLE) / 16000 END AS packet_seconds
  FROM (SELECT *, CAST(SUM(n_samples) {_RUNNING} AS BIGINT) - n_samples AS ideal
        FROM (SELECT user_id AS rec, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq,
                     event_id, event_type, CASE WHEN event_id % 101 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(1024 + event_id % 577 AS BIGINT) END AS n_samples FROM events) AS b) AS c""",
    "windows_v": """
  SELECT rec, CAST(floor(start_ms / 30000.0) AS BIGINT) AS win, seq,
         CAST(start_ms % 30000 AS BIGINT) * 16 AS start_sample,
         CAST(least(end_ms - CAST(floor(start_ms / 30000.0) AS BIGINT) * 30000, 30000) AS BIGINT) * 16 AS end_sample,
         CAST(480000 AS BIGINT) AS n_samples, CAST(480000 - (rec % 7) * 16000 AS BIGINT) AS preferred, CAST(32000 AS BIGINT) AS guard
  FROM seg_v""",
    "chunks_v": """
  SELECT rec, idx, idx * 480000 AS start_sample, (idx + 1) * 480000 AS end_sample,
         CASE WHEN doc_id % 53 = 0 THEN 'broken' ELSE coalesce(lag(SHA(raw)) OVER (PARTITION BY rec ORDER BY idx), '') END AS previous_hash,
         language, raw
  FROM (SELECT source AS rec, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS idx,
               doc_id, text AS raw, lang AS language FROM documents) AS s""",
    "paths_v": """
  SELECT doc_id AS input_index,
         'media/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'Lecture_' WHEN doc_id % 3 = 1 THEN 'lecture_' ELSE 'z_' END ||
         CAST(doc_id % 40 AS VARCHAR(10)) ||
         CASE doc_id % 6 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MP4' WHEN 2 THEN '.wav' WHEN 3 THEN '.txt' WHEN 4 THEN '.m2ts' ELSE '.flac' END AS path,
         n_chars AS bytes FROM documents""",
    "candidates_v": """
  SELECT event_id AS id, user_id AS rec, value AS start_s, value + CAST(event_id % 7 - 1 AS DOUBLE) AS end_s,
         CAST(event_id % 10 AS DOUBLE) / 10 AS no_speech_prob, CAST(400 AS DOUBLE) AS window_s,
         CASE WHEN event_id % 11 = 0 THEN 'EN' WHEN event_id % 13 = 0 THEN '' ELSE 'en' END AS language FROM events""",
    "measurements_v": """
  SELECT event_type AS device, CAST(event_id % 4 AS INT) AS round, value AS seconds, CAST(1000 + event_id % 5000 AS BIGINT) AS rss_kib,
         CAST(1500 AS BIGINT) AS vram_baseline_mib, CAST(1500 + event_id % 900 AS BIGINT) AS vram_peak_mib FROM events""",
    "expected_v": "SELECT doc_id AS job, lang AS language, source AS model, n_chars AS size, CAST(doc_id % 4 AS INT) AS beam FROM documents",
    "actual_v": """
  SELECT doc_id AS job, CASE WHEN doc_id % 17 = 0 THEN 'xx' ELSE lang END AS language, source AS model,
         CASE WHEN doc_id % 19 = 0 THEN n_chars + 1 ELSE n_chars END AS size,
         CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST(doc_id % 4 AS INT) END AS beam FROM documents""",
    "pcm_v": None,
}
_PCM_SPARK = "SELECT vec_id AS rec, CAST(pos AS BIGINT) AS i, CASE WHEN vec_id % 7 = 0 THEN CAST(0 AS FLOAT) ELSE x END AS x FROM embeddings LATERAL VIEW posexplode(embedding) AS pos, x"
_PCM_DUCKDB = "SELECT vec_id AS rec, generate_subscripts(embedding, 1) - 1 AS i, CASE WHEN vec_id % 7 = 0 THEN 0::FLOAT ELSE unnest(embedding) END AS x FROM embeddings"
#: As in VIEWS, but for where the texts go: they are joined to the order, as the window over a source would take all of its texts through one task. A doc_id is one document.
_CHUNKS_SPARK = """
  SELECT n.rec, n.idx, n.idx * 480000 AS start_sample, (n.idx + 1) * 480000 AS end_sample, n.previous_hash, d.lang AS language, d.text AS raw
  FROM (SELECT source AS rec, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS idx,
               CASE WHEN doc_id % 53 = 0 THEN 'broken' ELSE coalesce(lag(sha2(text, 256)) OVER (PARTITION BY source ORDER BY doc_id), '') END AS previous_hash FROM documents) AS n
  JOIN documents AS d ON n.doc_id = d.doc_id"""
_DOCSEG_SPARK = f"""
  SELECT n.rec, n.seq, n.doc_id, n.end_ms - n.dur_ms AS start_ms, n.end_ms,
         CAST(n.end_ms - n.dur_ms AS DOUBLE) / 1000 AS start_s, CAST(n.end_ms AS DOUBLE) / 1000 AS end_s,
         d.text, n.language, CAST(n.doc_id % 10 AS DOUBLE) / 10 AS no_speech_prob
  FROM (SELECT *, CAST(SUM(gap_ms + dur_ms) {_RUNNING} AS BIGINT) AS end_ms
        FROM (SELECT source AS rec, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS seq,
                     doc_id, lang AS language, CAST(100 + n_chars % 7000 AS BIGINT) AS dur_ms,
                     CAST(doc_id * 7919 % 2600 AS BIGINT) AS gap_ms FROM documents) AS b) AS n
  JOIN documents AS d ON n.doc_id = d.doc_id"""
_SPARK = {"pcm_v": _PCM_SPARK, "chunks_v": _CHUNKS_SPARK, "docseg_v": _DOCSEG_SPARK}


def _needs(sql: str) -> list[str]:
    """Names of the views that `sql` uses, those they need first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in [*_needs(VIEWS[name] or ""), name] if x not in out]
    return out


def duckdb(sql: str) -> str:
    """`sql` with the views that it uses as common table expressions."""
    ctes = [f"{n} AS ({VIEWS[n].replace('SHA(', 'sha256(') if VIEWS[n] else _PCM_DUCKDB})" for n in _needs(sql)]
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql) if (follows := re.match(r"\s*WITH\b", sql)) else sql
    return "WITH RECURSIVE " + ", ".join(ctes) + (", " if ctes else "") + body if follows else ("WITH RECURSIVE " + ", ".join(ctes) + "\n" if ctes else "") + body


class Views:
    """Tables and fixture views of one folder as attributes, read when they are used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        sql = _SPARK.get(name) or VIEWS[name]
        used = [n for n in (*TABLES, *VIEWS) if re.search(rf"\b{n}\b", sql)]
        for n in used:
            sql = re.sub(rf"\b{n}\b", f"{{{n}}}", sql)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in used})
