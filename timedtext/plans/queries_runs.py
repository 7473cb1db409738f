"""Queries on jobs, journals, runs and settings. Q: name to (query on the views, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from timedtext.operators import jobs as j
from timedtext.operators import journal, runs
from timedtext.sources import sinks

LIMIT = 480_000
NAME = r"regexp_extract(path, '([^/]*)$', 1)"
STEM = rf"regexp_replace({NAME}, '\.[^.]*$', '')"
DIR = r"regexp_extract(path, '^(.*)/[^/]*$', 1)"
EXT = rf"lower(regexp_extract({NAME}, '\.([^.]*)$', 1))"
#: One row for each input and format, with the output's path.
OUTPUTS = f"""outputs AS MATERIALIZED (
  SELECT input_index, path, bytes, format, {DIR} || '/' || {STEM} || ext AS target
  FROM paths_v, (VALUES ('json', '.json'), ('srt', '.srt'), ('text', '.txt'), ('vtt', '.vtt')) AS f(format, ext))"""
NUMBERED = "numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY input_index) AS number FROM paths_v)"
#: A listing of what is there: some outputs are missing, some are empty.
FILES = "files AS MATERIALIZED (SELECT target AS path, CASE WHEN input_index % 40 % 11 = 0 THEN 0 ELSE bytes END AS bytes FROM outputs WHERE (input_index % 40 + length(format)) % 7 <> 0)"
COMPLETE = "complete AS (SELECT input_index, bool_and(coalesce(b > 0, false)) AS complete FROM outputs LEFT JOIN (SELECT path, max(bytes) AS b FROM files GROUP BY path) x ON x.path = target GROUP BY input_index)"
SETTINGS = """
  a AS (SELECT job, unnest(['/language', '/model', '/size', '/beam']) AS pointer, unnest([language, model, size::VARCHAR, beam::VARCHAR]) AS value FROM expected_v),
  b AS (SELECT job, unnest(['/language', '/model', '/size', '/beam']) AS pointer, unnest([language, model, size::VARCHAR, beam::VARCHAR]) AS value FROM actual_v),
  sa AS (SELECT * FROM a WHERE value IS NOT NULL), sb AS (SELECT * FROM b WHERE value IS NOT NULL),
  diff AS (SELECT job, pointer, sa.value AS saved, sb.value AS current FROM sa FULL JOIN sb USING (job, pointer) WHERE sa.value IS DISTINCT FROM sb.value)"""
MANIFESTS = "m AS MATERIALIZED (SELECT rec, count(*) - 2 AS chunks, (count(*) - 2) * 480000 AS samples, arg_max(sha256(raw), idx) FILTER (WHERE idx < n - 2) AS last_hash FROM (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM chunks_v) GROUP BY rec)"
CHAIN = """v AS (SELECT rec, idx, CASE WHEN idx <> row_number() OVER w - 1 THEN 'index' WHEN start_sample <> coalesce(lag(end_sample) OVER w, 0) THEN 'start'
           WHEN end_sample - start_sample NOT BETWEEN 1 AND 480000 THEN 'length' WHEN previous_hash <> coalesce(lag(sha256(raw)) OVER w, '') THEN 'hash' END AS reason
         FROM chunks_v WINDOW w AS (PARTITION BY rec ORDER BY idx))"""
REASON = "CASE WHEN start_s < 10 THEN 'starts too early' WHEN end_s < start_s THEN 'ends before its start' WHEN end_s > 100 THEN 'ends too late' END"
EXPECTED_HASH = "(SELECT rec, seq, sha256(text) AS hash, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS fh FROM docseg_v)"
CATALOG = "(SELECT 'm' || doc_id AS name, n_chars AS bytes, sha256(text) AS sha256, doc_id, text FROM documents)"


def outputs(v):
    return j.output_paths(v.paths_v)


def files(v):
    rows = outputs(v).filter((F.col("input_index") % 40 + F.length("format")) % 7 != 0)
    return rows.select(F.col("target").alias("path"), F.when(F.col("input_index") % 40 % 11 == 0, 0).otherwise(F.col("bytes")).alias("bytes"))


def manifests(v):
    """All but the last two chunks of each recording as committed."""
    c = v.chunks_v
    n = c.groupBy("rec").agg((F.count("*") - 2).alias("chunks"))
    return journal.recording_totals(c.join(n, "rec").filter("idx < chunks").drop("chunks")).drop("duration_s")


def results(v):
    """Validated candidates as results of jobs."""
    c = v.candidates_v
    reason = F.when(F.col("start_s") < 10, "starts too early").when(F.col("end_s") < F.col("start_s"), "ends before its start").when(F.col("end_s") > 100, "ends too late")
    return c.select("rec", F.col("id").alias("seq"), reason.alias("reason")).withColumn("status", F.when(F.col("reason").isNotNull(), "failed").when(F.col("seq") % 3 == 0, "skipped").otherwise("done"))


def audit(v):
    d = v.documents
    catalog = d.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("name"), F.col("doc_id").alias("file"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    size = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars"))
    there = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("file"), size.alias("size"), F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.sha2("text", 256)).alias("hash"))
    return runs.audit_artifacts(catalog, there)


def aliases(v):
    d = v.documents.select("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("name"))
    catalog = d.filter("doc_id % 3 = 0").select(F.col("name").alias("alias"), F.concat(F.lit("catalog/"), "name").alias("target"))
    local = d.filter("doc_id % 2 = 0").select(F.col("name").alias("alias"), F.concat(F.lit("local/"), "name").alias("target"))
    return runs.resolve_alias(d.select("name"), catalog, local)


def mapping(v, changed=False):
    """Inputs numbered in their order; the changed one has other paths and fewer inputs."""
    rows = v.paths_v
    if changed:
        rows = rows.filter("input_index % 50 <> 49").withColumn("path", F.when(F.col("input_index") % 13 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")))
    return rows.select((F.col("input_index") + 1).alias("number"), F.col("path").alias("source"))


def published(v):
    d = v.docseg_v.select("rec", F.col("seq").alias("format"), "doc_id", "text")
    h = F.sha2("text", 256)
    found = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(h)
    return runs.reconcile_outputs(d.select("rec", "format", h.alias("hash")), d.select("rec", "format", found.alias("file_hash")).filter("file_hash is not null"))


def run_settings(v):
    e = v.expected_v
    pairs = [x for c in ("language", "model", "threads", "version") for x in (F.lit(c), F.col(c).cast("string"))]
    return e.withColumn("threads", F.col("beam")).withColumn("version", F.lit("1")).select("job", runs.strip_execution_keys(F.create_map(*pairs)).alias("run"))


def linked(v):
    c = v.docseg_v.select("rec", F.col("seq").alias("idx"), F.concat(F.lit('{"index":'), F.col("seq").cast("string"), F.lit(',"previous_hash":"')).alias("head"), F.concat(F.lit('","text":'), F.sha2("text", 256), F.lit("}")).alias("tail"))
    return journal.link_chain(c)


def _json_of(v, rest):
    return v.events.select("event_id", F.concat(F.lit('{"p":'), "props", rest, F.lit("}")).alias("json"))


def _changed_json():
    k = F.col("event_id") % 5
    return F.when(k == 0, ',"l":[1,{"a/b":2.5}],"n":null,"x":{"y":[]}').when(k == 1, ',"l":[1],"n":null').when(k == 2, ',"l":[1,{"a/b":"2.5"}],"n":null').when(k == 3, ',"l":[1.0,{"a/b":2.5}]').otherwise(',"n":null,"l":[1,{"a/b":2.50}]')


Q = {
    "discover_media": (
        lambda v: j.discover_media(v.paths_v).select("input_index", "path", "position"),
        f"""SELECT input_index, path, row_number() OVER (PARTITION BY {DIR} ORDER BY encode({NAME}), input_index) AS position FROM paths_v
            WHERE {EXT} IN ('3gp', 'aac', 'aif', 'aiff', 'asf', 'avi', 'flac', 'm2ts', 'm4a', 'm4b', 'm4v', 'mka', 'mkv', 'mov', 'mp3', 'mp4', 'mpeg', 'mpg', 'mts', 'oga', 'ogg', 'opus', 'ts', 'wav', 'webm', 'wma', 'wmv')""",
    ),
    "sort_by_name_bytes": (
        lambda v: j.sort_by_name_bytes(v.paths_v).select("input_index", "position"),
        f"SELECT input_index, row_number() OVER (PARTITION BY {DIR} ORDER BY encode({NAME}), input_index) AS position FROM paths_v",
    ),
    "explicit_inputs": (
        lambda v: j.explicit_inputs(v.paths_v.groupBy(F.floor(F.col("input_index") / 10).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("input_index", "path"))), lambda x: x["path"]).alias("paths"))),
        "SELECT input_index // 10 AS batch, row_number() OVER (PARTITION BY input_index // 10 ORDER BY input_index) AS position, path FROM paths_v",
    ),
    "expand_formats": (lambda v: j.expand_formats(v.paths_v.select("input_index")), f"WITH {OUTPUTS} SELECT input_index, format FROM outputs"),
    "output_paths": (lambda v: outputs(v).select("input_index", "format", "target"), f"WITH {OUTPUTS} SELECT input_index, format, target FROM outputs"),
    "output_paths_numbered": (
        lambda v: j.output_paths(j.numbered_names(v.paths_v, "clip", ["input_index"]), "srt", name="name", output_dir="out").select("input_index", "format", "target"),
        f"WITH {NUMBERED} SELECT input_index, 'srt' AS format, printf('out/clip_%03d.srt', number) AS target FROM numbered",
    ),
    "numbered_names": (
        lambda v: j.numbered_names(v.paths_v, "clip", ["input_index"], [j.directory("path")]).select("input_index", "number", "name"),
        f"SELECT input_index, number, printf('clip_%03d', number) AS name FROM (SELECT *, row_number() OVER (PARTITION BY {DIR} ORDER BY input_index) AS number FROM paths_v)",
    ),
    "overwrites_input": (
        lambda v: j.overwrites_input(outputs(v).select("input_index", "format", "target"), v.paths_v),
        f"WITH {OUTPUTS} SELECT input_index, format, target FROM outputs WHERE target IN (SELECT path FROM paths_v)",
    ),
    "output_collisions": (
        lambda v: j.output_collisions(outputs(v), source="path", job="input_index"),
        f"WITH {OUTPUTS} SELECT target, count(*) AS n_sources, min(path) AS first_source FROM outputs GROUP BY target HAVING count(*) > 1",
    ),
    "complete_sets": (lambda v: j.complete_sets(outputs(v), files(v), "input_index"), f"WITH {OUTPUTS}, {FILES}, {COMPLETE} SELECT * FROM complete"),
    "skip_existing": (
        lambda v: j.skip_existing(v.paths_v.select("input_index"), outputs(v), files(v), "input_index"),
        f"WITH {OUTPUTS}, {FILES}, {COMPLETE} SELECT input_index FROM paths_v WHERE input_index NOT IN (SELECT input_index FROM complete WHERE complete)",
    ),
    "missing_outputs": (
        lambda v: j.missing_outputs(outputs(v).select("input_index", F.col("target").alias("path")), outputs(v).join(files(v).select("path").distinct().withColumnRenamed("path", "p"), F.col("target") == F.col("p")).select("input_index", F.col("target").alias("path"))),
        f"WITH {OUTPUTS}, {FILES} SELECT DISTINCT input_index, target AS path FROM outputs WHERE target NOT IN (SELECT path FROM files)",
    ),
    "check_mapping": (
        lambda v: j.check_mapping(mapping(v), mapping(v, True)),
        """SELECT number, s AS saved_source, p AS planned_source, CASE WHEN s IS NOT DISTINCT FROM p THEN 'same' WHEN p IS NULL THEN 'removed' WHEN s IS NULL THEN 'added' ELSE 'changed' END AS status
           FROM (SELECT input_index + 1 AS number, path AS s FROM paths_v)
           FULL JOIN (SELECT input_index + 1 AS number, CASE WHEN input_index % 13 = 0 THEN path || '.new' ELSE path END AS p FROM paths_v WHERE input_index % 50 <> 49) USING (number)""",
    ),
    "outputs_map": (
        lambda v: j.outputs_map(outputs(v), "input_index").withColumn("outputs", F.to_json("outputs")),
        f"""WITH {OUTPUTS} SELECT input_index, '{{' || string_agg('"' || format || '":"' || target || '"', ',' ORDER BY format) || '}}' AS outputs FROM outputs GROUP BY input_index""",
    ),
    "job_key": (
        lambda v: j.job_key(outputs(v), "input_index"),
        f"""WITH {OUTPUTS} SELECT input_index, sha256('{{' || string_agg('"' || format || '":"' || target || '"', ',' ORDER BY format) || '}}') AS job_key FROM outputs GROUP BY input_index""",
    ),
    "write_mapping": (
        lambda v: sinks.mapping_rows(outputs(v), "clip", "input_index").select("number", "name", "source", F.to_json("outputs").alias("outputs")),
        f"""WITH {OUTPUTS}, {NUMBERED} SELECT any_value(number) AS number, printf('clip_%03d', any_value(number)) AS name, any_value(n.path) AS source,
              '{{' || string_agg('"' || format || '":"' || target || '"', ',' ORDER BY format) || '}}' AS outputs FROM outputs JOIN numbered n USING (input_index) GROUP BY input_index""",
    ),
    "diff_settings": (lambda v: runs.diff_settings(v.expected_v, v.actual_v), f"WITH {SETTINGS} SELECT job, pointer, saved, current FROM diff"),
    "changed_fields": (lambda v: runs.changed_fields(runs.diff_settings(v.expected_v, v.actual_v)), f"WITH {SETTINGS} SELECT job, string_agg(pointer, ', ' ORDER BY pointer) AS fields FROM diff GROUP BY job"),
    "settings_delta": (
        lambda v: runs.settings_delta(v.expected_v, v.actual_v),
        f"WITH {SETTINGS} SELECT *, 'saved' AS side FROM (SELECT * FROM sa EXCEPT SELECT * FROM sb) UNION ALL SELECT *, 'current' FROM (SELECT * FROM sb EXCEPT SELECT * FROM sa)",
    ),
    "strip_execution_keys": (
        lambda v: run_settings(v).withColumn("run", F.to_json("run")),
        """SELECT job, '{"language":"' || language || '","model":"' || model || '"}' AS run FROM expected_v""",
    ),
    "freeze_metadata": (
        lambda v: runs.freeze_metadata(v.actual_v, v.expected_v.filter("job % 2 = 0")),
        "SELECT a.job, CASE WHEN e.job IS NULL THEN a.language ELSE e.language END AS language, CASE WHEN e.job IS NULL THEN a.model ELSE e.model END AS model, CASE WHEN e.job IS NULL THEN a.size ELSE e.size END AS size, CASE WHEN e.job IS NULL THEN a.beam ELSE e.beam END AS beam FROM actual_v a LEFT JOIN (SELECT * FROM expected_v WHERE job % 2 = 0) e USING (job)",
    ),
    "stale_sources": (
        lambda v: runs.stale_sources(v.actual_v, v.expected_v.filter("job % 29 <> 0"), fields=("size", "language")).select("job"),
        "SELECT a.job FROM actual_v a LEFT JOIN (SELECT * FROM expected_v WHERE job % 29 <> 0) e USING (job) WHERE e.job IS NULL OR a.size IS DISTINCT FROM e.size OR a.language IS DISTINCT FROM e.language",
    ),
    "audit_artifacts": (
        audit,
        f"""SELECT name, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'partial' WHEN doc_id % 11 = 0 THEN 'corrupt' ELSE 'cached' END AS status FROM {CATALOG}""",
    ),
    "resolve_alias": (
        aliases,
        "SELECT 'a' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'catalog/a' || doc_id WHEN doc_id % 2 = 0 THEN 'local/a' || doc_id END AS resolved FROM documents",
    ),
    "reconcile_outputs": (published, f"SELECT rec, seq AS format, CASE WHEN fh IS NULL THEN 'missing' WHEN fh = hash THEN 'verified' ELSE 'changed' END AS status FROM {EXPECTED_HASH}"),
    "batch_status": (
        lambda v: runs.batch_status(results(v), "rec"),
        f"""SELECT rec, count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'skipped') AS skipped, NOT bool_or(s = 'failed') AS ok
            FROM (SELECT rec, CASE WHEN {REASON} IS NOT NULL THEN 'failed' WHEN id % 3 = 0 THEN 'skipped' ELSE 'done' END AS s FROM candidates_v) GROUP BY rec""",
    ),
    "first_failure": (
        lambda v: runs.first_failure(results(v), "rec"),
        f"SELECT rec, min(id) AS seq, arg_min(r, id) AS reason FROM (SELECT rec, id, {REASON} AS r FROM candidates_v) WHERE r IS NOT NULL GROUP BY rec",
    ),
    "all_failures": (lambda v: runs.first_failure(results(v), "rec", keep_going=True), f"SELECT rec, id AS seq, {REASON} AS reason FROM candidates_v WHERE {REASON} IS NOT NULL"),
    "benchmark_summary": (
        lambda v: runs.benchmark_summary(v.measurements_v, 41.0),
        "SELECT device, median(seconds) AS median_s, median(seconds) / 41.0::DOUBLE AS rtf, max(rss_kib) AS max_rss_kib, max(vram_peak_mib - vram_baseline_mib) AS max_vram_rise_mib FROM measurements_v WHERE round > 0 GROUP BY device",
    ),
    "benchmark_ratio": (
        lambda v: runs.benchmark_ratio(v.measurements_v, "click", "view", key=["round"]),
        "SELECT round, median(seconds) FILTER (WHERE device = 'click') AS a_s, median(seconds) FILTER (WHERE device = 'view') AS b_s, median(seconds) FILTER (WHERE device = 'click') / median(seconds) FILTER (WHERE device = 'view') AS ratio FROM measurements_v WHERE round > 0 GROUP BY round",
    ),
    "flatten_json": (
        lambda v: runs.flatten_json(v.events, "props", "event_id"),
        "SELECT event_id, '/' || k AS pointer, props::JSON ->> k AS value FROM (SELECT event_id, props, unnest(json_keys(props::JSON)) AS k FROM events)",
    ),
    "diff_json": (
        # by the number of the event: a member more, a list shorter, another kind, a null gone, and nothing
        lambda v: runs.diff_json(_json_of(v, F.lit(',"l":[1,{"a/b":2.50}],"n":null')), _json_of(v, _changed_json()), "event_id"),
        """SELECT event_id, CASE k WHEN 0 THEN '/x' WHEN 1 THEN '/l/1' WHEN 2 THEN '/l/1/a~1b' ELSE '/n' END AS pointer,
             CASE k WHEN 0 THEN NULL WHEN 1 THEN '{"a/b":2.5}' WHEN 2 THEN '2.5' ELSE 'null' END AS saved, CASE k WHEN 0 THEN '{"y":[]}' WHEN 1 THEN NULL WHEN 2 THEN '"2.5"' ELSE NULL END AS current
           FROM (SELECT event_id, event_id % 5 AS k FROM events) WHERE k < 4""",
    ),
    "flatten_json_nested": (
        lambda v: runs.flatten_json(v.events.select("event_id", F.concat(F.lit('{"a/b":{"~":'), "props", F.lit('},"c":[1.50,null,"'), "event_type", F.lit('"],"d":{}}')).alias("doc")), "doc", "event_id"),
        """WITH x AS (SELECT event_id, event_type, props::JSON AS props FROM events)
           SELECT event_id, '/a~1b/~0/' || k AS pointer, props ->> k AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM x)
           UNION ALL SELECT event_id, '/c/0', '1.50' FROM x UNION ALL SELECT event_id, '/c/1', NULL FROM x UNION ALL SELECT event_id, '/c/2', event_type FROM x UNION ALL SELECT event_id, '/d', '{}' FROM x""",
    ),
    "effective_duration_after_vad": (
        lambda v: v.docseg_v.select("doc_id", runs.duration_after_vad(F.col("end_s") - F.col("start_s"), F.col("doc_id") % 3 == 0).alias("duration")),
        "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN end_s - start_s END AS duration FROM docseg_v",
    ),
    "recording_totals": (
        lambda v: journal.recording_totals(v.chunks_v),
        "SELECT rec, count(*) AS chunks, max(end_sample) AS samples, max(end_sample) / 16000.0::DOUBLE AS duration_s, arg_max(sha256(raw), idx) AS last_hash FROM chunks_v GROUP BY rec",
    ),
    "verify_chain": (lambda v: journal.verify_chain(v.chunks_v, LIMIT).select("rec", "idx", "reason"), f"WITH {CHAIN} SELECT * FROM v"),
    "valid_recordings": (
        lambda v: journal.valid_recordings(v.chunks_v, LIMIT, manifests(v)),
        f"WITH {CHAIN}, c AS (SELECT rec, max(idx) + 1 - 2 AS n FROM chunks_v GROUP BY rec) SELECT rec, bool_and(reason IS NULL) AS valid FROM v JOIN c USING (rec) WHERE idx < n GROUP BY rec",
    ),
    "link_chain": (
        linked,
        """WITH c AS MATERIALIZED (SELECT rec, seq AS idx, '{"index":' || seq || ',"previous_hash":"' AS head, '","text":' || sha256(text) || '}' AS tail FROM docseg_v),
             st AS (SELECT rec, idx, '' AS previous_hash, head || tail AS raw FROM c WHERE idx = 0
                    UNION ALL SELECT c.rec, c.idx, sha256(st.raw), c.head || sha256(st.raw) || c.tail FROM st JOIN c ON c.rec = st.rec AND c.idx = st.idx + 1)
           SELECT *, sha256(raw) AS hash FROM st""",
    ),
    "resume_pending": (
        lambda v: journal.resume_pending(v.chunks_v.select("rec", "idx", "start_sample"), manifests(v).filter("rec <> 'src1'")),
        f"WITH {MANIFESTS} SELECT rec, idx, start_sample FROM chunks_v LEFT JOIN (SELECT * FROM m WHERE rec <> 'src1') USING (rec) WHERE start_sample >= coalesce(samples, 0)",
    ),
    "orphan_chunks": (
        lambda v: journal.orphan_chunks(v.chunks_v.select("rec", "idx"), manifests(v)),
        f"WITH {MANIFESTS} SELECT rec, idx FROM chunks_v JOIN m USING (rec) WHERE idx >= chunks",
    ),
    "progress": (
        lambda v: journal.progress(v.chunks_v.withColumn("elapsed_s", (F.col("idx") + 1) * 1.5).withColumn("total_s", F.when(F.col("rec") != "src2", F.lit(900.0))), "total_s", "elapsed_s").select("rec", "idx", "position_s", "percent", F.round("eta_s", 6).alias("eta_s")),
        """SELECT rec, idx, p AS position_s, CASE WHEN k THEN least(99, CAST(floor(p / 900 * 100) AS INT)) END AS percent,
                  CASE WHEN k AND p > 30 THEN round((900 - p) * ((idx + 1) * 1.5::DOUBLE - 1.5::DOUBLE) / (p - 30), 6) END AS eta_s
           FROM (SELECT rec, idx, end_sample / 16000.0::DOUBLE AS p, rec <> 'src2' AND end_sample / 16000.0::DOUBLE <= 900 AS k FROM chunks_v)""",
    ),
}
