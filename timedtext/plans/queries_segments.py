"""Queries on text, segments, paragraphs, captions and sinks. Q: name to (query on the views, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from timedtext.functions import text as t
from timedtext.functions.scratch import fresh_path, written
from timedtext.operators import journal
from timedtext.operators import paragraphs as p
from timedtext.operators import segments as s
from timedtext.sources import packed, sinks, tables

PAUSE_MS = 2000
_WS = r"[ \n\r\t]+"
NORMAL = rf"trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ')"
END = r"""regexp_matches({0}, '[.!?…。]["'')\]}}»”’]*\z')"""
MS = "CAST(round({0} * 1000) AS BIGINT)"


def clock(ms: str, point: str) -> str:
    return f"printf('%02d:%02d:%02d{point}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


ESCAPED = f"replace(replace(replace(replace({NORMAL}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(0), '')"
W = "PARTITION BY rec ORDER BY seq"
VTT = f"""SELECT rec, CAST(row_number() OVER ({W}) AS BIGINT) AS cue, start_ms, greatest(end_0, start_ms + 1) AS end_ms, x AS text
  FROM (SELECT *, max({MS.format('start_s')}) OVER ({W} ROWS UNBOUNDED PRECEDING) AS start_ms, {MS.format('end_s')} AS end_0, {ESCAPED} AS x FROM docseg_v)"""
#: Paragraph breaks of a view by sequence, as a recursion.
BREAKS = """
  t AS MATERIALIZED (SELECT rec, seq, start_s, end_s, language, {normal} AS x FROM {view}),
  f AS MATERIALIZED (
    SELECT *, row_number() OVER w AS k, length(x) AS n, {end} AS se,
           coalesce((start_s - lag(end_s) OVER w) * 1000 >= 2000 OR language <> lag(language) OVER w, false) AS hard
    FROM t WHERE x <> '' WINDOW w AS (PARTITION BY rec ORDER BY seq)),
  st AS (
    SELECT rec, seq, k, x, false AS b, least(600, n)::BIGINT AS ch, se FROM f WHERE k = 1
    UNION ALL
    SELECT f.rec, f.seq, f.k, f.x, f.hard OR (st.ch >= 600 AND st.se),
           least(600, CASE WHEN f.hard OR (st.ch >= 600 AND st.se) THEN f.n ELSE st.ch + f.n END)::BIGINT, f.se
    FROM st JOIN f ON f.rec = st.rec AND f.k = st.k + 1)"""
_breaks = lambda view: BREAKS.format(normal=NORMAL, end=END.format("x"), view=view)
_numbered = "(SELECT *, CAST(sum(b::INT) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM st)"

#: Recordings whose texts are blank, and what the others are written as: a row for each paragraph, cue or segment.
BLANKED = "('src3', 'src7')"
PUBLISHED = f"""
  srt AS (SELECT rec, CAST(row_number() OVER ({W}) AS BIGINT) AS cue, {clock(MS.format('start_s'), ',')} AS a, {clock(MS.format('end_s'), ',')} AS b, {NORMAL} AS x FROM docseg_v),
  rows AS (
    SELECT rec, 'text' AS format, CASE WHEN paragraph > 0 THEN 2 ELSE 1 END AS lines, string_agg(x, ' ' ORDER BY k) AS x FROM {_numbered} GROUP BY rec, paragraph
    UNION ALL SELECT rec, 'srt', 4, cue || a || ' --> ' || b || x FROM srt
    UNION ALL SELECT rec, 'vtt', 4, cue || {clock('start_ms', '.')} || ' --> ' || {clock('end_ms', '.')} || text FROM ({VTT})
    UNION ALL SELECT DISTINCT rec, 'vtt', 2, 'WEBVTT' FROM docseg_v
    UNION ALL SELECT rec, 'json', 1, text FROM docseg_v)"""

Q = {
    "vtt_cues": (
        lambda v: s.vtt_cues(v.docseg_v),
        f"SELECT rec, cue, start_ms, end_ms, {clock('start_ms', '.')} AS start, {clock('end_ms', '.')} AS \"end\", text FROM ({VTT})",
    ),
    "srt_cues": (
        lambda v: s.srt_cues(v.seg_v),
        f"SELECT rec, CAST(row_number() OVER ({W}) AS BIGINT) AS cue, {clock(MS.format('start_s'), ',')} AS start, {clock(MS.format('end_s'), ',')} AS \"end\", {NORMAL} AS text FROM seg_v",
    ),
    "normalize_text": (lambda v: v.docseg_v.select("doc_id", t.normalize_text("text").alias("line")), f"SELECT doc_id, {NORMAL} AS line FROM docseg_v"),
    "trim_text": (
        lambda v: v.docseg_v.select("doc_id", t.trim_text(F.concat(F.lit(" \n\t"), "text", F.lit("\r\n "))).alias("line")),
        "SELECT doc_id, trim(text, concat(' ', chr(10), chr(13), chr(9))) AS line FROM docseg_v",
    ),
    "sentence_end": (lambda v: v.docseg_v.select("doc_id", t.sentence_end(t.normalize_text("text")).alias("ends")), f"SELECT doc_id, {END.format(NORMAL)} AS ends FROM docseg_v"),
    "code_points": (lambda v: v.docseg_v.select("doc_id", t.code_points("text").alias("n")), "SELECT doc_id, length(text) AS n FROM docseg_v"),
    "srt_time": (lambda v: v.seg_v.select("rec", "seq", t.srt_time("start_s").alias("time")), f"SELECT rec, seq, {clock(MS.format('start_s'), ',')} AS time FROM seg_v"),
    "vtt_time": (lambda v: v.seg_v.select("rec", "seq", t.vtt_time("end_ms").alias("time")), f"SELECT rec, seq, {clock('end_ms', '.')} AS time FROM seg_v"),
    "cue_escape": (lambda v: v.docseg_v.select("doc_id", t.cue_escape("text").alias("line")), f"SELECT doc_id, {ESCAPED} AS line FROM docseg_v"),
    "format_seconds": (lambda v: v.seg_v.select("rec", "seq", t.format_seconds(F.col("end_ms") / 1000.0 + 0.01).alias("time")), "SELECT rec, seq, printf('%.1f', end_ms / 1000.0::DOUBLE + 0.01::DOUBLE) AS time FROM seg_v"),
    "samples_to_seconds": (
        lambda v: v.seg_v.select("rec", "seq", t.samples_to_seconds(F.col("end_ms") * 16).alias("seconds"), t.seconds_to_samples("end_s").alias("samples")),
        "SELECT rec, seq, (end_ms * 16) / 16000.0::DOUBLE AS seconds, CAST(ceil(end_s * 16000) AS BIGINT) AS samples FROM seg_v",
    ),
    "content_hash": (lambda v: v.docseg_v.select("doc_id", t.content_hash("text").alias("hash")), "SELECT doc_id, sha256(text) AS hash FROM docseg_v"),
    "valid_language": (
        lambda v: v.candidates_v.select("id", t.valid_language("language").alias("valid"), t.normalize_language(F.concat(F.lit(" "), "language")).alias("language")),
        "SELECT id, regexp_full_match(language, '[a-z-]{0,16}') AS valid, lower(language) AS language FROM candidates_v",
    ),
    "normalize_language": (
        lambda v: v.candidates_v.select("id", t.normalize_language(F.concat(F.lit("\t"), "language", F.lit(" "))).alias("language")),
        "SELECT id, lower(language) AS language FROM candidates_v",
    ),
    "clamp_segment": (
        lambda v: s.clamp_segment(v.candidates_v.select("id", "window_s", F.round("start_s").cast("long").alias("start_cs"), F.round(F.col("end_s") * 100).cast("long").alias("end_cs")), "window_s").select("id", "start_s", "end_s"),
        """SELECT id, a AS start_s, least(greatest(e, a), window_s) AS end_s FROM (
             SELECT id, window_s, least(greatest(CAST(round(start_s) AS BIGINT) / 100.0::DOUBLE, 0.0::DOUBLE), window_s) AS a, CAST(round(end_s * 100) AS BIGINT) / 100.0::DOUBLE AS e FROM candidates_v)""",
    ),
    "rebase_segments": (
        lambda v: s.rebase_segments(v.windows_v.select("rec", "win", "seq", t.samples_to_seconds("start_sample").alias("start_s"), t.samples_to_seconds("end_sample").alias("end_s"), (F.col("win") * 480000).alias("offset_samples"), F.col("n_samples").alias("count_samples"))).select("rec", "seq", "start_s", "end_s"),
        """SELECT rec, seq, start_sample / 16000.0::DOUBLE + (win * 480000) / 16000.0::DOUBLE AS start_s,
                  least(end_sample / 16000.0::DOUBLE + (win * 480000) / 16000.0::DOUBLE, (win * 480000 + n_samples) / 16000.0::DOUBLE) AS end_s FROM windows_v""",
    ),
    "drop_blank": (
        lambda v: s.drop_blank(v.docseg_v.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "text"),
        """SELECT doc_id, pos, text FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docseg_v))
           WHERE trim(text, concat(' ', chr(10), chr(13), chr(9))) <> ''""",
    ),
    "validate_segments": (
        lambda v: s.validate_segments(v.candidates_v, low=10.0, high=F.col("window_s"), probability="no_speech_prob").select("id", "reason"),
        """SELECT id, CASE WHEN NOT (isfinite(start_s) AND isfinite(end_s) AND isfinite(no_speech_prob)) THEN 'not finite' WHEN start_s < 10 THEN 'starts too early'
             WHEN end_s < start_s THEN 'ends before its start' WHEN end_s > window_s THEN 'ends too late' END AS reason FROM candidates_v""",
    ),
    "languages": (
        lambda v: s.languages(v.docseg_v, "rec"),
        "SELECT rec, list(language ORDER BY f, language) AS languages FROM (SELECT rec, language, min(seq) AS f FROM docseg_v WHERE language <> '' GROUP BY ALL) GROUP BY rec",
    ),
    "language_summary": (
        lambda v: s.language_summary(v.docseg_v.withColumn("part", F.floor(F.col("seq") / 3)), "rec", "part"),
        "SELECT rec, seq // 3 AS part, CASE WHEN count(DISTINCT nullif(language, '')) = 1 THEN max(nullif(language, '')) END AS language FROM docseg_v GROUP BY ALL",
    ),
    "order_segments": (lambda v: s.order_segments(v.seg_v.select("rec", "seq", "start_ms", "end_ms")), "SELECT rec, seq, start_ms, end_ms FROM seg_v ORDER BY rec, seq"),
    "cue_index": (
        lambda v: s.cue_index(v.seg_v.select("rec", "seq")).withColumn("id", F.col("cue") - 1),
        f"SELECT rec, seq, CAST(row_number() OVER ({W}) AS BIGINT) AS cue, CAST(row_number() OVER ({W}) - 1 AS BIGINT) AS id FROM seg_v",
    ),
    "paragraph_breaks": (
        lambda v: p.paragraph_breaks(v.seg_v, PAUSE_MS).select("rec", "seq", "hard", "section"),
        f"""SELECT rec, seq, hard, CAST(sum(hard::INT) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM (
              SELECT rec, seq, coalesce((start_s - lag(end_s) OVER w) * 1000 >= {PAUSE_MS} OR language <> lag(language) OVER w, false) AS hard
              FROM (SELECT *, {NORMAL} AS x FROM seg_v) WHERE x <> '' WINDOW w AS ({W}))""",
    ),
    "paragraphs": (lambda v: p.paragraphs(v.docseg_v, PAUSE_MS).select("rec", "seq", "breaks", "paragraph"), f"WITH {_breaks('docseg_v')} SELECT rec, seq, b AS breaks, paragraph FROM {_numbered}"),
    "paragraphs_in_blocks": (lambda v: p.paragraphs(v.docseg_v, PAUSE_MS, bits=4).select("rec", "seq", "breaks", "paragraph"), f"WITH {_breaks('docseg_v')} SELECT rec, seq, b AS breaks, paragraph FROM {_numbered}"),
    "paragraphs_by_pause": (lambda v: p.paragraphs(v.seg_v, PAUSE_MS).select("rec", "seq", "breaks", "paragraph"), f"WITH {_breaks('seg_v')} SELECT rec, seq, b AS breaks, paragraph FROM {_numbered}"),
    "transcript_text": (
        lambda v: p.transcript_text(v.seg_v, PAUSE_MS),
        f"WITH {_breaks('seg_v')} SELECT rec, string_agg(CASE WHEN k = 1 THEN x WHEN b THEN chr(10) || chr(10) || x ELSE ' ' || x END, '' ORDER BY k) AS text FROM st GROUP BY rec",
    ),
    "nest_segments": (
        lambda v: s.nest_segments(v.seg_v.select("rec", "seq", "start_ms", "end_ms", "language")).withColumn("segments", F.to_json("segments")),
        "SELECT rec, CAST(to_json(list(struct_pack(seq := seq, start_ms := start_ms, end_ms := end_ms, language := language) ORDER BY seq)) AS VARCHAR) AS segments FROM seg_v GROUP BY rec",
    ),
    "explode_chunks": (
        lambda v: s.explode_chunks(v.docseg_v.groupBy("rec", F.floor(F.col("seq") / 5).alias("idx")).agg(F.max("language").alias("language"), F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("segments"))),
        """SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY seq) - 1 AS BIGINT) AS seq, seq // 5 AS idx, max(language) OVER (PARTITION BY rec, seq // 5) AS language, start_ms, end_ms FROM docseg_v""",
    ),
    "last_qualifying": (
        lambda v: s.last_qualifying(v.windows_v, ["rec", "win"], F.col("end_sample"), F.col("end_sample") < F.col("preferred") - F.col("guard"), F.col("seq"), "last_end"),
        "SELECT rec, win, arg_max(end_sample, seq) FILTER (WHERE end_sample < preferred - guard) AS last_end FROM windows_v GROUP BY ALL",
    ),
    "write_text": (
        lambda v: sinks.text_rows(v.seg_v).select("rec", "paragraph", "value"),
        f"""WITH {_breaks('seg_v')} SELECT rec, paragraph, CASE WHEN paragraph > 0 THEN chr(10) ELSE '' END || string_agg(x, ' ' ORDER BY k) AS value FROM {_numbered} GROUP BY rec, paragraph""",
    ),
    "write_srt": (
        lambda v: sinks.srt_rows(v.seg_v),
        f"""SELECT rec, cue, cue || chr(10) || a || ' --> ' || b || chr(10) || x || chr(10) AS value FROM (
              SELECT rec, CAST(row_number() OVER ({W}) AS BIGINT) AS cue, {clock(MS.format('start_s'), ',')} AS a, {clock(MS.format('end_s'), ',')} AS b, {NORMAL} AS x FROM seg_v)""",
    ),
    "write_vtt": (
        lambda v: sinks.vtt_rows(v.docseg_v),
        f"""SELECT rec, cue, cue || chr(10) || {clock('start_ms', '.')} || ' --> ' || {clock('end_ms', '.')} || chr(10) || text || chr(10) AS value FROM ({VTT})
            UNION ALL SELECT DISTINCT rec, CAST(-1 AS BIGINT), 'WEBVTT' || chr(10) FROM docseg_v""",
    ),
    "write_json": (
        lambda v: _json(v),
        f"""WITH {_breaks('seg_v')},
            body AS (SELECT rec, string_agg(CASE WHEN k = 1 THEN x WHEN b THEN chr(10) || chr(10) || x ELSE ' ' || x END, '' ORDER BY k) AS text FROM st GROUP BY rec)
            SELECT rec, count(*) AS n, CASE WHEN count(DISTINCT language) = 1 THEN max(language) END AS language, CAST(max(end_ms) AS DOUBLE) / 1000 AS duration,
                   CASE WHEN rec % 2 = 0 THEN NULL ELSE CAST(max(end_ms) AS DOUBLE) / 1000 END AS duration_after_vad, coalesce(any_value(body.text), '') AS text,
                   sum(end_ms) AS ends FROM seg_v LEFT JOIN body USING (rec) GROUP BY rec""".replace("sum(end_ms)", "CAST(sum(end_ms) AS BIGINT)"),
    ),
    "publish_all": (
        lambda v: _published(v),
        f"""WITH {_breaks('docseg_v')}, {PUBLISHED} SELECT rec, format, count(*) AS parts, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(length(x)) AS BIGINT) AS chars
            FROM rows WHERE rec NOT IN {BLANKED} GROUP BY rec, format
            UNION ALL SELECT DISTINCT rec, 'failed', 0, 0, 0 FROM docseg_v WHERE rec IN {BLANKED}""",
    ),
    "publish_packed": (
        lambda v: _packed(v),
        f"""SELECT rec::VARCHAR AS rec, 'srt' AS format, string_agg(cue || chr(10) || a || ' --> ' || b || chr(10) || x || chr(10) || chr(10), '' ORDER BY cue) AS content FROM (
              SELECT rec, CAST(row_number() OVER ({W}) AS BIGINT) AS cue, {clock(MS.format('start_s'), ',')} AS a, {clock(MS.format('end_s'), ',')} AS b, {NORMAL} AS x FROM seg_v)
            GROUP BY rec HAVING rec % 4 <> 3 AND bool_or(x <> '')""",
    ),
    "render_counts": (
        lambda v: sinks.render_counts(v.seg_v)[0],
        f"WITH {_breaks('seg_v')} SELECT rec, CAST(sum(b::INT) + 1 AS BIGINT) AS paragraphs, any_value(c) AS cues FROM st JOIN (SELECT rec, count(*) AS c FROM seg_v GROUP BY rec) USING (rec) GROUP BY rec",
    ),
    "read_transcripts": (
        lambda v: _transcripts(v),
        f"SELECT rec::VARCHAR AS source, CAST(row_number() OVER ({W}) - 1 AS BIGINT) AS seq, start_s, end_s, text, no_speech_prob, language FROM seg_v",
    ),
    "read_journal": (
        lambda v: _journal(v),
        """SELECT rec, idx, start_sample, end_sample, count(*) FILTER (WHERE x <> '') AS n, true AS linked
           FROM (SELECT rec, seq AS idx, seq * 480000 AS start_sample, (seq + 1) * 480000 AS end_sample, trim(unnest(string_split(text, chr(10))), concat(' ', chr(10), chr(13), chr(9))) AS x FROM docseg_v)
           GROUP BY rec, idx, start_sample, end_sample""",
    ),
    "restore": (
        lambda v: _restored(v),
        """SELECT rec, CASE WHEN k = 0 THEN 'resume' WHEN k = 1 THEN 'publish' WHEN k = 7 THEN 'start' ELSE 'refuse' END AS action,
             CASE k WHEN 2 THEN 'changed: /outputs/srt, /run/parts/1' WHEN 3 THEN 'schema' WHEN 4 THEN 'corrupt' WHEN 5 THEN 'manifest missing' WHEN 6 THEN CASE WHEN n > 1 THEN 'unknown contents' END END AS reason
           FROM (SELECT rec, count(*) AS n, CAST(regexp_extract(rec, '[0-9]+') AS INT) % 8 AS k FROM docseg_v GROUP BY rec)""",
    ),
    "refused_cues": (
        lambda v: _refused(v),
        """SELECT rec, seq, caption, CASE WHEN k < 2 THEN 'not finite' ELSE 'negative' END AS reason
           FROM (SELECT rec, seq, (rec * 5 + seq) % 9 AS k, unnest(['srt', 'vtt']) AS caption FROM seg_v) WHERE k < 2 OR (k = 2 AND caption = 'srt')""",
    ),
    "read_catalog": (
        lambda v: _catalog(v),
        "SELECT 'm' || doc_id AS name, doc_id || '.bin' AS file, 'https://example.org/' || doc_id AS url, sha256(text) AS sha256, n_chars AS bytes FROM documents",
    ),
    "seconds_to_samples": (lambda v: v.seg_v.select("rec", "seq", t.seconds_to_samples("start_s").alias("samples")), "SELECT rec, seq, CAST(ceil(start_s * 16000) AS BIGINT) AS samples FROM seg_v"),
    "append_journal": (
        lambda v: _appended(v),
        """SELECT rec, idx, start_sample, end_sample, count(*) FILTER (WHERE x <> '') AS n, any_value(language) AS language
           FROM (SELECT rec, seq AS idx, seq * 480000 AS start_sample, (seq + 1) * 480000 AS end_sample, language, trim(unnest(string_split(text, chr(10))), concat(' ', chr(10), chr(13), chr(9))) AS x FROM docseg_v)
           GROUP BY rec, idx, start_sample, end_sample HAVING count(*) FILTER (WHERE x <> '') > 0
           UNION ALL SELECT rec, seq, seq * 480000, (seq + 1) * 480000, 0, '' FROM docseg_v WHERE trim(text, concat(' ', chr(10), chr(13), chr(9))) = ''""",
    ),
}


def _packed(v):
    """Captions of all recordings published in two runs, the second with some that differ from the first and so refused; then what can be read."""
    path = fresh_path(v.spark, "packed")
    packed.publish_packed(v.seg_v.filter("rec % 4 < 2"), path, ("srt",), version="a")
    packed.publish_packed(v.seg_v.withColumn("text", F.when(F.expr("rec % 4 = 1"), F.lit("other")).otherwise(F.col("text"))), path, ("srt",), version="b")
    packed.publish_packed(v.seg_v.filter("rec % 4 = 2"), path, ("srt",), version="c")
    return packed.read_published(v.spark, path)


def _json(v):
    """Documents as JSON, parsed again."""
    from timedtext.sources.tables import TRANSCRIPT

    segs = v.seg_v
    headers = segs.groupBy("rec").agg((F.max("end_ms").cast("double") / 1000).alias("duration")).select("rec", F.lit("conversation").alias("source"), F.lit("none").alias("model"), "duration", (F.col("rec") % 2 == 0).alias("vad"), F.create_map(F.lit("vad"), (F.col("rec") % 2 == 0).cast("string")).alias("run"))
    docs = sinks.json_documents(segs, headers, PAUSE_MS).withColumn("d", F.from_json("value", TRANSCRIPT))
    ends = F.aggregate(F.col("d.segments"), F.lit(0).cast("long"), lambda a, x: a + t.milliseconds(x["end"]))
    return docs.select("rec", F.size("d.segments").cast("long").alias("n"), "d.language", "d.duration", "d.duration_after_vad", "d.text", ends.alias("ends"))


def _published(v):
    """Every format of all recordings, published and read again; a time line tells a cue, and a line that is not empty a paragraph."""
    segs = v.docseg_v.withColumn("text", F.when(F.expr(f"rec in {BLANKED}"), F.lit(" ")).otherwise(F.col("text")))
    headers = segs.groupBy("rec").agg((F.max("end_ms").cast("double") / 1000).alias("duration")).select("rec", F.col("rec").alias("source"), F.lit("none").alias("model"), "duration", F.lit(False).alias("vad"), F.create_map(F.lit("vad"), F.lit("false")).alias("run"))
    path = fresh_path(v.spark, "published")
    failed = sinks.publish_all(segs, path, headers=headers, pause_ms=PAUSE_MS)
    out = failed.select("rec", F.lit("failed").alias("format"), *(F.lit(0).cast("long").alias(c) for c in ("parts", "lines", "chars")))
    for name, part in (("text", F.col("value") != ""), ("srt", F.col("value").contains(" --> ")), ("vtt", F.col("value").rlike("^(WEBVTT|[0-9:.]+ --> .*)$"))):
        lines = v.spark.read.text(f"{path}/{name}")
        counts = lines.groupBy("rec").agg(F.count_if(part).alias("parts"), F.count("*").alias("lines"), F.sum(F.char_length("value")).alias("chars"))
        out = out.union(counts.select("rec", F.lit(name), "parts", "lines", "chars"))
    back = tables.read_transcripts(v.spark, f"{path}/json")
    return out.union(back.groupBy("source").agg(F.count("*").alias("parts"), F.sum(F.char_length("text")).alias("chars")).select("source", F.lit("json"), "parts", "parts", "chars"))


def _transcripts(v):
    """Documents as JSON, written and read again."""
    segs = v.seg_v
    headers = segs.groupBy("rec").agg((F.max("end_ms").cast("double") / 1000).alias("duration")).select("rec", F.col("rec").cast("string").alias("source"), F.lit("none").alias("model"), "duration", F.lit(False).alias("vad"), F.create_map(F.lit("vad"), F.lit("false")).alias("run"))
    path = fresh_path(v.spark, "transcripts")
    sinks.write_json(segs, headers, path, PAUSE_MS)
    return tables.read_transcripts(v.spark, path)


def _fingerprints(v):
    """A fingerprint for each recording, as JSON."""
    return v.docseg_v.select("rec").distinct().select("rec", F.concat(F.lit('{"source":"'), "rec", F.lit('","size":5,"outputs":{"srt":"a.srt"},"run":{"beam":"5","parts":[1,null]}}')).alias("fingerprint"))


def _metadata(v):
    return v.docseg_v.select("rec").distinct().select("rec", F.lit("m").alias("model"), F.create_map(F.lit("beam"), F.lit("5")).alias("run"))


def _number():
    return F.regexp_extract("rec", "[0-9]+", 0).cast("int") % 8


def _journal(v):
    """A journal written as files and read again, with its chain verified."""
    path = fresh_path(v.spark, "journal")
    records = written(sinks.append_rows(_results(v))[0], "records")
    sinks.write_journal(records, journal.manifest_records(records, _fingerprints(v), _metadata(v)), path)
    manifests, chunks = tables.read_journal(v.spark, path)
    rows = chunks.withColumnRenamed("index", "idx").withColumn("n_segments", F.size("segments"))
    checked = journal.verify_chain(rows, 480_000, manifests)
    return checked.select("rec", "idx", "start_sample", "end_sample", F.col("n_segments").cast("long").alias("n"), F.col("reason").isNull().alias("linked"))


def _restored(v):
    """Journals by the number of their recording: whole, finished, of other settings, of another schema, with a wrong hash, without a manifest, and with records that no manifest counts."""
    path = fresh_path(v.spark, "journal")
    k = _number()
    records = written(sinks.append_rows(_results(v))[0].filter((k != 7) | (F.col("idx") == 0)), "records")
    prints = _fingerprints(v).withColumn("fingerprint", F.when(k == 2, F.replace(F.replace("fingerprint", F.lit("a.srt"), F.lit("b.srt")), F.lit(",null"), F.lit(""))).otherwise(F.col("fingerprint")))
    manifests = journal.manifest_records(records.filter(k < 6), prints, _metadata(v), k == 1)
    raw = F.when(k == 3, F.replace("raw", F.lit('"schema_version":3'), F.lit('"schema_version":2'))).when(k == 4, F.regexp_replace("raw", '"last_hash":"[0-9a-f]{8}', '"last_hash":"00000000')).otherwise(F.col("raw"))
    sinks.write_journal(records, manifests.filter(k != 5).withColumn("raw", raw), path)
    manifests, chunks = tables.read_journal(v.spark, path)
    return journal.restore(manifests, chunks.withColumnRenamed("index", "idx"), _fingerprints(v), 480_000)


def _refused(v):
    """Segments some of whose times no caption can have."""
    k = (F.col("rec") * 5 + F.col("seq")) % 9
    segs = v.seg_v.withColumn("start_s", F.when(k == 0, float("nan")).when(k == 2, -1.0).otherwise(F.col("start_s"))).withColumn("end_s", F.when(k == 1, float("inf")).otherwise(F.col("end_s")))
    return sinks.refused_cues(segs, "srt").withColumn("caption", F.lit("srt")).unionByName(sinks.refused_cues(segs, "vtt").withColumn("caption", F.lit("vtt")))


def _catalog(v):
    """Catalogs of at most a thousand artifacts for each source, a JSON array each, written and read again."""
    name = F.col("doc_id").cast("string")
    entry = F.struct(F.concat(F.lit("m"), name).alias("name"), F.concat(name, F.lit(".bin")).alias("file"), F.concat(F.lit("https://example.org/"), name).alias("url"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    path = fresh_path(v.spark, "catalog")
    v.documents.groupBy("source", F.floor(F.col("doc_id") / 1000)).agg(F.to_json(F.collect_list(entry)).alias("value")).select("source", "value").write.partitionBy("source").text(path)
    return tables.read_catalog(v.spark, path).select("name", "file", "url", "sha256", "bytes")


def _appended(v):
    """Results as records, parsed again."""
    from timedtext.sources.tables import CHUNK

    records = sinks.append_rows(_results(v))[0].withColumn("c", F.from_json("raw", CHUNK))
    return records.select("rec", "idx", "c.start_sample", "c.end_sample", F.size("c.segments").cast("long").alias("n"), "c.language")


def _results(v):
    """Each document as the result of one window of 30 s, its lines as segments."""
    line = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i % 30).cast("double").alias("start_s"), (i % 30 + F.lit(0.5)).cast("double").alias("end_s"), x.alias("text"), F.lit(0.1).alias("no_speech_prob")))
    return v.docseg_v.select("rec", F.col("seq").alias("idx"), (F.col("seq") * 480000).alias("start_sample"), ((F.col("seq") + 1) * 480000).alias("end_sample"), "language", line.alias("segments"))
