"""The hash-chained journal of committed chunks, and resuming from it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from timedtext.functions.scratch import written
from timedtext.functions.text import RATE, valid_language
from timedtext.operators.fold import fold
from timedtext.operators.runs import differing_fields
from timedtext.operators.segments import MAX_LANGUAGES, invalid_reason


#: Fixed value: the version of the manifests that are read.
SCHEMA = 3


def _segment_reason(segments: str) -> Column:
    """Why the first bad segment of a record is one; null if all are right."""
    low, high = F.col("start_sample") / float(RATE), F.col("end_sample") / float(RATE)

    def wrong(x: Column) -> Column:
        times = invalid_reason(x["start"], x["end"], low, high, x["no_speech_prob"])
        return F.coalesce(times, F.when(F.coalesce(x["text"], F.lit("")) == "", "text"))

    return F.get(F.filter(F.transform(segments, wrong), lambda r: r.isNotNull()), F.lit(0))


def _hash(chunks: DataFrame) -> Column:
    return F.col("raw_hash") if "raw_hash" in chunks.columns else F.sha2("raw", 256)


def verify_chain(chunks: DataFrame, limit_samples: int, manifests: DataFrame | None = None, key="rec", order="idx") -> DataFrame:
    """`chunks` with `reason`: unreadable, index, start, length, hash, language, text or what is wrong with a segment's times; null where the record is right.

    chunks: idx, start_sample, end_sample, previous_hash, language, raw and, if there,
    segments (start, end, text, no_speech_prob in recording time) or n_segments, and a
    reason of their reader's, which stays. A record in which one of these is null is
    unreadable. With manifests (rec, chunks, samples, last_hash), only their committed
    chunks are looked at, and what is unreadable.
    """
    if manifests is not None:
        chunks = chunks.join(manifests.select(key, "chunks"), key).filter(F.col(order).isNull() | (F.col(order) < F.col("chunks"))).drop("chunks")
    # what a record's text is needed for comes before the window, so that it is not put in order where only the reason is asked for
    needed = [order, "start_sample", "end_sample", "previous_hash", "language", "raw_hash" if "raw_hash" in chunks.columns else "raw", *(c for c in ("segments", "n_segments") if c in chunks.columns)]
    nulls = [F.col(c).isNull() for c in needed] + ([F.col("no_segments")] if "no_segments" in chunks.columns else [])
    rows = chunks.withColumn("__own", _hash(chunks)).withColumn("__unreadable", F.exists(F.array(*nulls), lambda x: x))
    w = W.partitionBy(key).orderBy(F.col(order).asc_nulls_last())
    rows = rows.withColumn("__n", F.row_number().over(w) - 1).withColumn("__at", F.coalesce(F.lag("end_sample").over(w), F.lit(0)))
    rows = rows.withColumn("__hash", F.coalesce(F.lag("__own").over(w), F.lit("")))
    unreadable = F.col("__unreadable")
    length = F.col("end_sample") - F.col("start_sample")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(unreadable, "unreadable") if "reason" in chunks.columns else F.when(unreadable, "unreadable")
    reason = reason.when(F.col(order) != F.col("__n"), "index").when(F.col("start_sample") != F.col("__at"), "start").when((length <= 0) | (length > limit_samples), "length")
    reason = reason.when(F.col("previous_hash") != F.col("__hash"), "hash")
    count = F.size("segments") if "segments" in chunks.columns else F.col("n_segments") if "n_segments" in chunks.columns else None
    if count is not None:
        reason = reason.when((count > 0) != (F.col("language") != ""), "language")
    reason = reason.when(~valid_language("language"), "language")
    if "segments" in chunks.columns:
        reason = reason.otherwise(_segment_reason("segments"))
    elif "segment_reason" in chunks.columns:
        reason = reason.otherwise(F.col("segment_reason"))
    return rows.withColumn("reason", reason).drop("__n", "__at", "__hash", "__own", "__unreadable")


def _slim(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """`chunks` with the hash of each text instead of the text, and what is wrong with its segments instead of these, so that the records of a recording that are put in order are short."""
    kept = [c for c in (key, order, "start_sample", "end_sample", "previous_hash", "language", "reason", "n_segments") if c in chunks.columns]
    segments = [F.size("segments").alias("n_segments"), _segment_reason("segments").alias("segment_reason"), F.col("segments").isNull().alias("no_segments")] if "segments" in chunks.columns else []
    return chunks.select(*(c for c in kept if c != "n_segments" or not segments), F.sha2("raw", 256).alias("raw_hash"), *segments)


def recording_totals(chunks: DataFrame, manifests: DataFrame | None = None, key="rec", order="idx") -> DataFrame:
    """(rec, chunks, samples, duration_s, last_hash) of the stored records, and finished of manifests that have it."""
    totals = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.max("end_sample").alias("samples"), F.max_by(_hash(chunks), order).alias("last_hash"))
    totals = totals.select(key, "chunks", "samples", (F.col("samples") / float(RATE)).alias("duration_s"), "last_hash")
    return totals if manifests is None else totals.join(manifests.select(key, "finished"), key, "left")


def detected_languages(chunks: DataFrame, key="rec", order="idx") -> DataFrame:
    """(rec, languages): the languages of the records in the order in which they first come."""
    first = chunks.filter(F.col("language") != "").groupBy(key, "language").agg(F.min(order).alias("first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "language"))), lambda x: x["language"]).alias("languages"))


def valid_recordings(chunks: DataFrame, limit_samples: int, manifests: DataFrame, key="rec", order="idx") -> DataFrame:
    """(rec, valid): every committed record is right and their totals, and languages if the manifests have them, are those of the manifest."""
    checked = verify_chain(_slim(chunks, key, order), limit_samples, manifests, key, order)
    totals = recording_totals(checked, None, key, order).join(checked.groupBy(key).agg(F.bool_and(F.col("reason").isNull()).alias("records")), key)
    m = manifests.select(key, F.col("chunks").alias("m_chunks"), F.col("samples").alias("m_samples"), F.col("last_hash").alias("m_hash"), *([F.col("languages").alias("m_languages")] if "languages" in manifests.columns else []))
    same = F.col("records") & (F.col("chunks") == F.col("m_chunks")) & (F.col("samples") == F.col("m_samples")) & (F.col("last_hash") == F.col("m_hash"))
    empty = (F.col("m_chunks") == 0) & (F.col("m_samples") == 0) & (F.col("m_hash") == "")
    joined = m.join(totals, key, "left")
    if "languages" in manifests.columns:
        none = F.array().cast("array<string>")
        joined = joined.join(detected_languages(checked, key, order), key, "left")
        same = same & (F.coalesce("languages", none) == F.coalesce("m_languages", none)) & (F.size(F.coalesce("languages", none)) <= MAX_LANGUAGES)
        empty = empty & (F.size(F.coalesce("m_languages", none)) == 0)
    return joined.select(key, F.coalesce(same, empty, F.lit(False)).alias("valid"))


def manifest_reason(manifests: DataFrame) -> Column:
    """Why a manifest, as read_manifests has it, is none: the reader's reason, `schema` or `manifest`; null if it is right."""
    reader = F.col("reason") if "reason" in manifests.columns else F.lit(None).cast("string")
    needed = ("fingerprint", "chunks", "samples", "languages", "last_hash", "finished", "published_hashes", "output_metadata.model", "output_metadata.run")
    missing = F.exists(F.array(*(F.col(c).isNull() for c in needed)), lambda x: x)
    return F.coalesce(reader, F.when(F.coalesce("schema_version", F.lit(0)) != SCHEMA, "schema").when(missing | (F.col("chunks") < 0) | (F.col("samples") < 0), "manifest"))


def manifest_records(records: DataFrame, fingerprints: DataFrame, metadata: DataFrame, finished: Column | None = None, key="rec", order="idx") -> DataFrame:
    """(rec, raw): the manifest of the linked records (rec, idx, raw) of each recording. fingerprints: rec, fingerprint (a JSON text); metadata: rec, model, run (a map)."""
    own = records.withColumn("__r", F.from_json("raw", "end_sample long, language string"))
    totals = recording_totals(own.select(key, order, "raw", F.col("__r.end_sample").alias("end_sample")), None, key, order)
    named = detected_languages(own.select(key, order, F.col("__r.language").alias("language")), key, order)
    rows = fingerprints.join(totals, key, "left").join(named, key, "left").join(metadata, key, "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    fields = [
        F.lit(SCHEMA).alias("schema_version"), F.struct("model", "run").alias("output_metadata"), number("chunks"), number("samples"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages"),
        F.coalesce("last_hash", F.lit("")).alias("last_hash"), (F.lit(False) if finished is None else finished).alias("finished"), F.create_map().cast("map<string,string>").alias("published_hashes"),
    ]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.select(key, F.concat(F.lit('{"fingerprint":'), "fingerprint", F.lit(","), F.substring(body, 2, 2**31 - 1)).alias("raw"))


def restore(manifests: DataFrame, chunks: DataFrame, jobs: DataFrame, limit_samples: int, resume=True, overwrite=False, key="rec", order="idx") -> DataFrame:
    """(rec, action, reason): what becomes of the saved work of each recording.

    `start` anew, where there is none, or none but a first record that was not committed
    any more, or all is to be overwritten; `resume`; `publish` what is finished; or
    `refuse`, with the reason: what is wrong with the manifest, `corrupt` records,
    `unknown contents`, `manifest missing`, `saved progress` that may not be resumed, or
    the settings that changed. manifests and chunks: as read_journal has them, chunks
    with their index as idx; jobs: rec and its fingerprint, a JSON text, of now.
    """
    # each is needed several times, and files are read and parsed once
    manifests, chunks = written(manifests, "manifests"), written(chunks, "records")
    checked = manifests.withColumn("__reason", manifest_reason(manifests))
    right = checked.filter("__reason is null")
    # a record that cannot be read is not a committed one that is missing: the recording has unknown contents
    records = chunks.filter(F.col(order).isNotNull())
    valid = valid_recordings(records, limit_samples, right, key, order)
    first = records.filter(F.col(order) == 0)
    usable = verify_chain(first, limit_samples, None, key, order).select(key, F.col("reason").isNull().alias("usable"))
    stored = chunks.groupBy(key).agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.col(order) != 0, F.lit(True))).alias("others")).join(usable.groupBy(key).agg(F.bool_and("usable").alias("usable")), key, "left")
    saved = right.select(key, F.get_json_object("raw", "$.fingerprint").alias("json"))
    changed = differing_fields(saved, jobs.select(key, F.col("fingerprint").alias("json")), key)
    state = checked.select(key, F.lit(True).alias("there"), "__reason", "chunks", "finished", F.size("published_hashes").alias("hashes"))
    keys = jobs.select(key).union(manifests.select(key)).union(chunks.select(key)).distinct()
    rows = keys
    for part in (state, valid, stored, changed):
        rows = rows.join(part, key, "left")
    empty = (F.col("chunks") == 0) & ~F.col("finished") & (F.col("hashes") == 0)
    refusal = (
        F.when(F.col("there").isNull(), F.when(F.col("records") > 0, "manifest missing"))
        .when(F.col("__reason").isNotNull(), F.col("__reason"))
        .when(~F.col("valid"), "corrupt")
        .when(empty, F.when(F.col("others") > 0, "unknown contents").when(~F.coalesce("usable", F.lit(True)), "corrupt"))
        .when(F.lit(not resume), "saved progress")
        .when(F.col("fields").isNotNull(), F.concat(F.lit("changed: "), "fields"))
    )
    begins = F.lit(overwrite and not resume) | F.col("there").isNull() | F.coalesce(empty, F.lit(False))
    refusal = F.when(F.lit(not (overwrite and not resume)), refusal)
    rows = rows.withColumn("reason", refusal)
    return rows.select(key, F.when(F.col("reason").isNotNull(), "refuse").when(begins, "start").when(F.col("finished"), "publish").otherwise("resume").alias("action"), "reason")


def link_chain(chunks: DataFrame, key="rec", order="idx") -> DataFrame:
    """(rec, idx, previous_hash, raw, hash): records whose hash covers the one before.

    chunks: head and tail, the text of the record before and after its previous hash.
    """

    def step(previous: str, row: tuple) -> tuple[str, list[tuple]]:
        rec, idx, head, tail = row
        raw = f"{head}{previous}{tail}"
        digest = hashlib.sha256(raw.encode()).hexdigest()
        return digest, [(rec, idx, previous, raw, digest)]

    schema = T.StructType([chunks.schema[key], chunks.schema[order], *(T.StructField(n, T.StringType()) for n in ("previous_hash", "raw", "hash"))])
    return fold(chunks.select(key, order, "head", "tail"), key, [order], lambda: "", step, schema)


def chunk_records(chunks: DataFrame, key="rec", order="idx") -> DataFrame:
    """Chunks (idx, start_sample, end_sample, language, segments) as linked JSON records."""
    body = F.to_json(F.struct("language", "segments"), {"ignoreNullFields": "false"})
    head = F.format_string('{"index":%d,"start_sample":%d,"end_sample":%d,"previous_hash":"', order, "start_sample", "end_sample")
    return link_chain(chunks.select(key, order, head.alias("head"), F.concat(F.lit('",'), F.substring(body, 2, 2**31 - 1)).alias("tail")), key, order)


def resume_pending(windows: DataFrame, manifests: DataFrame, key="rec") -> DataFrame:
    """The windows that start at or after what is committed; all of a recording without a manifest."""
    m = manifests.select(key, "samples")
    return windows.join(m, key, "left").filter(F.col("start_sample") >= F.coalesce("samples", F.lit(0))).drop("samples")


def orphan_chunks(chunks: DataFrame, manifests: DataFrame, key="rec", order="idx") -> DataFrame:
    """Stored chunks beyond the committed count."""
    m = manifests.select(F.col(key).alias("__key"), F.col("chunks").alias("__chunks"))
    return chunks.join(m, (chunks[key] == m["__key"]) & (chunks[order] < m["__chunks"]), "left_anti")


def progress(commits: DataFrame, total_s: str, elapsed_s: str, key="rec", order="idx") -> DataFrame:
    """`commits` with position_s, percent (at most 99) and eta_s; the last two are null where the total is unknown or passed.

    commits: end_sample and columns of the total and of the seconds since the start.
    The rate is that of what was committed after the first commit.
    """
    w = W.partitionBy(key).orderBy(order)
    position = F.col("end_sample") / float(RATE)
    rows = commits.withColumn("position_s", position).withColumn("__first", F.first("position_s").over(w)).withColumn("__began", F.first(elapsed_s).over(w))
    known = F.coalesce((F.col(total_s) > 0) & (F.col("position_s") <= F.col(total_s)), F.lit(False))
    spent = F.col(elapsed_s) - F.col("__began")
    moved = F.col("position_s") - F.col("__first")
    percent = F.when(known, F.least(F.lit(99), F.floor(F.col("position_s") / F.col(total_s) * 100)).cast("int"))
    eta = F.when(known & (moved > 0) & (spent > 0), (F.col(total_s) - F.col("position_s")) * spent / moved)
    return rows.withColumn("percent", percent).withColumn("eta_s", eta).drop("__first", "__began")


def observed(commits: DataFrame, name: str = "commits") -> tuple[DataFrame, Observation | None]:
    """`commits` with metrics that Spark reports while they go through: chunks, samples and segments. On a stream, listeners get them by name, batch by batch, and there is no observation."""
    seen = None if commits.isStreaming else Observation(name)
    segments = F.sum(F.size("segments")) if "segments" in commits.columns else F.lit(None).cast("long")
    return commits.observe(seen or name, F.count("*").alias("chunks"), F.sum(F.col("end_sample") - F.col("start_sample")).alias("samples"), segments.alias("segments")), seen
