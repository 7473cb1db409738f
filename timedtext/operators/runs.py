"""Comparing runs: settings, artifacts, published outputs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.functions.scratch import written
from timedtext.functions.text import RATE

#: Settings that do not change a result.
EXECUTION_KEYS = ("threads", "version", "revision", "dirty")


def settings(df: DataFrame, key="job") -> DataFrame:
    """(job, pointer, value): each setting as a row with its JSON pointer; null settings are missing ones."""
    names = [c for c in df.columns if c != key]
    rows = F.explode(F.array(*(F.struct(F.lit(f"/{c}").alias("pointer"), F.col(c).cast("string").alias("value")) for c in names)))
    return df.select(key, rows.alias("s")).select(key, "s.pointer", "s.value").filter("value is not null")


def diff_settings(saved: DataFrame, current: DataFrame, key="job") -> DataFrame:
    """(job, pointer, saved, current) of each setting that differs or is missing on one side."""
    a = settings(saved, key).withColumnRenamed("value", "saved")
    b = settings(current, key).withColumnRenamed("value", "current")
    return a.join(b, [key, "pointer"], "full_outer").filter(~F.col("saved").eqNullSafe(F.col("current")))


def changed_fields(diff: DataFrame, key="job") -> DataFrame:
    """(job, fields): the pointers that differ, joined with a comma."""
    return diff.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("pointer")), ", ").alias("fields"))


def settings_delta(saved: DataFrame, current: DataFrame, key="job") -> DataFrame:
    """(job, pointer, value, side): entries of one set that the other does not have."""
    a, b = settings(saved, key), settings(current, key)
    return a.subtract(b).withColumn("side", F.lit("saved")).unionByName(b.subtract(a).withColumn("side", F.lit("current")))


def strip_execution_keys(run: Column | str, keys=EXECUTION_KEYS) -> Column:
    """A map of settings without those that do not change a result."""
    return F.map_filter(F.col(run) if isinstance(run, str) else run, lambda k, _: ~k.isin(*keys))


def freeze_metadata(current: DataFrame, saved: DataFrame, key="job") -> DataFrame:
    """`current` with the values of the first run where it left some."""
    there = saved.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in saved.columns if c != key), F.lit(True).alias("__saved"))
    joined = current.join(there, key, "left")
    return joined.select(*(F.when(F.col("__saved"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if f"__{c}" in there.columns else F.col(c) for c in current.columns))


def stale_sources(media: DataFrame, fingerprints: DataFrame, key="job", fields=("size", "sha256")) -> DataFrame:
    """The rows of `media` whose source is not as it was when its result was made; without a fingerprint too."""
    was = fingerprints.select(key, *(F.col(c).alias(f"__{c}") for c in fields), F.lit(True).alias("__there"))
    same = F.coalesce(F.col("__there"), F.lit(False))
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return media.join(was, key, "left").filter(~same).select(media.columns)


def audit_artifacts(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status): missing, partial, cached or corrupt, by size and hash. catalog: name, file, bytes, sha256; files: file, size, hash."""
    rows = catalog.join(files.select("file", "size", "hash"), "file", "left")
    status = F.when(F.col("size").isNull(), "missing").when(F.col("size") < F.col("bytes"), "partial").when((F.col("size") == F.col("bytes")) & (F.col("hash") == F.col("sha256")), "cached").otherwise("corrupt")
    return rows.select("name", status.alias("status"))


def resolve_alias(names: DataFrame, catalog: DataFrame, local: DataFrame, name="name") -> DataFrame:
    """`names` with `resolved`: what the catalog has for it, else a local artifact, else null. catalog, local: alias, target."""
    a, b = catalog.select(F.col("alias").alias("__a"), F.col("target").alias("__ta")), local.select(F.col("alias").alias("__b"), F.col("target").alias("__tb"))
    joined = names.join(a, names[name] == a["__a"], "left").join(b, names[name] == b["__b"], "left")
    return joined.withColumn("resolved", F.coalesce("__ta", "__tb")).drop("__a", "__b", "__ta", "__tb")


def reconcile_outputs(expected: DataFrame, files: DataFrame, key=("rec", "format")) -> DataFrame:
    """(key, status): missing, verified or changed. expected: hash by key; files: file_hash by key."""
    rows = expected.join(files.select(*key, "file_hash"), list(key), "left")
    return rows.select(*key, F.when(F.col("file_hash").isNull(), "missing").when(F.col("file_hash") == F.col("hash"), "verified").otherwise("changed").alias("status"))


def batch_status(results: DataFrame, *key: str) -> DataFrame:
    """(key, done, failed, skipped, ok) of results with a status."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = results.groupBy(*key).agg(count("done"), count("failed"), count("skipped"))
    return out.withColumn("ok", F.col("failed") == 0)


def first_failure(results: DataFrame, *key: str, order="seq", keep_going=False) -> DataFrame:
    """The first failing row of each group as (key, order, reason), or all of them with keep_going."""
    failing = results.filter("reason is not null")
    if keep_going:
        return failing.select(*key, order, "reason")
    return failing.groupBy(*key).agg(F.min(order).alias(order), F.min_by("reason", order).alias("reason"))


def benchmark_summary(measurements: DataFrame, audio_s: float, by="device") -> DataFrame:
    """(device, median_s, rtf, max_rss_kib, max_vram_rise_mib) without round 0, which warms up."""
    rows = measurements.filter(F.col("round") > 0)
    out = rows.groupBy(by).agg(F.median("seconds").alias("median_s"), F.max("rss_kib").alias("max_rss_kib"), F.max(F.col("vram_peak_mib") - F.col("vram_baseline_mib")).alias("max_vram_rise_mib"))
    return out.select(by, "median_s", (F.col("median_s") / audio_s).alias("rtf"), "max_rss_kib", "max_vram_rise_mib")


def benchmark_ratio(measurements: DataFrame, a: str, b: str, by="device", key: list[str] | None = None) -> DataFrame:
    """Medians of two variants side by side, as a_s and b_s, and their quotient as ratio; without round 0."""
    rows = measurements.filter(F.col("round") > 0)
    out = rows.groupBy(*(key or [])).pivot(by, [a, b]).agg(F.median("seconds"))
    return out.select(*(key or []), F.col(a).alias("a_s"), F.col(b).alias("b_s"), (F.col(a) / F.col(b)).alias("ratio"))


#: A number of JSON that stands alone.
NUMBER = r"(?<![0-9A-Za-z.+-])-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![0-9A-Za-z.+-])"
#: What Spark's reader of JSON allows beyond JSON.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _json_parts(pointer: Column, text: Column) -> Column:
    """What a marked JSON container holds, as structs of pointer and text; of a name that is there twice, the last."""
    def last(members):
        names = F.transform(members, lambda m: m["key"])
        of_each = F.filter(members, lambda m, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), m["key"]))
        return F.when(F.size(F.array_distinct(names)) == F.size(names), members).otherwise(of_each)

    # a list of one binds what is read once
    members = F.transform(F.array(F.map_entries(F.from_json(text, "map<string,string>", STRICT))), last)[0]
    step = lambda name: F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    part = lambda name, value: F.struct(F.concat(pointer, F.lit("/"), name).alias("pointer"), value.alias("text"))
    inside = F.transform(members, lambda m: part(step(F.substring(m["key"], 2, 2**31 - 1)), m["value"]))
    items = F.transform(F.from_json(text, "array<string>", STRICT), lambda x, i: part(i.cast("string"), x))
    return F.when(text.startswith("{"), inside).when(text.startswith("["), items)


def flatten_json(df: DataFrame, json: str, key: str, levels=4) -> DataFrame:
    """(key, pointer, value) of all that has no members in a JSON text, at any depth; ~ and / are escaped in names, and numbers stay as they are written.

    Null and what is no JSON have no rows; an empty object or list is a value; of a name
    that an object has twice, the last counts. `levels` levels of nesting are gone through
    in a pass, in the JVM; texts that are deeper need more passes, with a written table between.
    """
    # quotes within strings are written as codes, so that quotes come in pairs; then a string x becomes "|x" and a number 1.50 becomes "1.50|"
    coded = F.replace(F.replace(F.col(json), F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    marked = df.select(key, F.regexp_replace(coded, f'"([^"]*+)"|({NUMBER})', '"$2|$1"').alias("marked"))
    # what closes one of these too early doesn't fit into the other
    in_list = F.from_json(F.concat(F.lit("["), "marked", F.lit("]")), "array<string>", STRICT)
    in_object = F.from_json(F.concat(F.lit('{"":'), "marked", F.lit("}")), "map<string,string>", STRICT)
    valid = F.filter(F.array(F.struct(in_list.alias("list"), in_object.alias("object"))), lambda x: (F.size(x["list"]) == 1) & (F.size(x["object"]) == 1))
    rows = marked.select(key, F.explode(valid).alias("x")).select(key, F.lit("").alias("pointer"), F.col("x.list")[0].alias("text"), F.lit(False).alias("ended"))
    done = None
    while True:
        for _ in range(levels):
            parts = _json_parts(F.col("pointer"), F.col("text"))
            rows = rows.withColumn("parts", F.when(~F.col("ended"), parts))
            itself = F.array(F.struct("pointer", "text"))
            rows = rows.select(key, F.explode(F.when(F.size("parts") > 0, F.col("parts")).otherwise(itself)).alias("x"), (F.coalesce(F.size("parts"), F.lit(0)) <= 0).alias("ended")).select(key, "x.pointer", "x.text", "ended")
        rows = rows.withColumn("ended", F.col("ended") | ~F.coalesce(F.col("text").startswith("{") | F.col("text").startswith("["), F.lit(False)))
        rows = written(rows, "json-leaves")
        part = rows.filter("ended")
        done = part if done is None else done.unionByName(part)
        rows = rows.filter("NOT ended")
        if not rows.limit(1).count():
            break
    # an empty container is told by its first sign, whatever blanks it holds
    value = F.when(F.col("text").startswith("|"), F.substring("text", 2, 2**31 - 1)).when(F.col("text").endswith("|"), F.expr("left(text, length(text) - 1)")).when(F.col("text").startswith("{"), "{}").when(F.col("text").startswith("["), "[]").otherwise(F.col("text"))
    return done.select(key, "pointer", value.alias("value"))


def json_nodes(df: DataFrame, json: str, key: str) -> DataFrame:
    """(key, pointer, parent, kind, text): every value in a JSON text, a container too, by its pointer; kind is object, array or value, and text is JSON. What is no JSON has no rows.

    A level of nesting is a step, in the JVM; each is a written table.
    """
    spark = df.sparkSession
    shape = F.schema_of_variant("v")
    kind = F.when(shape.startswith("OBJECT<"), "object").when(shape.startswith("ARRAY<"), "array").otherwise("value")
    level = df.select(key, F.lit("").alias("pointer"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(json).alias("v")).filter("v IS NOT NULL")
    out = None
    while True:
        level = written(level.withColumn("kind", kind), "json-level")
        part = level.select(key, "pointer", "parent", "kind", F.to_json("v").alias("text"))
        out = part if out is None else out.unionByName(part)
        inner = level.filter("kind <> 'value'")
        if not inner.limit(1).count():
            return out
        inner = inner.withColumnRenamed("pointer", "__parent").select(key, "__parent", F.col("v").alias("__v"))
        found = inner.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        name = F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        level = found.select(inner[key].alias(key), F.concat("__parent", F.lit("/"), name).alias("pointer"), F.col("__parent").alias("parent"), F.col("value").alias("v"))


def diff_json(saved: DataFrame, current: DataFrame, key: str, json="json") -> DataFrame:
    """(key, pointer, saved, current) of what differs between two JSON texts of a key, as JSON; null where a side has nothing there.

    Objects are compared by their members and lists by their items, at any depth; what
    is only on one side, or of another kind there, is one difference, whatever it holds.
    Numbers are compared by value, and a null is not the same as nothing.
    """
    a, b = (json_nodes(df, json, key).select(key, "pointer", "parent", F.col("kind").alias(f"kind_{n}"), F.col("text").alias(n)) for df, n in ((saved, "saved"), (current, "current")))
    both = a.join(b.withColumnRenamed("parent", "__parent"), [key, "pointer"], "full_outer").withColumn("parent", F.coalesce("parent", "__parent"))
    both = written(both.drop("__parent"), "json-pairs")
    entered = (F.col("kind_saved") == F.col("kind_current")) & (F.col("kind_saved") != "value")
    inside = both.filter(entered).select(key, F.col("pointer").alias("parent"))
    differs = both.filter(~F.coalesce(entered, F.lit(False)) & ~F.col("saved").eqNullSafe(F.col("current")))
    below = differs.filter("parent IS NOT NULL").join(inside, [key, "parent"], "left_semi")
    return differs.filter("parent IS NULL").select(key, "pointer", "saved", "current").unionByName(below.select(key, "pointer", "saved", "current"))


def differing_fields(saved: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, fields): the pointers of diff_json, sorted and joined with a comma, of keys that both have and that differ."""
    both = saved.select(key).join(current.select(key), key, "left_semi").distinct()
    return changed_fields(diff_json(saved.join(both, key, "left_semi"), current.join(both, key, "left_semi"), key), key)


def duration_after_vad(duration: Column | str, vad: Column | str) -> Column:
    """Null if the speech filter was on, else the duration."""
    d, v = (F.col(c) if isinstance(c, str) else c for c in (duration, vad))
    return F.when(~v, d)


def real_time_factor(wall_s: Column | str, samples: Column | str) -> Column:
    w, s = (F.col(c) if isinstance(c, str) else c for c in (wall_s, samples))
    return w / (s / float(RATE))
