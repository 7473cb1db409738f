"""Main text of web pages, by site style trees.

The elements of all pages of a host are laid over each other in one tree, and the
trees of all hosts in another, in which a host counts as a page does in its own; an
element's place is its path of names and classes, with siblings that look alike as
one. A place is important where its presentation (what
it is made of) and its content differ between pages: both are entropies over the
pages that have it. A menu or a notice has few presentations and the same few texts
on all pages, an article has its own. Branches of low importance are cut from each
page, and so are those that markup sets aside (menus, forms, adverts, comments;
what lies outside the article, where one is marked).

    content of a place:      1 - mean over its texts of log(pages with the text) / log(pages)
    presentation of a place: entropy of its styles to the base of the pages
    importance:              (1 - g^l) presentation + g^l content, of l styles

A host's tree decides on places that at least MIN_PAGES pages and SHARE of the
host's pages have, unless nearly all of its text would go (a host of copies); the
tree of all hosts decides on the others by the same rule. So a tree has a bounded
number of places, at most 1 / SHARE times those of a mean page, or host, and is kept
as one row. Hosts with more than 1 / HOT of all pages, of which there are at
most HOT, are sent to all tasks, so that their pages are not dealt out by host.

Defined cases: null or empty html gives an empty text, as does a page without text
of its own. A null, broken or empty url has no host: the tree of all hosts decides.
Repeated rows count as often as they are there and each has its text. A page of any
length is taken whole. An empty table gives an empty one. Columns besides page_id,
url and html are not read, whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import dom, shared

MIN_PAGES, SHARE, LOWEST, DECAY, LEFT, HOT = 10, 0.01, 0.5, 0.9, 0.2, 500
#: Rows that a task sums up before it sends them on.
HELD = 200_000
STYLE, TEXT, PAGE = 0, 1, 2


def host(url: Column) -> Column:
    """Host of a url, lower-cased; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, kind, value, n, chars): how many pages of a host have which style or text at a place, and that place, or -1 for a page with text."""
    held: dict[tuple, list[int]] = {}

    def sent() -> pa.RecordBatch:
        keys, sums = list(held), np.array(list(held.values()), np.int64).reshape(-1, 2)
        columns = [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["host", "node", "kind", "value", "n", "chars"])

    for b in batches:
        for site, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
            if not site:
                continue
            blocks, styles = dom.walk(page.as_py() or "")
            seen: dict[tuple, int] = {}
            for x in blocks:
                k = (x.node, TEXT, _hash(x.text))
                seen[k] = seen.get(k, 0) + len(x.text)
                seen[x.node, PAGE, 0] = 0
            for node, style in styles:
                seen[node, STYLE, _hash(style)] = 0
            if blocks:
                seen[-1, PAGE, 0] = 0
            for k, chars in seen.items():
                x = held.setdefault((site, *k), [0, 0])
                x[0] += 1
                x[1] += chars
            if len(held) >= HELD:
                yield sent()
                held.clear()
    if held:
        yield sent()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def counted(pages: DataFrame) -> DataFrame:
    """The counts of pages (host, html), written: (host, node, kind, value, n, chars)."""
    rows = pages.select("host", "html").mapInArrow(_features, "host string, node long, kind long, value long, n long, chars long")
    return shared.written(rows.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")), "places")


def of_hosts(counts: DataFrame) -> DataFrame:
    """The same for the tree of all hosts, whose host is null: n is a number of hosts."""
    rows = counts.groupBy("node", "kind", "value").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return rows.select(F.lit(None).cast("string").alias("host"), "node", "kind", "value", "n", "chars")


def importances(rows: DataFrame) -> DataFrame:
    """(host, node, pages, all_pages, importance, chars) of counts; all_pages: the pages of the tree."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    log = F.log(F.col("n").cast("double"))
    sums = rows.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == PAGE, F.col("n"))).alias("pages"),
        *[of(STYLE, x).alias(a) for x, a in ((F.lit(1), "styles"), (F.col("n"), "styled"), (F.col("n") * log, "style_logs"))],
        *[of(TEXT, x).alias(a) for x, a in ((F.lit(1), "texts"), (log, "text_logs"), (F.col("chars"), "chars"))],
    )
    whole = sums.filter("node = -1").select(F.col("host").alias("tree"), F.col("pages").alias("all_pages"))
    base = F.log(F.col("pages").cast("double"))
    content = 1 - F.col("text_logs") / F.col("texts") / base
    shape = F.coalesce((F.log(F.col("styled").cast("double")) - F.col("style_logs") / F.col("styled")) / base, F.lit(0.0))
    decay = F.pow(F.lit(DECAY), F.coalesce("styles", F.lit(0)))
    value = F.when(F.col("pages") < 2, 1.0).otherwise((1 - decay) * F.least(shape, F.lit(1.0)) + decay * content)
    places = sums.filter("node <> -1 and texts > 0")
    return places.join(whole, places["host"].eqNullSafe(whole["tree"])).select("host", "node", "pages", "all_pages", value.alias("importance"), "chars")


def site_trees(counts: DataFrame) -> DataFrame:
    """(host, all_pages, low, high), a row a tree that can tell: nodes that are cut, and those that are kept."""
    known = importances(counts).unionByName(importances(of_hosts(counts))).filter((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= SHARE * F.col("all_pages")))
    low = F.col("importance") < LOWEST
    nodes = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("node"))))
    trees = known.groupBy("host").agg(F.max("all_pages").alias("all_pages"), nodes(low).alias("low"), nodes(~low).alias("high"), F.sum(F.when(~low, F.col("chars"))).alias("left"), F.sum("chars").alias("chars"))
    return trees.filter(F.col("left") >= LEFT * F.col("chars")).select("host", "all_pages", "low", "high")


def main_text(page: str, low: frozenset[int], high: frozenset[int], low_anywhere: frozenset[int]) -> tuple[str, int]:
    """Main text, and the number of blocks that the trees cut."""
    blocks = [x for x in dom.walk(page)[0] if not x.aside]
    part = max((x.part for x in blocks), default=0)
    blocks = [x for x in blocks if x.part == part]
    kept = [x.text for x in blocks if x.node not in low and (x.node in high or x.node not in low_anywhere)]
    return " ".join(kept), len(blocks) - len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_cut) of every page of pages (page_id, url, html); n_cut: blocks that the trees cut."""
    pages = pages.select("page_id", "url", "html").withColumn("host", host(F.col("url")))
    trees = shared.written(site_trees(counted(pages)), "site-trees")
    most = trees.filter("host is null").first()
    anywhere = frozenset(most["low"]) if most else frozenset()
    least = max(MIN_PAGES, math.ceil(pages.count() / HOT))
    hot = trees.filter(F.col("host").isNotNull() & (F.col("all_pages") >= least))
    names = [r["host"] for r in hot.select("host").collect()]  # at most HOT
    fields = "page_id {}, url string, text string, n_chars long, n_cut long".format(pages.schema["page_id"].dataType.simpleString())
    of_hot = pages.filter(F.col("host").isin(names)) if names else pages.limit(0)
    others = pages.filter(~F.col("host").isin(names)) if names else pages
    cold = trees.filter(F.col("host").isNotNull() & (F.col("all_pages") < least)).select("host", "low", "high")
    joined = of_hot.join(F.broadcast(hot.select("host", "low", "high")), "host", "left").unionByName(others.join(cold, "host", "left"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for b in batches:
            sets.clear()
            found = []
            for i, (site, page) in enumerate(zip(b.column("host").to_pylist(), b.column("html"), strict=True)):
                if site not in sets:
                    sets[site] = tuple(frozenset(b.column(c)[i].as_py() or ()) for c in ("low", "high"))
                found.append(main_text(page.as_py() or "", *sets[site], anywhere))
            text = pa.array([t for t, _ in found], pa.string())
            numbers = [pa.array(x, pa.int64()) for x in ([len(t) for t, _ in found], [n for _, n in found])]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text, *numbers], names=["page_id", "url", "text", "n_chars", "n_cut"])

    return joined.select("page_id", "url", "host", "html", "low", "high").mapInArrow(texts, fields)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
