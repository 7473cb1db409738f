"""Main text of pages: made sites whose article is known, odd pages, and importances by plain counting."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from timedtext.llm import dom, style_tree


def sentence(rng, n=12):
    return " ".join("".join(rng.choice("abcdeéilnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."


def site(seed, n, host):
    """Pages without any telling name, and their articles: menu, rotating notes, article, a box and a footer on each page."""
    rng = random.Random(seed)
    menu, box, notes = [sentence(rng, 2) for _ in range(7)], [sentence(rng, 6) for _ in range(2)], [sentence(rng, 8) for _ in range(3)]
    out = []
    for i in range(n):
        title, body = sentence(rng, 5), [sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(2, 6))]
        inner = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b><br>", "<p>{}\n\t </p><h2>More</h2>"]).format(html.escape(x)) for x in body)
        page = f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body class="with-sidebar"><div class=q1><ul>{"".join(f"<li><a href=/>{m}</a>" for m in menu)}</ul></div>
            <div class=q2>{rng.choice(notes)}</div><div class=q3><h1>{title}</h1>{inner}</div><div class=q4><p>{box[0]}</p><p>{box[1]}</p></div><div class=q5>&copy; {host}</div>
            <script>var x = "</div><p>no</p>";</script></body></html>"""
        out.append((seed * 10_000 + i, f"https://{host}/{i}", page, title, body))
    return out


def in_order(text, parts):
    at = 0
    for p in parts:
        at = text.index(p, at) + len(p)
    return True


def test_sites_without_names(spark):
    pages = [p for k, n in ((1, 40), (2, 25), (3, 300)) for p in site(k, n, f"site{k}.example")]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in style_tree.extract(df).collect()}
    assert len(got) == len(pages)
    for page_id, _, _, title, body in pages:
        r = got[page_id]
        assert in_order(r["text"], [title, *body])
        assert r["text"].replace("More", "").split() == " ".join([title, *body]).split()
        assert r["n_chars"] == len(r["text"]) and r["n_cut"] >= 11


def test_host_of_copies_keeps_its_text(spark):
    page = "<body><div class=a>menu</div><div class=b><p>The one text of all pages.</p></div></body>"
    others = [p for k in range(5, 12) for p in site(k, 3, f"s{k}.example")]
    rows = [(i, f"http://copies.example/{i}", page) for i in range(30)] + [p[:3] for p in others]
    got = style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("page_id < 30").collect()
    assert {r["text"] for r in got} == {"menu The one text of all pages."}


ODD = [
    (None, ""),
    ("", ""),
    ("plain &lt;text&gt; &amp and &#233;&nbsp;x", "plain <text> &amp; and éx".replace("&amp;", "&").replace("éx", "é x")),
    ("<nav>menu</nav><header>top</header><p>a<p>b <b>c</b>d<footer>f</footer>", "a b cd"),
    ("<article><header><h1>T</h1></header>x<aside>q</aside> y<div class='comments'><article class=comment>no</article></div></article> outside", "T x y"),
    ("<main>one<section class='cookie-notice'>no</section></main><div>two</div>", "one"),
    ("<form class=f><input><article>in</article> out</form>", "in"),
    ("<ul><li>x<li>y</ul>z<table><tr><td>1<td>2<tr><td>3</table>", "x y z 1 2 3"),
    ("a<br>b<hr>c<script>var t='</p>'</script>d<STYLE>x</STYLE >e<!-- no -->f<!doctype q>g<?php z?>h</>i", "a b cdefghi"),
    ("a < b <3 c</ p>", "a < b <3 c"),
    ("t<p title='never", "t"),
    ('t<a href="x>y</a> z<p>w', "ty z w"),
    ("x<!-- never", "x"),
    ("x<script>never</scrip>", "x"),
    ("<div class='sidebar'>no</div><div class='contentSide navBar'>no</div><div role=navigation>no</div>yes", "yes"),
    ("<div>" * 5000 + "deep", "deep"),
    ("<b>" * 3000 + "<p>x" * 50, " ".join("x" * 50)),
    ("<body>a</body></html> b", "a b"),
    ("<textarea>no</textarea><select><option>no</select><button>no</button><noscript>no</noscript><template><p>no</template>yes", "yes"),
]


def test_odd_pages(spark):
    rows = [(i, [None, "", "no url", "http://x.example/", "HTTPS://u:p@X.example:80/"][i % 5], h, -1, "z") for i, (h, _) in enumerate(ODD)]
    rows += [rows[3], (None, None, None, 0, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, host string")
    got = style_tree.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_cut"]
    assert sorted((str(r["page_id"]), r["url"] or "-", r["text"]) for r in got.collect()) == sorted((str(r[0]), r[1] or "-", ODD[r[0]][1] if r[0] is not None else "") for r in rows)
    assert style_tree.extract(df.limit(0)).collect() == []


def test_host(spark):
    urls = ["http://A.example.org:80/x", "https://u:p@b.example?q", "ftp://c", "no", "", None, "http:///x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(style_tree.host(df.u)).collect()] == ["a.example.org", "b.example", "c", "", "", "", ""]


@pytest.mark.parametrize("held", [7, 200_000])
def test_importances_by_counting(spark, monkeypatch, held):
    monkeypatch.setattr(style_tree, "HELD", held)
    pages = [p for k, n in ((1, 12), (2, 5)) for p in site(k, n, f"s{k}")]
    found = defaultdict(lambda: (Counter(), Counter(), set()))
    for i, (_, url, page, *_) in enumerate(pages):
        blocks, styles = dom.walk(page)
        tree = re.search("//([^/]*)", url)[1]
        for t in {(b.node, b.text) for b in blocks}:
            found[tree, t[0]][0][t[1]] += 1
            found[tree, t[0]][2].add(i)
        for node, style in set(styles):
            found[tree, node][1][style] += 1
    for (tree, node), (texts, styles, _) in list(found.items()):
        for here, of in zip(found[None, node], (texts, styles), strict=False):
            here.update(list(of))
        found[None, node][2].add(tree)
    want = {}
    for k, (texts, styles, on) in found.items():
        base, total = math.log(len(on)) or 1, sum(styles.values())
        content = 1 - sum(math.log(n) for n in texts.values()) / len(texts) / base
        shape = -sum(n / total * math.log(n / total) for n in styles.values()) / base
        decay = 0.9 ** len(styles)
        want[k] = 1.0 if len(on) < 2 else (1 - decay) * min(shape, 1) + decay * content
    df = spark.createDataFrame([(p[1], p[2]) for p in pages], "url string, html string").repartition(3)
    counts = style_tree.counted(df.withColumn("host", style_tree.host(df.url)))
    rows = style_tree.importances(counts).unionByName(style_tree.importances(style_tree.of_hosts(counts)))
    got = {(r["host"], r["node"]): r["importance"] for r in rows.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_against_plain_cutting(spark):
    """The given pages mark their article; what is in it, without tags, is the text."""
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = style_tree.op12_main_text(spark, sf).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
