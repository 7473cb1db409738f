"""BPE, secret scans and token counts against the libraries and plain loops."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import random
import re
import unicodedata
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from timedtext.llm import bpe, secret_scan, token_counts

RANDOM = random.Random(3)
ODD = ["", " ", "\n\n  a", "x <|endoftext|> y<|endoftext|>", "a" * 3000, "ab!" * 500, "é" * 70 + "😀👍🏽" * 30, "it's we'll 've  \t\x1c　z ", "!" * 65, "漢字かな交じり文" * 20, "0123456789" * 30, "a\x00b\x7f"]
ODD += ["".join(chr(RANDOM.choice([RANDOM.randrange(32, 127), RANDOM.randrange(0x80, 0x3000), RANDOM.randrange(0x1F300, 0x1F600)])) for _ in range(2000))]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.VOCABULARY))


def test_bpe_is_the_library(reference):
    v = bpe.vocabulary(None)
    ids, counts = v.encode([*ODD, None])
    ends = np.cumsum(counts)
    got = [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    assert got == [*(reference.encode(t, add_special_tokens=False).ids for t in ODD), []]
    assert [v.decode(np.array(x)).decode(errors="replace") for x in got] == [*ODD, ""]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.lists(st.integers(0, 50_256), max_size=20))
def test_bpe_on_any_text_and_ids(text, ids):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)) if not hasattr(test_bpe_on_any_text_and_ids, "t") else test_bpe_on_any_text_and_ids.t
    test_bpe_on_any_text_and_ids.t = t
    v = bpe.vocabulary(None)
    assert v.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
    assert v.decode(np.array(ids)).decode(errors="replace") == t.decode(ids, skip_special_tokens=False)


def test_words_of_every_code_point_are_the_library_s():
    v = bpe.vocabulary(None)
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # what neither version of Unicode has or what is for private use is one of a kind
    points = [c for c in points if unicodedata.category(c) not in ("Cn", "Co") or v.pattern.fullmatch(f"a{c}") or v.pattern.fullmatch(f"1{c}") or ord(c) % 97 == 0]
    for i in range(0, len(points), 20_000):
        text = "".join(f"{c}'s{c}1a{c}\n" for c in points[i : i + 20_000])
        words = [w for part in v.pieces(text) for w in part]
        ends = list(itertools.accumulate(map(len, words)))
        assert ends == [b for _, (_, b) in cut(text)]


def test_bpe_of_letters_that_are_later(reference):
    v = bpe.vocabulary(None)
    for c in "\u0558\u0c5c\u208f\ua7ce\U0002b73a":
        for t in (f"{c}'s", f"x{c}1 {c}{c}'ll", f"é {c}<|endoftext|>{c}'s"):
            assert v.encode([t])[0].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_bpe_slices_of_long_texts(reference, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 100)
    monkeypatch.setattr(bpe, "SLICE_WORDS", 7)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    v = bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    for t in ODD:
        assert v.encode([t])[0].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_bpe_columns(spark, reference):
    df = spark.createDataFrame([(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (None, "", "y")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, keep=["doc_id"]), text="decoded")
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in out.collect()) == sorted([(1, reference.encode("Hello world").ids, "Hello world")] * 2 + [(2, [], ""), (0, [], "")])
    assert bpe.encode(df.limit(0)).count() == 0 and bpe.decode(bpe.encode(df.limit(0))).count() == 0
    odd = bpe.encode(df.withColumn("__bpe_ids", F.lit(7)).withColumn("words", F.lit("w"))).orderBy(F.col("doc_id").asc_nulls_first()).first()
    assert (odd.ids, odd["__bpe_ids"], odd.words, odd.text) == ([], 7, "w", "")
    assert sorted(r.text for r in bpe.decode(bpe.encode(df)).collect()) == ["", "", "Hello world", "Hello world"]
    assert bpe.decode(spark.createDataFrame([([None, 60_000, 50_256, -3],), (None,)], "ids array<int>")).collect() == [([None, 60_000, 50_256, -3], "<|endoftext|>"), (None, "")]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (100, 8), (300, 64)])
def test_spliced_counts_are_whole_counts(pieces, chunk, overlap):
    c = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY), chunk, overlap)
    assert c.proven
    texts = [*ODD, "a  b   c " * 100, "▁ ▁a▁ b" * 50, "é ü 😀 " * 60, "word " * 500]
    assert c.count(texts) == [len(pieces.encode(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é▁😀\n", max_size=200))
def test_spliced_counts_of_any_text(text):
    c = token_counts.counter(None)
    small = token_counts.Counter.__new__(token_counts.Counter)
    small.sp, small.chunk, small.overlap, small.proven, small.joined = c.sp, 10, 2, True, c.joined
    assert small.count([text]) == [len(c.sp.encode(text))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="的是漢字aab1０ﬁe\u0301🙂%=", max_size=120), st.sampled_from([3, 10, 40]))
def test_spliced_counts_without_blanks(text, chunk):
    c = token_counts.counter(None)
    small = token_counts.Counter.__new__(token_counts.Counter)
    small.sp, small.chunk, small.overlap, small.proven, small.joined = c.sp, chunk, 2, True, c.joined
    assert small.count([text]) == [len(c.sp.encode(text))]


def test_long_texts_without_blanks_are_spliced():
    """Each character is encoded about once, not again and again with wider overlaps."""
    c = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY), 4096, 256)
    rng = np.random.default_rng(2)
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 60_000)))
    encoded = base64.b64encode(rng.bytes(60_000)).decode()
    for text in (chinese, encoded, "的是不了在人" * 8000):
        seen = []
        bounds, c.bounds = c.bounds, lambda t, a, b, f=c.bounds, seen=seen: seen.append(b - a) or f(t, a, b)
        assert c.count([text]) == [len(c.sp.encode(text))]
        c.bounds = bounds
        assert sum(seen) < 1.3 * len(text) and max(seen) < 3 * 4096
    same = "a" * 20_000 + "的" + "b" * 10_000
    assert c.count([same]) == [len(c.sp.encode(same))]


def test_token_count_columns(spark):
    df = spark.createDataFrame([(1, "é a"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in token_counts.count_tokens(df).orderBy("doc_id").collect()] == [(4, 2, False), (0, 0, False), (0, 0, False)]
    assert token_counts.count_tokens(df, limit=1).filter("over_limit").count() == 1 and token_counts.count_tokens(df.limit(0)).count() == 0


def base(text):
    """The base rules, plainly."""
    out = []
    for k, (p, flags, least, group) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6, 2), (r"AKIA[A-Z0-9]+", 0, 20, 0), (r"[0-9a-f]+", 0, 24, 0)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text, flags) if len(m[group]) >= least]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "ſecret", "api_key", "APIKEY", "toKen", " ", ":", "=", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "é", "abc", "=token", "\n"]), max_size=14).map("".join))
def test_base_spans(text):
    assert secret_scan.base_spans(text) == base(text)


SECRET = 'password = "hunter22x"'


@pytest.mark.parametrize(
    ("wrap", "layers"),
    [
        (lambda s: urllib.parse.quote(s), 2),
        (lambda s: urllib.parse.quote(urllib.parse.quote(s)), 3),
        (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), 2),
        (lambda s: base64.b64encode(s.encode()).decode(), 2),
        (lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode().rstrip("="), 2),
        (lambda s: base64.b64encode(zlib.compress(base64.b64encode(zlib.compress(s.encode())))).decode(), 2),
        (lambda s: base64.b64encode(urllib.parse.quote(s).encode()).decode(), 3),
    ],
)
def test_nested_layers(wrap, layers):
    text = f"é {wrap(SECRET)} end"
    spans = secret_scan.scan(text)[1]
    assert any(k == 0 and 2 <= a and b <= len(text) - 4 and b - a >= len(wrap("hunter22")) * 0.5 for a, k, b in spans) and secret_scan.scan(text)[2] >= layers


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress(SECRET.encode() + bytes(600)),
        bz2.compress(b"\x1b[31m" + SECRET.encode() + b"\x1b[0m"),
        b"\xef\xbb\xbf" + SECRET.encode(),
        f"\xa0{SECRET}\u200b\x0c".encode(),
        f"é {SECRET}".encode("latin-1"),
        SECRET.encode("utf-16"),
        SECRET.encode("utf-16-be"),
        SECRET.encode("utf-32"),
        gzip.compress(b"first ") + gzip.compress(SECRET.encode()),
        gzip.compress(SECRET[:9].encode()) + bytes(20) + gzip.compress(SECRET[9:].encode()),
        bz2.compress(b"first ") + bz2.compress(SECRET.encode()),
        lzma.compress(b"first ") + lzma.compress(SECRET.encode()),
        zlib.compress(b"first ") + SECRET.encode(),
        b"x " + SECRET.encode(),
        zlib.compress(SECRET.encode() + bytes(RANDOM.randrange(256) for _ in range(100_000)))[:-9_000],
    ],
)
def test_bytes_that_are_no_text_hide_nothing(data):
    run = base64.b64encode(data).decode()
    assert (2, 0, 2 + len(run.rstrip("="))) in [(a, k, min(b, 2 + len(run.rstrip("=")))) for a, k, b in secret_scan.scan(f": {run} .")[1]]


@pytest.mark.parametrize("width", [19, 64, 76])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, lzma.compress])
@pytest.mark.parametrize(("first", "join", "last"), [("é:\n", "\n", "\n."), ("-----BEGIN X KEY-----\n", "\r\n", "\n-----END"), ('"\\n', "\\n", '\\n"'), ("k: |\n    ", "\n    ", "\nplain words"), ("a word\n", "\n\t", "")])
def test_base64_over_lines(width, pack, first, join, last):
    noise = "".join(RANDOM.choice("ghijk lmnop") for _ in range(400))
    run = base64.b64encode(pack((noise + SECRET + noise).encode())).decode().rstrip("=")
    lines = [run[i : i + width] for i in range(0, len(run), width)]
    text = first + join.join(lines) + last
    start, end = len(first), len(first) + len(join.join(lines))
    assert any(k == 0 and a == start and end <= b <= end + len(last) for a, k, b in secret_scan.scan(text)[1])


def test_base64_over_lines_is_linear():
    assert secret_scan.scan("A" * 3_000_000 + "\n" + "word\n" * 300_000)[2] < 20


def test_valid_parts_of_url_runs():
    escaped = "".join(f"%{b:02x}" for b in b"password=abcdef")
    assert secret_scan.scan(f"%E9%fF{escaped}%E9 x")[1] == [(6, 0, 6 + len(escaped))]
    assert secret_scan.scan("%E9%FF" * 20)[2] == 1


def test_spans_are_exact_in_escapes():
    text = "x%20" + urllib.parse.quote("password=abcdef") + " y"
    assert (4, 0, 4 + len("password%3Dabcdef")) in secret_scan.scan(text)[1]
    text = "token\\u003dabcdef"
    assert (0, 0, len(text)) in secret_scan.scan(text)[1]


@pytest.mark.parametrize("glue", ["/", "-", "x/", "path/to-", "key_", "ab+"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_base64_with_letters_glued_to_it(glue, pack):
    run = base64.b64encode(pack(SECRET.encode())).decode().rstrip("=")
    assert any(k == 0 and a <= len(glue) + 2 and b == len(glue + run) + 2 for a, k, b in secret_scan.scan(f": {glue}{run} .")[1])


@settings(max_examples=120, deadline=None)
@given(st.text("abcXYZ019", max_size=9), st.text("abcXYZ019", max_size=9), st.sampled_from([bytes, gzip.compress, zlib.compress, lambda x: zlib.compress(x, 1), lambda x: zlib.compress(x, 9), lambda x: zlib.compress(x, 0), bz2.compress, lzma.compress, lambda x: lzma.compress(x, lzma.FORMAT_ALONE)]), st.booleans())
def test_base64_with_any_letters_around_it(before, behind, pack, padded):
    run = base64.b64encode(pack(SECRET.encode())).decode()
    run = run if padded and not behind else run.rstrip("=")
    text = f": {before}{run}{behind} ."
    assert any(k == 0 and 2 <= a <= len(before) + 2 and b >= len(before + run) + 2 - 2 * padded for a, k, b in secret_scan.scan(text)[1]), text


def test_letters_that_look_like_heads_are_linear():
    rng = np.random.default_rng(1)
    run = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 400_000)) + "eJw" * 2000
    secret_scan.scan(run + "x" + base64.b64encode(gzip.compress(SECRET.encode())).decode())


def nested(data):
    return base64.b64encode(zlib.compress(data)).decode()


PIECES = [SECRET.encode(), b"AKIA" + b"ABCD" * 5, b"0123456789abcdef" * 3, SECRET.encode("utf-16"), nested(SECRET.encode()).encode(), b"words, and words. ", bytes(range(256)), "\u00e9 \u6f22, ".encode() * 3, b"api_key  =   " + b"k" * 300, b"%70assword%3dabcdefgh"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=30), st.sampled_from([b", ", b"; ", b"", b"\n"]), st.integers(1, 400))
def test_windows_lose_nothing(parts, join, size):
    text = f"x {nested(join.join(parts))} y"
    whole = secret_scan.scan(text)
    window, secret_scan.WINDOW, secret_scan.ROOM = secret_scan.WINDOW, size, 64
    try:
        cut = secret_scan.scan(text)
    finally:
        secret_scan.WINDOW, secret_scan.ROOM = window, 1 << 20
    assert cut[:2] == whole[:2] and not cut[3]


def test_scan_ends():
    bomb = base64.b64encode(zlib.compress(b"secret=abcdefgh " * 10_000)).decode()
    assert secret_scan.scan(bomb)[2:] == (2, False)
    assert secret_scan.scan("%25" * 50 + "41")[2] < 10 and secret_scan.scan(None) == ([], [], 1, False)
    # a stream of members that never stop being compressed data, and one that only looks like it
    deep = SECRET.encode()
    for _ in range(50):
        deep = gzip.compress(deep)
    assert len(secret_scan.scan(f". {base64.b64encode(deep).decode()} .")[1]) == 1
    assert any(k == 0 for _, k, _ in secret_scan.scan(f". {base64.b64encode(b'BZh9 ' + SECRET.encode()).decode()} .")[1])


def test_data_of_any_size_is_scanned_to_its_end(spark, tmp_path, monkeypatch):
    large = base64.b64encode(zlib.compress(bytes(70 << 20) + b", " + SECRET.encode())).decode().rstrip("=")
    small = base64.b64encode(zlib.compress(SECRET.encode())).decode().rstrip("=")
    spark.createDataFrame([(1, large), (2, small)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = secret_scan.op3_secret_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.spans, r.cut_off) for r in rows] == [(f"assign:0:{len(large)}", False), (f"assign:0:{len(small)}", False)]
    monkeypatch.setattr(secret_scan, "XZ_MEMORY", 1 << 16)
    assert secret_scan.scan(base64.b64encode(lzma.compress(SECRET.encode())).decode())[3]


def test_scan_columns(spark):
    df = spark.createDataFrame([(1, "token: abcdef AKIA" + "A" * 16, "k"), (2, None, None), (3, "", None)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(df, keep=["doc_id"]).collect()}
    assert (rows[1].n_assign, rows[1].n_access, rows[1].n_hex, rows[1].base_spans) == (1, 1, 0, "assign:0:13,access:14:34") and rows[2].spans == rows[3].spans == ""
    digest = secret_scan.scan_secrets(df, keep=["doc_id"]).select(F.sha2("base_spans", 256).alias("h")).filter("doc_id = 1").first().h
    assert digest == hashlib.sha256(b"assign:0:13,access:14:34").hexdigest() and secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_counts_carry_columns(spark, pieces):
    rows = [(1, "Some words here", 5, "x"), (1, "Some words here", 5, "x"), (None, None, None, "y"), (2, "", 1, None), (3, "a b " * 5000, 2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string").withColumn("over_limit", F.lit("?")).withColumn("batch", F.lit(1))
    got = token_counts.count_tokens(df, limit=100)
    want = [(i, len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 100, 1) for i, t, *_ in rows]
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit", "batch").collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(df.limit(0)).count() == 0
