"""BPE encoding and decoding with a byte-level vocabulary.

A text is cut at special strings and by the vocabulary's pattern into words;
each distinct word of a batch is encoded once. The adjacent pairs of a word are
the leaves of a segment tree over (rank, place): its root is the leftmost pair
of lowest rank. A merge changes three leaves, each with a walk to the root, and
the word is done when the root is empty. Short words of like size are worked on
together as rows of numpy arrays, long ones one by one; both follow the same
steps. Tokenizers are read, never trained.

Defined cases: null and empty texts have no ids. Ids outside the vocabulary
decode to nothing, and bytes that are not UTF-8 to U+FFFD, as the tokenizers
library does. Repeated rows stay; an empty table gives an empty one. All other
columns are carried, and one that has the name of the result is replaced, in
`encode` as in `decode`. A very long text is worked on in slices, so only its
ids and a slice are in memory.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timedtext.llm import shared

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the byte-level pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same without some letters and numbers.
NARROWED = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{0}]]+| ?[\p{{N}}--[{0}]]+| ?[^\s[\p{{L}}\p{{N}}--[{0}]]]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 60
#: Sizes of trees that are worked on together; longer words go one by one.
WIDTHS, ROWS = (4, 8, 16, 32, 64), 4096
CACHED_WORDS, SLICE_WORDS, SLICE_CHARS = 400_000, 200_000, 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in the vocabulary's file, by the public byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def later_letters() -> frozenset[str]:
    """Letters and numbers of the regex package's version of Unicode that are neither in the tokenizers library's.

    Only what Python's own older version does not know is put to the library.
    """
    from tokenizers import pre_tokenizers

    known = regex.compile(r"\p{L}|\p{N}")
    asked = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] not in "LN" and known.match(c)]
    # a letter stays with the letter before it, a number with the digit behind it
    begins = {a for _, (a, _) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"a{c}1\n" for c in asked))}
    return frozenset(c for k, c in enumerate(asked) if 4 * k + 1 in begins and 4 * k + 2 in begins)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, .. of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Words:
    """Distinct words that are encoded already: ids[starts[k] : starts[k] + counts[k]] for the word of number k."""

    def __init__(self, special: dict[str, int]) -> None:
        self.number = {w: i for i, w in enumerate(special)}
        self.ids = np.array([*special.values()], np.int32)
        self.starts, self.counts = np.arange(len(special)), np.ones(len(special), np.int64)

    def add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.counts), len(self.counts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pieces = dict.fromkeys(range(max([*vocab.values(), *self.special.values()]) + 1), b"")
        pieces |= {i: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w, i in vocab.items()}
        pieces |= {i: w.encode() for w, i in self.special.items()}
        self.size = len(pieces)
        self.lengths = np.array([*(len(pieces[i]) for i in range(self.size)), 0])
        self.bytes = np.frombuffer(b"".join(pieces[i] for i in range(self.size)), np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges])
        self.merged = np.array([vocab[a + b] for a, b in merges])
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern, self.later = regex.compile(PATTERN), later_letters()
        self.narrowed = regex.compile(NARROWED.format("".join(sorted(self.later))), regex.V1) if self.later else self.pattern
        self.words = Words(self.special)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where they don't merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def encode_rows(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words of at most `width` bytes, a row of a segment tree for each."""
        n, shift = len(words), width.bit_length()
        sizes = np.fromiter(map(len, words), np.int64, n)
        cols = np.arange(width)
        alive = cols < sizes[:, None]
        sym = np.full((n, width + 2), -1, np.int64)  # the last two columns stand for no neighbour
        sym[:, :width][alive] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
        before = np.concatenate([before, np.zeros((n, 1), np.int64)], axis=1)
        value = lambda rank, at: np.where(rank < 0, NONE, (rank << shift) | at)
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = value(self.rank(sym[:, :width], sym[:, 1 : width + 1]), cols)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            left = root & ((1 << shift) - 1)
            right = after[rows, left]
            new, far, near = self.merged[root >> shift], after[rows, right], before[rows, left]
            sym[rows, left], after[rows, left], before[rows, far], alive[rows, right] = new, far, left, False
            tree[rows, width + right] = NONE
            prior = np.where(near < 0, left, near)  # without a left neighbour, the leaf is set again just below
            tree[rows, width + prior] = value(self.rank(sym[rows, near], new), prior)
            tree[rows, width + left] = value(self.rank(new, sym[rows, far]), left)
            nodes = [(width + x) >> 1 for x in (right, prior, left)]
            while nodes[0][0]:
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
                nodes = [x >> 1 for x in nodes]
            rows = rows[tree[rows, 1] < NONE]
        return sym[:, :width][alive], alive.sum(axis=1)

    def encode_long(self, word: bytes) -> np.ndarray:
        """One word of any length with a segment tree of its own."""
        sym = [int(self.of_byte[b]) for b in word]
        n, width = len(sym), 1 << (len(sym) - 1).bit_length()
        none, size, rank_of = (len(self.keys), 0), self.size, self.rank_of
        leaf = lambda i, j: (rank_of.get(sym[i] * size + sym[j], len(self.keys)), i) if 0 <= i and j < n else none
        tree = [none] * width + [leaf(i, i + 1) for i in range(n)] + [none] * (width - n)
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))
        alive = bytearray(b"\1") * n
        while tree[1][0] < len(self.keys):
            rank, left = tree[1]
            right = after[left]
            far = after[right]
            sym[left], after[left], before[far], alive[right] = int(self.merged[rank]), far, left, 0
            for at, v in ((right, none), (before[left], leaf(before[left], left)), (left, leaf(left, far))):
                if at >= 0:
                    x = width + at
                    tree[x] = v
                    while x > 1:
                        x >>= 1
                        tree[x] = min(tree[2 * x], tree[2 * x + 1])
        return np.array([s for s, a in zip(sym, alive, strict=True) if a], np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        counts, parts = np.zeros(len(raw), np.int64), {}
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        low = 0
        for width in WIDTHS:
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            for i in range(0, len(mine), ROWS):
                some = mine[i : i + ROWS]
                ids, counts[some] = self.encode_rows([raw[k] for k in some], width)
                ends = np.cumsum(counts[some])
                parts.update((int(k), ids[e - counts[k] : e]) for k, e in zip(some, ends, strict=True))
            low = width
        for k in np.flatnonzero(sizes > low):
            parts[int(k)] = ids = self.encode_long(raw[k])
            counts[k] = len(ids)
        return np.concatenate([np.zeros(0, np.int64), *(parts[k] for k in range(len(raw)))]).astype(np.int32), counts

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words and special strings of a text, in lists of bounded length."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield [part]
                continue
            pattern = self.pattern if part.isascii() or self.later.isdisjoint(part) else self.narrowed
            if len(part) <= SLICE_CHARS:
                yield pattern.findall(part)
            else:
                found = (m[0] for m in pattern.finditer(part))
                while some := list(itertools.islice(found, SLICE_WORDS)):
                    yield some

    def lookup(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each list has."""
        if len(self.words.number) > CACHED_WORDS:
            self.words = Words(self.special)
        known = self.words.number
        new = list(dict.fromkeys(w for w in itertools.chain.from_iterable(words) if w not in known))
        if new:
            self.words.add(new, *self.encode_words(new))
        numbers = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(words)), np.int64)
        counts = self.words.counts[numbers]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(x) for x in words])]
        return self.words.ids[ragged(self.words.starts[numbers], counts)], np.diff(ends, prepend=0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        pending: list[list[str]] = []
        owners: list[int] = []

        def flush() -> None:
            if pending:
                some, n = self.lookup(pending)
                ids.append(some)
                np.add.at(counts, owners, n)
                pending.clear()
                owners.clear()

        held = 0
        for k, text in enumerate(texts):
            for words in self.pieces(text or ""):
                pending.append(words)
                owners.append(k)
                if (held := held + len(words)) > SLICE_WORDS:
                    flush()
                    held = 0
        flush()
        return np.concatenate(ids), counts

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        return self.bytes[ragged(self.places[ids], self.lengths[ids])].tobytes()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str | None) -> Vocabulary:
    """Loaded once for each Python worker; without a path, the file of the public package there."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Vocabulary(path)


def _slices(batches: Iterator[pa.RecordBatch], rows=1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encode(df: DataFrame, text="text", ids="ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with the column `ids`, an array of int."""
    keep = [c for c in df.columns if c != ids] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in _slices(batches):
            flat, counts = v.encode(b.column("__bpe_text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*keep, ids])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(*keep, F.col(text).alias("__bpe_text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids="ids", text="text", path: str | None = None) -> DataFrame:
    """`df` with the column `text` that its column `ids` stands for; null ids are no ids."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in _slices(batches):
            rows = b.column(ids)
            texts = [v.decode(np.asarray(rows[i].values.fill_null(-1))).decode(errors="replace") if rows[i].is_valid else "" for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, text])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())]))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    done = decode(encode(shared.documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"]), text="decoded")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
