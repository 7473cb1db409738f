"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed together; more only for one word that is longer. A worker has a few hundred bytes of arrays for each of them, and keeps two tables of powers.
PIECE = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Blanks and all of ASCII that is not a letter or a digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread one-to-one function of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(text: bytes, size: int = PIECE, between=_SPACE) -> Iterator[bytes]:
    """`text` cut behind blanks, or other bytes, into pieces of at most `size` bytes, more only where there is none."""
    at = 0
    while len(text) - at > size:
        window = np.frombuffer(text, np.uint8, size, at)
        blanks = np.flatnonzero(between[window])
        if len(blanks):
            end = at + int(blanks[-1]) + 1
        else:
            rest = np.flatnonzero(between[np.frombuffer(text, np.uint8, len(text) - at - size, at + size)])
            end = at + size + int(rest[0]) + 1 if len(rest) else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _last_words(text: bytes, end: int, span: int) -> bytes:
    """The last `span` words of text[:end], as far as there are so many."""
    size = 64
    while True:
        # the first word of a part may be cut
        part = text[max(0, end - size) : end]
        found = _WORDS.findall(part)
        if len(found) > span or size >= end:
            return b" ".join(found[-span:])
        size *= 4


def framed(text: bytes, span: int, size: int = PIECE) -> Iterator[tuple[bytes, int, int]]:
    """The pieces of a text, each with the `span` words before and behind it, and how many of its words are such at its begin and end."""
    at = 0
    for piece in pieces(text, size):
        end = at + len(piece)
        before = _last_words(text, at, span)
        behind = b" ".join(m[0] for m in itertools.islice(_WORDS.finditer(text, end), span))
        yield b" ".join(x for x in (before, piece, behind) if x), len(before.split(b" ")) if before else 0, len(behind.split(b" ")) if behind else 0
        at = end


class Scan:
    """The words of some texts: hash, start and end in `raw`, and the number of the text."""

    def __init__(self, texts: list[bytes], fold=True, between=_SPACE) -> None:
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self.raw = raw
        folded = _FOLD[raw] if fold else raw
        space = between[raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        size = 1 << max(PIECE + 4096, len(raw)).bit_length()
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[folded] * _powers(size, _BASE)[: len(raw)], out=sums[1:])
        self._sums, self._inverse = sums, _powers(size, _INVERSE)
        self.hashes = self.hash(self.starts, self.ends)
        borders = np.cumsum([len(t) + 1 for t in texts])
        self.owners = np.searchsorted(borders, self.starts, "right")
        self.counts = np.bincount(self.owners, minlength=len(texts)) if texts else np.zeros(0, np.int64)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the parts of `raw` from starts to ends."""
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


def batches(texts: list[str | None], size: int | None = None, between=_SPACE) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of texts, together at most about `size` bytes, with the number of the text that each is from."""
    size = size or PIECE
    owners: list[int] = []
    held: list[bytes] = []
    n = 0
    for k, text in enumerate(texts):
        for piece in pieces((text or "").encode("utf-8", "surrogatepass"), size, between):
            if held and n + len(piece) > size:
                yield owners, held
                owners, held, n = [], [], 0
            owners.append(k)
            held.append(piece)
            n += len(piece)
    if held:
        yield owners, held


def framed_batches(texts: list[str | None], span: int, size: int | None = None) -> Iterator[tuple[np.ndarray, Scan, np.ndarray]]:
    """Scans of pieces with the words around them: the text that each word is from, the scan, and which words are the piece's own."""
    size = size or PIECE
    held: list[tuple[int, bytes, int, int]] = []

    def made() -> tuple[np.ndarray, Scan, np.ndarray]:
        scan = Scan([x for _, x, _, _ in held])
        first = np.cumsum(scan.counts) - scan.counts
        place = np.arange(len(scan.hashes)) - first[scan.owners]
        lead, tail = (np.array([x[i] for x in held], np.int64) for i in (2, 3))
        own = (place >= lead[scan.owners]) & (place < (scan.counts - tail)[scan.owners])
        return np.array([k for k, *_ in held], np.int64)[scan.owners], scan, own

    n = 0
    for k, text in enumerate(texts):
        for piece, lead, tail in framed((text or "").encode("utf-8", "surrogatepass"), span, size):
            if held and n + len(piece) > size:
                yield made()
                held, n = [], 0
            held.append((k, piece, lead, tail))
            n += len(piece)
    if held:
        yield made()


def word_hashes(texts: list[str | None], fold=True) -> list[np.ndarray]:
    """For each text the hashes of its words in order; A-Z count as a-z with `fold`."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for owners, held in batches(texts):
        scan = Scan(held, fold)
        for k, x in zip(owners, np.split(scan.hashes, np.cumsum(scan.counts)[:-1]), strict=True):
            parts[k].append(x)
    return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]
