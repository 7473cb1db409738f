"""Secret scans through nested encodings.

A worklist starts with the text as it is. Each layer is scanned for secrets,
then unwrapped: URL escapes and Unicode escapes give a layer of the same text
with them resolved; a run of base64, in a line or over lines, gives layers of
what it stands for, after decompression of all members, and of what these hold
in turn, where it is gzip, zlib, bzip2, xz or lzma data. Other letters may stand
before and behind what is encoded, without a mark between. Bytes that are no text do not
hide the text beside them. Layers are worked on until there are none left; a
layer that was there before is not worked on again, which ends cycles. Each
character of a layer knows its place in the text, so every span is one of the
text: escapes map by character, base64 by its whole run.

Decompressed data is a stream, whatever its size: it is cut into windows of
about WINDOW bytes where neither a secret nor an encoded run can go on, and each
is a layer that is gone before the next one is made. So memory is bounded by a
window, by a run that is longer, or by compressed data within compressed data,
which is held whole. Layers are remembered by digests.

Defined cases: null and empty texts have no spans. A span that several layers
show counts once. A very long text is scanned whole, and so is what it unpacks
to; only xz data that asks for more than XZ_MEMORY bytes of memory is not
unpacked, and `cut_off` says so. Equal rows are scanned each; an empty table
gives an empty one. All other columns are carried; those that have the names of
the results are replaced.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timedtext.llm import shared

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: One of these, in lower case, is in every text with an assignment.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r[ \t]*+\n|[\r\n])[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
#: How base64 of gzip, zlib (of its four levels), bzip2, xz and lzma data begins.
HEADS = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo|[/_]Td6WFo|XQAA")
#: Letters of what may be compressed data that are tried before all of it is decoded.
TRIED = 4096
#: No secret, plain or encoded, is shorter than the shortest assignment, and all of its characters are ASCII.
RUN = re.compile(rb"[\x20-\x7e\t\r\n]{12,}")
WIDE = re.compile(rb"[\x20-\x7e\t\r\n](?:\x00[\x20-\x7e\t\r\n]){11,}|[\x20-\x7e\t\r\n](?:\x00{3}[\x20-\x7e\t\r\n]){11,}")
#: A byte behind which nothing that is looked for goes on, in 8-bit text or in wider one.
BREAK = re.compile(rb"\x00{8}|(?<!\x00)[\x01-\x08\x0b\x0c\x0e-\x1f!#$&()*,;<>?@^`|~](?!\x00)")
WINDOW, SLICE, ROOM, XZ_MEMORY = 4 << 20, 1 << 16, 1 << 20, 256 << 20

Span = tuple[int, int, int]
#: Text, length of the escape it stands for, and escape characters for each of its own (0: all of them).
Part = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the layer itself, sorted; leftmost matches that don't overlap, by kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text whose character k stands for starts[k] to ends[k] of the document; without lists, character k for itself, or all of it for `whole`."""

    def __init__(self, text: str, starts=None, ends=None, whole=None) -> None:
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _escaped(layer: Layer, pattern: re.Pattern, resolve) -> Layer | None:
    """The layer with all escapes resolved; resolve gives parts (text, length of the escape, number of escape characters each stands for, or 0 for all)."""
    out, starts, ends, at = [], [], [], 0
    text, changed = layer.text, False
    for m in pattern.finditer(text):
        made = resolve(m[0])
        if made is None:
            continue
        changed = True
        parts = [(at, m.start(), text[at : m.start()], 1)]
        for new, n, each in made:
            parts.append((max(parts[-1][1], m.start()), max(parts[-1][1], m.start()) + n, new, each))
        for a, b, s, step in parts:
            out.append(s)
            if not layer.whole:
                for k in range(len(s)):
                    x, y = layer.span(a + k * step, a + (k + 1) * step) if step else layer.span(a, b)
                    starts.append(x)
                    ends.append(y)
        at = m.end()
    if not changed:
        return None
    out.append(text[at:])
    if layer.whole:
        return Layer("".join(out), whole=layer.whole)
    for k in range(at, len(text)):
        x, y = layer.span(k, k + 1)
        starts.append(x)
        ends.append(y)
    return Layer("".join(out), starts, ends)


def _url(run: str) -> list[Part] | None:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        return [(raw.decode(), len(run), 3 * raw.isascii())]
    except UnicodeDecodeError:
        # what is not UTF-8 stays escaped, the rest is resolved
        parts = [(f"%{ord(c) - 0xDC00:02X}", 3, 1) if 0xDC80 <= ord(c) <= 0xDCFF else (c, 3 * len(c.encode()), 0) for c in raw.decode(errors="surrogateescape")]
        return parts if any(step == 0 for *_, step in parts) else None


def _unicode(run: str) -> list[Part] | None:
    codes = [int(x.strip("{}"), 16) for x in re.split(r"\\[uUx]", run)[1:]]
    if len(codes) == 2:
        return [(chr(0x10000 + ((codes[0] & 0x3FF) << 10) + (codes[1] & 0x3FF)), len(run), 0)]
    return None if codes[0] > 0x10FFFF or 0xD800 <= codes[0] < 0xE000 else [(chr(codes[0]), len(run), 0)]


def _texts(raw: bytes) -> list[str]:
    """What there is to read in any data: as UTF-8 with bytes that are none replaced, and runs of UTF-16 or UTF-32; none where no run is long enough for a secret, plain or encoded."""
    out = [raw.decode(errors="replace")] if RUN.search(raw) else []
    wide = [m[0].replace(b"\0", b"").decode() for m in WIDE.finditer(raw)]
    return [*out, "\n".join(wide)] if wide else out


def _decompressor(raw: bytes):
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=XZ_MEMORY)
    if raw[:3] == b"\x5d\x00\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_ALONE, memlimit=XZ_MEMORY)
    return None


def _seems_packed(run: str) -> bool:
    """Whether the first letters of a run are data that decompresses, as far as they go."""
    raw = _base64(run[:TRIED])
    if not raw or (job := _decompressor(raw[:6])) is None:
        return False
    try:
        job.decompress(raw, ROOM)
    except (zlib.error, OSError, EOFError, lzma.LZMAError) as e:
        return "emory" in str(e)
    return True


def _packed_letters(run: str) -> int:
    """How many letters of a run are the whole compressed data that it begins with; 0 where that breaks off."""
    raw, rest = _base64(run) or b"", []
    for _ in _members(raw, rest, []):
        pass
    done = len(raw) - len(rest[0])
    return done * 4 // 3


def _slices(raw: bytes) -> Iterator[bytes]:
    return (raw[i : i + SLICE] for i in range(0, len(raw), SLICE))


def _fed(job, data: bytes) -> Iterator[bytes]:
    """What a decompressor makes of data, in parts of bounded size."""
    more = True
    while more and not job.eof:
        out = job.decompress(data, ROOM)
        if hasattr(job, "unconsumed_tail"):
            data = job.unconsumed_tail
            more = bool(data) or len(out) == ROOM
        else:
            data, more = b"", not job.needs_input and not job.eof
        if out:
            yield out


def _members(raw: bytes, rest: list[bytes], refused: list[bool]) -> Iterator[bytes]:
    """Decompressed data of all members that follow each other; what is none goes to `rest`, as does a member that breaks off, whole."""
    at = 0
    while (job := _decompressor(raw[at : at + 6])) is not None:
        end = at
        try:
            while not job.eof and end < len(raw):
                part = raw[end : end + SLICE]
                end += len(part)
                yield from _fed(job, part)
        except (zlib.error, OSError, EOFError, lzma.LZMAError) as e:
            refused.append("emory" in str(e))
            break
        if not job.eof:
            break
        at = end - len(job.unused_data)
        while raw[at : at + 1] == b"\0":  # gzip and xz allow zeros after a member
            at += 1
    rest.append(raw[at:])


def _windows(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """A stream in windows that are cut behind a BREAK."""
    held, size, looked = [], 0, 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= WINDOW:
            whole = b"".join(held)
            breaks = [m.end() for m in BREAK.finditer(whole, looked, len(whole) - 1)]
            cut = breaks[-1] if breaks else 0
            if cut:
                yield whole[:cut]
            # without a break, as much again is read before the next try
            held, size, looked = [whole[cut:]], 0, 0 if cut else max(0, len(whole) - 8)
    yield b"".join(held)


def unpacked(raw: bytes, refused: list[bool]) -> Iterator[bytes]:
    """Windows of what data stands for after decompression at any depth. `refused` gets a true for data that asked for too much memory."""
    work, seen = [raw], set()
    while work:
        raw = work.pop()
        if (digest := hashlib.sha256(raw).digest()) in seen:  # data may unpack to itself
            continue
        seen.add(digest)
        rest: list[bytes] = []
        made = _members(raw, rest, refused)
        first = next(made, b"")
        while len(first) < 6 and (more := next(made, None)) is not None:
            first += more
        stream = itertools.chain([first], made)
        if _decompressor(first[:6]) is not None:
            work.append(b"".join(stream))
        else:
            yield from _windows(stream)
        for x in rest:
            yield from _windows(_slices(x))


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, what to decode) of runs of base64: in a line, and over lines.

    Lines that follow each other are taken as one run, and so is each series of
    lines of one width with a shorter one at its end, as other words may stand before it.
    """
    for m in BASE64.finditer(text):
        yield *m.span(), m[0]
    # an escaped line break counts as one; places stay the same
    plain = text.replace("\\r", " \r").replace("\\n", " \n") if "\\" in text else text
    if plain != text:
        for m in BASE64.finditer(plain):
            yield *m.span(), m[0]
    if "\n" not in plain and "\r" not in plain:
        return
    for m in LINES.finditer(plain):
        if m.end() - m.start() < 17:
            continue
        lines = [x.span() for x in LINE.finditer(plain, *m.span())]
        groups, i = {(0, len(lines))}, 0
        while i < len(lines):
            j, width = i + 1, lines[i][1] - lines[i][0]
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            if j < len(lines) and lines[j][1] - lines[j][0] < width:
                j += 1
            if j - i > 1:
                groups.add((i, j))
            i = j
        for i, j in sorted(groups):
            body = "".join(plain[a:b] for a, b in lines[i:j]).rstrip("=")
            if len(body) >= 16:
                yield lines[i][0], lines[j - 1][1], body[: len(body) - (len(body) % 4 == 1)]


def _base64(run: str) -> bytes | None:
    """What a run stands for; a letter too many, which stands for no byte, is left out."""
    body = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _within(layer: Layer, refused: list[bool]) -> Iterator[Layer]:
    """The layers that a layer holds."""
    if "%" in layer.text and (x := _escaped(layer, URL, _url)):
        yield x
    if "\\" in layer.text and (x := _escaped(layer, UNICODE, _unicode)):
        yield x
    for start, end, run in _runs(layer.text):
        covered = 0  # what is compressed data of an earlier head; heads in there are its bytes by chance
        # other letters may be glued to the run: text shows at one of four offsets, compressed data wherever its head is
        heads = [m.start() for m in HEADS.finditer(run) if _seems_packed(run[m.start() : m.start() + TRIED])]
        for at in sorted({0, 1, 2, 3, *heads}):
            if at > 3 and at < covered:
                continue
            if at in heads and at < heads[-1]:
                covered = max(covered, at + _packed_letters(run[at:]))
            if len(run) - at >= 16 and (raw := _base64(run[at:])) is not None:
                whole = layer.span(start + at, end) if len(run) == end - start else layer.span(start, end)
                for window in unpacked(raw, refused):
                    yield from (Layer(t, whole=whole) for t in _texts(window))


def scan(text: str | None) -> tuple[list[Span], list[Span], int, bool]:
    """Base spans, all spans, number of layers, and whether something was not unpacked."""
    text = text or ""
    base = base_spans(text)
    spans, seen, refused = set(base), set(), []
    work, n = [iter([Layer(text)])], 0
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.whole
        if key in seen:
            continue
        seen.add(key)
        n += 1
        if n > 1:
            for a, kind, b in base_spans(layer.text):
                x, y = layer.span(a, b)
                spans.add((x, kind, y))
        work.append(_within(layer, refused))
    return base, sorted(spans), n, any(refused)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, text="text", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with base_spans and spans as kind:start:end lists, counts of base spans by kind, layers and cut_off."""
    keep = list(df.columns) if keep is None else keep
    new = ["base_spans", "spans", "n_assign", "n_access", "n_hex", "layers", "cut_off"]
    keep = [c for c in keep if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                found = [scan(t.as_py()) for t in b.column("__scan_text")]
                made = [pa.array([shown(x[0]) for x in found], pa.string()), pa.array([shown(x[1]) for x in found], pa.string())]
                made += [pa.array([sum(s[1] == k for s in x[0]) for x in found], pa.int64()) for k in range(3)]
                made += [pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], [*keep, *new])

    kinds = [T.StringType()] * 2 + [T.LongType()] * 4 + [T.BooleanType()]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, k) for c, k in zip(new, kinds, strict=True))])
    return df.select(*keep, F.col(text).alias("__scan_text")).mapInArrow(run, schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan_secrets(shared.documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return done.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "cut_off")
