"""Reading media files as sample blocks."""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from timedtext.operators.audio import BLOCK, PART, Resampler

#: Tasks that small ranges make at most, as long as none has more than SHARED bytes.
TASKS, SHARED = 512, 64 << 20

#: Bytes to (rate, channels, interleaved samples, of which slices are taken).
Decode = Callable[[bytes], tuple[int, int, Sequence]]


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of the files of a folder, without their content and without subfolders."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "modificationTime", "length")


class WavSamples:
    """The samples of a WAV file's data as floats; a slice is converted when it is taken."""

    def __init__(self, data: memoryview, kind: int, bits: int) -> None:
        self.data, self.kind, self.bits = data, kind, bits

    def __len__(self) -> int:
        return len(self.data) // (self.bits // 8)

    def __getitem__(self, part: slice) -> np.ndarray:
        first, last, _ = part.indices(len(self))
        data = self.data[first * self.bits // 8 : last * self.bits // 8]
        if self.kind == 3:
            return np.frombuffer(data, f"<f{self.bits // 8}").astype(np.float32)
        if self.bits == 8:
            return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
        if self.bits == 24:
            wide = np.zeros((len(data) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
            return (wide.view("<i4")[:, 0] / 2.0**31).astype(np.float32)
        return (np.frombuffer(data, f"<i{self.bits // 8}") / 2.0 ** (self.bits - 1)).astype(np.float32)


class WavHeader(NamedTuple):
    """Format of a WAV file, and where its samples lie."""

    kind: int
    rate: int
    channels: int
    bits: int
    begin: int
    frames: int

    @property
    def width(self) -> int:
        """Bytes of a frame: a sample of each channel."""
        return self.channels * self.bits // 8


def wav_header(file: BinaryIO, length: int) -> WavHeader:
    """Of RIFF or RF64 files with PCM of 8, 16, 24 or 32 bits, or floats of 32 or 64. Data whose size is not known goes on to the file's end."""
    head = file.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    form, wide, at = None, None, 12
    while at + 8 <= length:
        file.seek(at)
        name, size = (x := file.read(8))[:4], int.from_bytes(x[4:], "little")
        body = at + 8
        if name == b"ds64":
            wide = int.from_bytes(file.read(16)[8:], "little")
        elif name == b"fmt ":
            x = file.read(min(size, 40))
            number = lambda i, n=2, x=x: int.from_bytes(x[i : i + n], "little")
            kind = number(24) if number(0) == 0xFFFE else number(0)
            form = (kind, number(4, 4), number(2), number(14))
        elif name == b"data":
            if not form or not form[1] or not form[2] or (form[0], form[3]) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
                break
            size = wide if size == 0xFFFFFFFF and wide else size
            size = min(size, length - body)
            return WavHeader(*form, body, size // (form[2] * form[3] // 8))
        at = body + size + size % 2
    raise ValueError("a WAV file without samples that can be read")


def decode_wav(raw: bytes) -> tuple[int, int, WavSamples]:
    """The samples of a whole file."""
    h = wav_header(io.BytesIO(raw), len(raw))
    return h.rate, h.channels, WavSamples(memoryview(raw)[h.begin : h.begin + h.frames * h.width], h.kind, h.bits)


class FileRange(InputPartition):
    """Bytes of some files: (path, length of the file, first byte, byte behind the last)."""

    def __init__(self, parts: list[tuple[str, int, int, int]]) -> None:
        super().__init__(parts)
        self.parts = parts


class WavRanges(DataSource):
    """Samples of WAV files by ranges of bytes, so that a file is many tasks, whatever its size.

    A range makes the output samples whose place in the input is in it, and reads as
    many frames around it as the resampling filter needs; so the samples are those of a
    file read in a row. Options: path, pattern, range_bytes, block. Files are reached by
    pyarrow's file systems (local, HDFS, S3, GCS).
    """

    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return "rec string, start_sample long, samples array<float>"

    def reader(self, schema) -> WavRangeReader:
        return WavRangeReader(dict(self.options))


class WavRangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.size, self.block = int(options.get("range_bytes", 64 << 20)), int(options.get("block", BLOCK))
        if self.size <= 0 or self.block <= 0:
            raise ValueError("an empty range or block")

    def partitions(self) -> list[FileRange]:
        """Ranges of large files, and small files together, by the listing alone. Ranges that would be more tasks than TASKS share some, up to SHARED bytes in each; those of a file that follow each other are one."""
        store, path = _store(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        files = sorted((f for f in files if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern)), key=lambda f: f.path)
        most = max(self.size, min(SHARED, sum(f.size for f in files) // TASKS))
        out, held, n = [], [], 0
        for f in files:
            for at in range(0, max(1, f.size), self.size):
                end = min(f.size, at + self.size)
                if held and n + end - at > most:
                    out.append(FileRange(held))
                    held, n = [], 0
                low = held.pop()[2] if at and held else at
                held.append((f.path, f.size, low, end))
                n += end - at
        return [*out, FileRange(held)] if held else out

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        """Blocks, of which as many come together as have BLOCK samples."""
        store, _ = _store(self.path)
        rows, n = [], 0
        for path, length, low, high in partition.parts:
            with store.open_input_file(path) as file:
                h = wav_header(file, length)
                first, last = (min(h.frames, max(0, -(-(x - h.begin) // h.width))) for x in (low, high))
                last = h.frames if high >= length else last
                for start, x in resampled_range(file, h, first, last, self.block):
                    rows.append((path, start, x))
                    n += len(x)
                    if n >= BLOCK:
                        yield _blocks(rows)
                        rows, n = [], 0
        if rows:
            yield _blocks(rows)


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    paths, starts, samples = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, samples)], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(samples), pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), lists], ["rec", "start_sample", "samples"])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def resampled_range(file: BinaryIO, h: WavHeader, first: int, last: int, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, samples) of the output samples that lie in the input frames from first to last, in blocks; only the frames that a block needs are read."""
    made = Resampler(h.rate, h.channels)
    begin, end = (-(-x * made.up // made.down) for x in (first, last))
    for at in range(begin, end, block):
        upto = min(at + block, end)
        low = max(0, at * made.down // made.up + 1 - made.half)
        high = min(h.frames, (upto - 1) * made.down // made.up + made.half + 1)
        file.seek(h.begin + low * h.width)
        raw = file.read((high - low) * h.width)
        mono = made.mono(WavSamples(memoryview(raw), h.kind, h.bits)[:])
        made.held, made.at = mono, low
        yield at, np.concatenate([made._part(k, min(k + PART, upto)) for k in range(at, upto, PART)])


def read_wav(spark: SparkSession, path: str, pattern: str = "*", range_bytes=64 << 20, block=BLOCK) -> DataFrame:
    """(rec, start_sample, samples) of the WAV files of a folder, or of one, mono at 16 kHz: read_media, with many tasks for a long file and without its limit of 2 GB."""
    spark.dataSource.register(WavRanges)
    return spark.read.format("wav_ranges").option("pattern", pattern).option("range_bytes", range_bytes).option("block", block).load(path)


def read_pcm(media: DataFrame, block=BLOCK, decode: Decode = decode_wav) -> DataFrame:
    """(rec, start_sample, samples): mono at 16 kHz, in blocks of at most `block` samples. media: path, content, as binaryFile has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rate, channels, samples = decode(b.column("content")[i].as_py())
                resampler, made, step = Resampler(rate, channels), 0, max(1, block * rate // 16_000) * channels
                for at in [*range(0, len(samples), step), None]:
                    x = resampler.drain() if at is None else resampler.push(samples[at : at + step])
                    for k in range(0, len(x), block):
                        part = x[k : k + block]
                        yield pa.RecordBatch.from_arrays([b.column("path")[i : i + 1], pa.array([made], pa.int64()), pa.array([part], pa.list_(pa.float32()))], ["rec", "start_sample", "samples"])
                        made += len(part)

    return media.select("path", "content").mapInArrow(run, "rec string, start_sample long, samples array<float>")


def read_media(spark: SparkSession, path: str, pattern: str | None = None, **how) -> DataFrame:
    """read_pcm of the files of a folder."""
    reader = spark.read.format("binaryFile")
    return read_pcm((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", F.col("content")), **how)
