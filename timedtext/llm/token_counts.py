"""Token counts with a piece vocabulary, also of huge documents.

A text of up to CHUNK characters is encoded as it is. A longer one is cut into
chunks that overlap; each is encoded with offsets, and two neighbours are
spliced at a place in the overlap where both have a token boundary that is
proven stable: between two characters that no piece of the vocabulary has next to
each other, which is looked up when it is loaded. No merge crosses such a place, so
what lies on either side has no effect on the other. There are such places behind
words, and in texts without blanks too. An overlap is made as wide as the nearest
one asks for, and a chunk without any goes on to the next one.

Defined cases: null and empty texts have 0 tokens. Equal rows are counted each,
whatever their ids. A stretch without any place to splice, such as one letter over and
over, is encoded as a whole. An empty table gives an empty one. All other columns are carried; those
named n_bytes, n_tokens or over_limit are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import shared

VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
CHUNK, OVERLAP = 65_536, 512
BLANK = "▁"
#: Characters that normal forms would change or put together.
PROBE = "x ﬁ①Å e\u0301 각 \u3000y\xa0z\t\r\n  ²"


class Counter:
    def __init__(self, path: str, chunk=CHUNK, overlap=OVERLAP) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: Pairs of characters that some piece has next to each other.
        self.joined = frozenset(p[i : i + 2] for p in names for i in range(len(p) - 1))
        #: Whether characters stay as they are but for blanks, and unknown ones are bytes, not one token together.
        self.proven = self.sp.normalize(PROBE) == BLANK + PROBE.replace(" ", BLANK) and any(map(self.sp.is_byte, range(len(names))))

    def stable(self, text: str, at: int) -> bool:
        """Whether no token can have the characters on both sides of a place."""
        return text[at - 1 : at + 1].replace(" ", BLANK) not in self.joined

    def count(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk or not self.proven else "" for t in texts]
        counts = [len(x) for x in self.sp.encode(short, num_threads=1, return_type="numpy")]
        return [n if len(s) == len(t) else self.count_long(t) for n, s, t in zip(counts, short, texts, strict=True)]

    def bounds(self, text: str, start: int, end: int) -> list[int]:
        """Where the tokens of text[start:end] begin, and the end."""
        part = text[start:end]
        begins = np.fromiter((p.begin for p in self.sp.encode(part, return_type="proto").pieces), np.int64)
        if not part.isascii():  # the offsets are in bytes
            chars = np.flatnonzero((np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80)
            begins = np.searchsorted(chars, begins, "right") - 1
        return [*(start + begins).tolist(), end]

    def count_long(self, text: str) -> int:
        total, start, end = 0, 0, min(self.chunk, len(text))
        counted = 0  # tokens before this place are counted
        here = self.bounds(text, start, end)
        while end < len(text):
            last = next((x for x in range(end - 1, counted, -1) if self.stable(text, x)), None)
            wide, cut = self.overlap if last is None else self.overlap + end - last, None
            while last is not None and cut is None and wide < end - counted:
                begin = end - wide
                upto = min(begin + max(self.chunk, 2 * wide), len(text))
                there = self.bounds(text, begin, upto)
                both = set(here) & set(there)
                cut = max((x for x in both if max(begin, counted) < x < end and self.stable(text, x)), default=None)
                wide *= 2
            if cut is None:  # no place to splice in the whole chunk: take more text, to behind the next place
                after = next((x for x in range(end, len(text)) if self.stable(text, x)), len(text))
                upto = min(after + self.overlap, len(text))
                begin, there = start, self.bounds(text, start, upto)
            else:
                total += sum(counted <= x < cut for x in here)
                counted = cut
            start, end, here = begin, upto, there
        return total + sum(counted <= x < end for x in here)


@functools.lru_cache(maxsize=4)
def counter(path: str | None) -> Counter:
    """Loaded once for each Python worker; without a path, the file of the public package there."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Counter(path)


def count_tokens(df: DataFrame, text="text", path: str | None = None, limit=LIMIT) -> DataFrame:
    """`df` with n_bytes, n_tokens and over_limit."""

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for batch in batches:
            counts: list[int] = []
            for i in range(0, len(batch), 256):
                counts += c.count([t or "" for t in batch.iloc[i : i + 256]])
            yield pd.Series(counts, dtype="int64")

    counts = [F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.coalesce(text, F.lit(""))).alias("n_tokens")]
    out = df.select(*(c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")), *counts)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(shared.documents(spark, sf_dir).select("doc_id", "text")).drop("text")
