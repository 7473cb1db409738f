"""Column functions on text and times."""

from __future__ import annotations

import functools
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples in a second, and what counts as white space here.
RATE = 16_000
BLANKS = " \n\r\t"
#: Characters at the end of a text that are looked at first.
TAIL = 32


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Runs of space, line feed, carriage return and tab as one space, and none at the ends."""
    return F.trim(F.regexp_replace(_column(c), "[ \n\r\t]+", " "))


def trim_text(c: Column | str) -> Column:
    """Without the same four characters at the ends."""
    return F.btrim(_column(c), F.lit(BLANKS))


def sentence_end(c: Column | str) -> Column:
    """Whether the last character, but for closing quotes and brackets, ends a sentence."""
    c, ends, tail = _column(c), "[.!?…。][\"')\\]}»”’]*\\z", F.right(_column(c), F.lit(TAIL))
    # a long text is not searched from its start but where its tail is nothing but these
    return F.when(tail.rlike("[^\"')\\]}»”’]"), tail.rlike(ends)).otherwise(c.rlike(ends))


def code_points(c: Column | str) -> Column:
    return F.char_length(_column(c)).cast("long")


def finite(c: Column | str) -> Column:
    c = _column(c)
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def milliseconds(seconds: Column | str) -> Column:
    """Rounded half away from zero, after the multiplication; null for what is not finite."""
    return F.when(finite(seconds), F.round(_column(seconds) * 1000)).cast("long")


def clock(ms: Column | str, point: str) -> Column:
    """HH:MM:SS and milliseconds; hours are not bounded, and null stands for a negative time."""
    ms = _column(ms)
    hours, minutes, rest = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    return F.when(ms >= 0, F.format_string(f"%02d:%02d:%02d{point}%03d", hours, minutes, rest, ms % 1000))


def srt_time(seconds: Column | str, strict=False) -> Column:
    """HH:MM:SS,mmm; negative or not finite: null, or an error if `strict`."""
    seconds = _column(seconds)
    good = ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    bad = F.raise_error(F.lit("invalid time")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(good, clock(milliseconds(seconds), ",")).otherwise(bad)


def vtt_time(ms: Column | str) -> Column:
    """HH:MM:SS.mmm of whole milliseconds."""
    return clock(ms, ".")


def cue_escape(c: Column | str) -> Column:
    """Normalized, with & < > escaped and NUL dropped."""
    out = F.replace(normalize_text(c), F.lit("&"), F.lit("&amp;"))
    out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit("\0"), F.lit(""))


#: The doubles nearest to the middles between two tenths, and whether they go to the upper one: those that lie above the middle do, and of the two that are exactly a middle the one whose upper tenth is even.
MIDDLES = [((2 * k + 1) / 20, Fraction((2 * k + 1) / 20) > Fraction(2 * k + 1, 20) or k == 7) for k in range(10)]


def format_seconds(seconds: Column | str) -> Column:
    """With one decimal, as C has `%.1f`: the exact value of the double is rounded, half to even. (Java's rounds its shortest decimal form, half up.)"""
    x = _column(seconds).cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    rest = size - whole  # exact
    tenths = functools.reduce(lambda a, b: a + b, (F.when(rest >= m if up else rest > m, 1).otherwise(0) for m, up in MIDDLES))
    # the sign bit of -0.0 is seen in its text only
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    shown = F.concat(sign, (whole + F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    large = F.when(x.isNotNull(), F.format_string("%.1f", x))
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(size < 2.0**53, shown).otherwise(large)


def samples_to_seconds(samples: Column | str) -> Column:
    return _column(samples) / F.lit(float(RATE))


def seconds_to_samples(seconds: Column | str) -> Column:
    """The number of samples that cover a time: rounded up."""
    return F.ceil(_column(seconds) * RATE).cast("long")


def content_hash(c: Column | str) -> Column:
    """SHA-256 in lower-case hex of text or bytes."""
    return F.sha2(_column(c).cast("binary"), 256)


def valid_language(c: Column | str) -> Column:
    """At most 16 of a-z and hyphen; empty is valid."""
    return _column(c).rlike("^[a-z-]{0,16}\\z")


def normalize_language(c: Column | str) -> Column:
    return F.lower(trim_text(c))
