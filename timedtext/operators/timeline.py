"""Frame timestamps, decoder damage and the timeline of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from timedtext.functions.text import RATE
from timedtext.operators.scan import BITS, block_scan

#: Jitter that is snapped, the longest gap that is kept in a transport stream, and errors without progress.
JITTER, LONGEST_GAP, STALLED = RATE // 10, 10 * RATE, 1024
#: Codes that are flow control (try again, end of file) and codes that end the run (no memory, exit, interrupted).
AGAIN, END_OF_FILE, NO_MEMORY, EXIT, INTERRUPTED = -11, -541478725, -12, -1414092869, -4
_BOUND = (2**63 - 1) // 4


def classify_code(code: Column | str) -> Column:
    """ok, flow, fatal or recoverable."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c >= 0, "ok").when(c.isin(AGAIN, END_OF_FILE), "flow").when(c.isin(NO_MEMORY, EXIT, INTERRUPTED), "fatal").otherwise("recoverable")


def rescale_pts(pts: Column | str, numerator: int, denominator: int, strict=False, origin: Column | str | None = None) -> Column:
    """Ticks of numerator/denominator seconds to samples, rounded half away from zero, less `origin` samples; null, or an error if `strict`, when out of range."""
    c = (F.col(pts) if isinstance(pts, str) else pts).cast("decimal(19,0)")
    up, down = F.lit(numerator * RATE).cast("decimal(10,0)"), F.lit(denominator).cast("decimal(9,0)")
    # half away from zero: floor((2 |x| u + d) / 2 d)
    whole = F.floor((F.abs(c) * up * 2 + down) / (down * 2))
    signed = F.when(c < 0, -whole).otherwise(whole)
    bad = F.raise_error(F.lit("timestamp out of range")).cast("long") if strict else F.lit(None).cast("long")
    start = F.lit(0) if origin is None else F.coalesce(F.col(origin) if isinstance(origin, str) else origin, F.lit(0))
    return F.when((F.abs(signed) <= _BOUND) & (F.abs(start) <= _BOUND), signed.cast("long") - start).when(c.isNotNull(), bad)


def origin(frames: DataFrame, key="rec", order="seq", container: str | None = None, stream: str | None = None) -> DataFrame:
    """(rec, origin): the container's start, else the earliest start of a stream, else the first usable timestamp less where that frame is expected, behind the samples before it."""
    before = F.coalesce(F.sum("n_samples").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    delay = F.coalesce("delay", F.lit(0)) if "delay" in frames.columns else F.lit(0)
    rows = frames.withColumn("__first", F.col("pts") - before - delay)
    first = F.min_by("__first", F.when(F.col("pts").isNotNull(), F.col(order)))
    starts = [*([F.min(container)] if container else []), *([F.min(stream)] if stream else [])]
    return rows.groupBy(key).agg(F.coalesce(*starts, first).cast("long").alias("origin"))


def last_frame_seconds(frames: DataFrame, key="rec", order="seq") -> DataFrame:
    """`frames` with last_frame_seconds, the duration of the last good frame before."""
    good = F.when((F.col("code") >= 0) & (F.col("n_samples") > 0), F.col("n_samples") / float(RATE))
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return frames.withColumn("last_frame_seconds", F.last(good, ignorenulls=True).over(w))


def packet_seconds(frames: DataFrame, key="rec", order="seq", packet="packet_seconds", codec: str | None = None) -> DataFrame:
    """`frames` with seconds: the packet's duration if positive, else the codec's, else that of the last good frame, else 0."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    known = [positive(packet), *([positive(codec)] if codec else [])]
    return last_frame_seconds(frames, key, order).withColumn("seconds", F.coalesce(*known, "last_frame_seconds", F.lit(0.0)))


def decode_error_totals(frames: DataFrame, key="rec", code="code") -> DataFrame:
    return frames.groupBy(key).agg(F.count_if(classify_code(code) == "recoverable").alias("errors"))


def place_frame(state: tuple | None, pts: int | None, n: int | None, delay: int | None, tolerance: int | None, transport: bool | None, gaps: str, strict=False) -> tuple[tuple | None, tuple]:
    """The state (end of the timeline or None, shift) after a frame, and the frame's (start, discontinuity, reset, end).

    Where the timestamp is close to the expected place, the frame goes there. An
    earlier one moves all that follows, so that no sample is lost; so does a later
    one behind a long gap of a transport stream. Any other gap is kept. A frame
    without samples has a place but does not move the end. One that is out of range
    has no place and changes nothing, or is an error if `strict`. Null stands for 0
    in all but pts.
    """
    n, delay, tolerance = n or 0, delay or 0, tolerance or 0
    end, shift = state or (None, 0)
    expected = (end or 0) + delay
    start = expected if pts is None else pts + shift
    if not -_BOUND <= start <= _BOUND or expected > _BOUND:
        if strict:
            raise ValueError("timestamp out of range")
        return state, (None, None, None, end or 0)
    reset = False
    if state is not None:  # the first timestamp is no jitter
        off, jitter = start - expected, max(JITTER, tolerance)
        reset = off < -jitter or (gaps == "auto" and bool(transport) and off > max(jitter, LONGEST_GAP))
        if reset:
            shift -= off
        if reset or off <= jitter:
            start = expected
    if n:
        end = start + n if end is None else max(end, start + n)
    return (end, shift), (start, reset or start != expected, reset, end or 0)


def aligned_type(frames: DataFrame, key="rec", order="seq") -> T.StructType:
    long, flag = T.LongType(), T.BooleanType()
    new = [("start", long), ("discontinuity", flag), ("reset", flag), ("timeline_end", long), ("n_samples", long)]
    return T.StructType([frames.schema[key], frames.schema[order], *(T.StructField(n, k) for n, k in new)])


def timeline_sums(rows: list[tuple], gaps: str) -> tuple:
    """A block of frames (rec, seq, pts, n, delay, tolerance, transport) as a function of the state before it.

    What a frame does depends on the lead alone, the end less the shift: it is snapped
    if its timestamp is near the lead, and else puts the lead where its own timestamp
    ends, whatever it was. So a block has a range of leads that are snapped all through
    and come out moved by a sum, and ranges that leave it at the same frame and all come
    out with the same lead. Returns, range by range, lowest and highest lead, whether the
    lead that comes out is fixed, it or by how much it moves, and what is added to the
    shift: `some`, and the lead itself where `by_lead` is 1. Last, the state behind the
    block where it is a recording's first.
    """
    low, high, moved = -_BOUND, _BOUND, 0
    fixed: dict[int, tuple[int, list[list[int]]]] = {}  # lead: what was added to the shift since, and (low, high, by_lead, some)
    begin: tuple | None = None
    begun = False

    def put(into: dict, lead: int, added: int, ranges: list) -> None:
        there = into.get(lead)
        if there is None:
            into[lead] = (added, ranges)
        else:
            there[1].extend([a, b, c, x + added - there[0]] for a, b, c, x in ranges)

    for row in rows:
        _, _, pts, n, delay, tolerance, transport = row
        n, delay, jitter = n or 0, delay or 0, max(JITTER, tolerance or 0)
        snapped = delay + n if n else 0
        if pts is None:
            fixed = {lead + snapped: x for lead, x in fixed.items()}
            moved += snapped
        else:
            far = max(jitter, LONGEST_GAP) if gaps == "auto" and transport else None
            then: dict[int, tuple[int, list[list[int]]]] = {}
            for lead, (added, ranges) in fixed.items():
                off = pts - delay - lead
                if off < -jitter or (far is not None and off > far):
                    put(then, pts + n if n else lead + off, added - off, ranges)
                elif off > jitter:
                    put(then, pts + n if n else lead, added, ranges)
                else:
                    put(then, lead + snapped, added, ranges)
            near = pts - delay - moved
            if low <= high and near + jitter < high:
                put(then, pts + n if n else pts - delay, 0, [[max(low, near + jitter + 1), high, 1, -near]])
                high = near + jitter
            if low <= high and far is not None and low < near - far:
                put(then, pts + n if n else pts - delay, 0, [[low, min(high, near - far - 1), 1, -near]])
                low = near - far
            if low <= high and n and low < near - jitter:
                put(then, pts + n, 0, [[low, min(high, near - jitter - 1), 0, 0]])
                low = near - jitter
            fixed = then
            moved += snapped
        if not begun:
            begin, _ = place_frame(begin, pts, n, delay, tolerance, transport, gaps)
            if begin is not None and begin[0] is not None:
                put(fixed, begin[0] - begin[1], 0, [[1, 0, 0, begin[1]]])
                begun = True
    out = [(a, b, True, lead, c, x + added) for lead, (added, ranges) in fixed.items() for a, b, c, x in ranges]
    first = next(((lead + shift, shift) for a, b, _, lead, _, shift in out if a > b), begin or (None, None))
    out = [r for r in out if r[0] <= r[1]] + ([(low, high, False, moved, 0, 0)] if low <= high else [])
    return (*map(list, zip(*out, strict=True)), *first)


def timeline_after(state: tuple | None, sums: tuple) -> tuple:
    """The state behind a block of timeline_sums."""
    low, high, fixed, value, by_lead, some, end, shift = sums
    if state is None:
        return end, shift
    before = (state[0] or 0) - state[1]
    for i in range(len(low)):
        if low[i] <= before <= high[i]:
            shift = state[1] + by_lead[i] * before + some[i]
            return shift + (value[i] if fixed[i] else before + value[i]), shift
    raise ValueError("timestamp out of range")


_LONG, _LONGS = T.LongType(), T.ArrayType(T.LongType())
STATE = T.StructType([T.StructField("end", _LONG), T.StructField("shift", _LONG)])
SUMS = T.StructType([T.StructField(n, k) for n, k in (("low", _LONGS), ("high", _LONGS), ("fixed", T.ArrayType(T.BooleanType())), ("value", _LONGS), ("by_lead", _LONGS), ("some", _LONGS), ("end", _LONG), ("shift", _LONG))])


def align_timeline(frames: DataFrame, gaps="auto", key="rec", order="seq", strict=False, bits=BITS) -> DataFrame:
    """(rec, seq, start, discontinuity, reset, timeline_end, n_samples) of each frame; gaps is auto or preserve. A timestamp out of range has no start, or is an error if `strict`.

    A recording of several blocks of 2 ** bits frames is placed in parallel, unless its
    timestamps could get out of range or it has negative lengths.
    """
    if gaps not in ("auto", "preserve"):
        raise ValueError("gaps is auto or preserve")

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        rec, seq, pts, n, delay, tolerance, transport = row
        state, placed = place_frame(state, pts, n, delay, tolerance, transport, gaps, strict)
        return state, [(rec, seq, *placed, n)]

    rows = frames.select(key, order, "pts", "n_samples", "delay", "tolerance", "transport")
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    reach = F.count("*") * (2 * F.max(F.abs(double("pts"))) + F.max(F.greatest(double("tolerance"), F.lit(float(LONGEST_GAP))))) + 2 * F.sum(double("n_samples") + double("delay"))
    able = (F.min(double("n_samples")) >= 0) & (F.min(double("delay")) >= 0) & (reach < float(_BOUND // 4))
    return block_scan(rows, key, order, lambda: None, step, aligned_type(frames, key, order), STATE, lambda block: timeline_sums(block, gaps), SUMS, timeline_after, able, bits)


def silence_fill(aligned: DataFrame, key="rec", order="seq") -> DataFrame:
    """`aligned` with silence, the zero samples to insert before a frame, and drop, its samples that overlap or lie before the origin."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    end = F.greatest(F.lit(0), F.coalesce(F.max(F.when(F.col("n_samples") > 0, F.col("start") + F.col("n_samples"))).over(w), F.lit(0)))
    out = aligned.withColumn("__end", end)
    silence = F.greatest(F.lit(0), F.col("start") - F.col("__end"))
    drop = F.when(F.col("start") < F.col("__end"), F.least(F.col("__end") - F.col("start"), F.col("n_samples"))).otherwise(0)
    return out.withColumn("silence", silence.cast("long")).withColumn("drop", drop.cast("long")).drop("__end")


#: What an event is to decode_budget; an error is a recoverable one.
AWAIT, PACKET, FRAME, ERROR = 1, 2, 3, 4


def decode_budget(events: DataFrame, strict=False, limit_s=30, key="rec", order="seq") -> DataFrame:
    """(rec, seq, reason) of the first failing event of each recording. events: kind (packet, frame, error or await), seconds, code.

    strict: the first recoverable error. time: input of at least limit_s seconds since
    the last good frame with an error in it, seen at an error or when input is awaited.
    stalled: too many errors without a packet or frame. A limit of 0 has no time rule.
    """
    if limit_s < 0:
        raise ValueError("a negative limit")
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    error = (F.col("kind") == "error") & (classify_code("code") == "recoverable")
    # one small number for what an event is: all events are dealt and sorted, once, and again for the time rule only
    what = F.when(error, ERROR).when(F.col("kind") == "frame", FRAME).when(F.col("kind") == "packet", PACKET).when(F.col("kind") == "await", AWAIT).otherwise(0).cast("byte")
    rows = events.select(key, order, what.alias("what"), *(["seconds"] if limit_s else []))
    is_error, is_frame = F.col("what") == ERROR, F.col("what") == FRAME
    rows = rows.withColumn("errors", F.count_if(is_error).over(w))
    # errors so far only grow, so their most at any move or frame is that at the last one
    before = lambda c: F.coalesce(F.max(F.when(c, F.col("errors"))).over(w), F.lit(0))
    rows = rows.withColumn("stuck", F.col("errors") - before(F.col("what").isin(FRAME, PACKET))).withColumn("error", is_error)
    if limit_s:
        rows = rows.withColumn("damaged", F.col("errors") > before(is_frame)).withColumn("frames", F.count_if(is_frame).over(w))
        good = ~F.isnan("seconds") & (F.col("seconds") > 0) & (F.col("seconds") < float("inf"))
        since = W.partitionBy(key, "frames").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("spent", F.coalesce(F.sum(F.when((F.col("what") == PACKET) & good, F.col("seconds"))).over(since), F.lit(0.0)))
        late = F.col("damaged") & (F.col("spent") >= limit_s) & (F.col("error") | (F.col("what") == AWAIT))
    else:
        late = F.lit(False)
    reason = F.when(F.lit(strict) & F.col("error"), "strict").when(F.col("error") & (F.col("stuck") >= STALLED), "stalled").when(late, "time")
    failing = rows.withColumn("reason", reason).filter("reason is not null")
    return failing.groupBy(key).agg(F.min(order).alias(order), F.min_by("reason", order).alias("reason"))


def frame_events(frames: DataFrame, key="rec", order="seq") -> DataFrame:
    """Frames as decoder events, three to a frame in order: input is awaited, the packet, and what became of it."""
    rows = packet_seconds(frames, key, order)
    kinds = F.array(*(F.struct(F.lit(i).alias("i"), k.alias("kind")) for i, k in enumerate((F.lit("await"), F.lit("packet"), F.when(F.col("code") < 0, "error").otherwise("frame")))))
    rows = rows.select(key, order, "seconds", "code", F.explode(kinds).alias("e"))
    return rows.select(key, (F.col(order) * 3 + F.col("e.i")).cast("long").alias(order), F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "packet", F.col("seconds")).alias("seconds"), F.when(F.col("e.kind") == "error", F.col("code")).otherwise(0).alias("code"))
