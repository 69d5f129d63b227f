"""Timeline operators: clock rebasing, ranges, trims, retiming and alignment."""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.operators import ordered as o
from discframe.operators.fold import Summary, fold
from discframe.operators.joins import asof_interval
from discframe.operators.sequence import islands, with_offsets

RESET_TICKS = 5 * 90_000
EDGE_JUNK_SHARE = 0.4
EPSILON = 1e-6
JUMP_MARGIN = 0.001
FRAME_TICKS = 3003
SECTOR = 2048


def rebase_step(tolerance: int):
    """Fold step of the clock rebaser: state = (offset, latest effective tick)."""

    def step(state, raw):
        offset, latest = state if state is not None else (0, None)
        effective = raw + offset
        if latest is not None and effective < latest - tolerance:
            offset = latest - raw
            effective = latest
        if latest is None or effective > latest:
            latest = effective
        return (offset, latest), (effective,)

    return step


def _relative_step(tolerance: int):
    """The same recurrence relative to the segment: state = raw maximum since the reset.

    A reset depends on ``raw`` and that maximum alone, so blocks of a long stream agree
    on their start state as soon as they share a reset or a maximum.
    """

    def step(state, raw):
        if state is None:
            return (raw,), (False,)
        if raw < state[0] - tolerance:
            return (raw,), (True,)
        return (max(state[0], raw),), (False,)

    return step


def rebase(
    ticks: DataFrame, key: str = "stream_id", order: str = "seq", value: str = "pts", tolerance: int = RESET_TICKS
) -> DataFrame:
    """Add ``effective``: ticks on one continuous timeline across clock resets.

    Only the choice of reset rows is a recurrence; it folds with a one-number state.
    Offsets follow from ordinary windows: at a reset the timeline continues from the
    previous segment's largest tick.
    """
    flagged = fold(ticks, key, [order], [value], _relative_step(tolerance), [("_reset", T.BooleanType())])
    segmented = o.ordered(
        flagged.withColumn("_step", F.col("_reset").cast("long")), key, [order], _segment=o.sum_to("_step")
    )
    per_segment = segmented.groupBy(key, "_segment").agg(
        F.max(value).alias("_top"), F.min_by(value, order).alias("_first")
    )
    spans = o.ordered(per_segment.withColumn("_rise", F.col("_top") - F.col("_first")), key, ["_segment"], _before=o.sum_before("_rise"))
    start = o.with_group(spans, key, _origin=F.min_by("_first", "_segment"))
    offsets = start.select(key, "_segment", (F.col("_origin") + F.col("_before") - F.col("_first")).alias("_offset"))
    joined = segmented.join(offsets, [key, "_segment"])
    return joined.withColumn("effective", F.col(value) + F.col("_offset")).withColumnRenamed("_segment", "segment").drop(
        "_reset", "_step", "_offset"
    )


def splice(units: DataFrame, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """Offsets that make each unit continue the one before; empty units are ignored.

    After the first unit every effective start is the previous effective end, so the
    offset is a running sum of lengths against the declared start.
    """
    real = units.filter(F.col("end") > F.col("start"))
    placed = o.ordered(
        real.withColumn("_len", F.col("end") - F.col("start")), key, [order], _before=o.sum_before("_len")
    )
    origin = o.with_group(placed, key, _origin=F.min_by("start", order))
    return origin.withColumn("offset", F.col("_origin") + F.col("_before") - F.col("start")).drop(
        "_len", "_before", "_origin"
    )


def content_range(
    ticks: DataFrame,
    complete: Column,
    tolerance: int = RESET_TICKS,
    junk: float = EDGE_JUNK_SHARE,
    key: str = "stream_id",
) -> DataFrame:
    """First and end row of the main content per stream, where trimming is justified.

    Drops against the previous tick cut segments; short ones at either edge go (the
    trailing edge only on a *complete* scan) unless that would drop half the runtime.
    ``end_seq`` is the first dropped row, NULL when content runs to the end.
    """
    drop = F.coalesce(F.col("pts") < F.col("_prev") - tolerance, F.lit(True))
    cut = islands(ticks, [key], ["seq"], drop, "_segment", _prev=o.lag("pts"))
    segments = cut.groupBy(key, "_segment").agg(
        F.min("seq").alias("_from"),
        (F.max_by("pts", "seq") - F.min_by("pts", "seq")).alias("_span"),
        F.bool_and(complete).alias("_complete"),
    )
    sized = o.with_group(segments, key, _longest=F.max("_span"), _total=F.sum("_span"), _last=F.max("_segment"))
    big = F.col("_span") > F.col("_longest") * junk
    edges = o.with_group(
        sized,
        key,
        _lo=F.min(F.when(big, F.col("_segment"))),
        _hi=F.max(F.when(big, F.col("_segment"))),
        _whole=F.bool_and("_complete"),
    ).withColumn("_hi", F.when(F.col("_whole"), F.col("_hi")).otherwise(F.col("_last")))
    kept = F.col("_segment").between(F.col("_lo"), F.col("_hi"))
    summary = edges.groupBy(key).agg(
        F.count(F.lit(1)).alias("segments"),
        F.min(F.when(kept, F.col("_from"))).alias("start_seq"),
        F.min(F.when(F.col("_segment") > F.col("_hi"), F.col("_from"))).alias("end_seq"),
        F.sum(F.when(kept, F.col("_span"))).alias("kept"),
        F.max("_total").alias("total"),
        F.min("_lo").alias("_lo"),
        F.min("_segment").alias("_first"),
    )
    trims = (F.col("_lo") > F.col("_first")) | F.col("end_seq").isNotNull()
    return summary.filter((F.col("total") > 0) & trims & (F.col("kept") >= F.col("total") * 0.5)).drop("_lo", "_first")


def join_drift_step(half_frame_slack: float):
    """Fold step over a track's clip joins: state = (drift, dead).

    Reads one clip's video end, frame duration and frame ends as ``[(pts, offset)]``
    and decides how many trailing frames to drop.
    """

    def step(state, video_end, frame, pts, offsets):
        drift, dead = state if state is not None else (0, False)
        if dead or video_end is None or not pts:
            return (drift, True), (None, None, None, True)
        ends = sorted(pts)
        keep = len(ends)
        while keep > 1:
            now = drift + ends[keep - 1] + frame - video_end
            shorter = drift + ends[keep - 2] + frame - video_end
            if abs(shorter) >= abs(now):
                break
            keep -= 1
        cut = None
        if keep < len(ends):
            cut = min(off for p, off in zip(pts, offsets) if p >= ends[keep])
        drift += ends[keep - 1] + frame - video_end
        dead = abs(drift) > frame / 2 + half_frame_slack
        return (drift, dead), (drift, cut, len(ends) - keep, dead)

    return step


def join_drift_summary(half_frame_slack: float) -> type[Summary]:
    """How a run of clip joins moves any drift that enters it.

    One join adds a constant to the drift, another one in each of a few ranges: frames are
    dropped while that brings it nearer to zero.  So does a run of joins: pieces ``(low, high,
    add, dead)`` over the incoming drift.  Behind a join the living drifts are no more than
    those of half a frame and the slack, which bounds the pieces.
    """
    far = 1 << 60

    class JoinDrift(Summary):
        def __init__(self):
            self.pieces = [(-far, far, 0, False)]

        def extend(self, video_end, frame, pts, offsets):
            if video_end is None or not pts:
                self.pieces = [(low, high, add, True) for low, high, add, _ in self.pieces]
                return
            ends = sorted(pts, reverse=True)
            moves = [e + frame - video_end for e in ends]
            # From the first repeated end on nothing is dropped.
            last = next((i for i in range(len(ends) - 1) if ends[i] == ends[i + 1]), len(ends) - 1)
            # The i-th frame goes where the drift is above this, twice.
            above = [-(moves[i] + moves[i + 1]) for i in range(last)]
            limit = math.floor(frame / 2 + half_frame_slack)
            out: list[tuple[int, int, int, bool]] = []

            def put(low, high, add, dead):
                if low > high:
                    return
                if out and out[-1][2:] == (add, dead) and out[-1][1] + 1 == low:
                    out[-1] = (out[-1][0], high, add, dead)
                else:
                    out.append((low, high, add, dead))

            for low, high, add, dead in self.pieces:
                if dead:
                    put(low, high, add, True)
                    continue
                at = low
                for i in range(bisect_left(above, 2 * (low + add)), last + 1):
                    to = min(high, above[i] // 2 - add) if i < last else high
                    if at <= to:
                        moved = add + moves[i]
                        put(at, min(to, -limit - 1 - moved), moved, True)
                        put(max(at, -limit - moved), min(to, limit - moved), moved, False)
                        put(max(at, limit + 1 - moved), to, moved, True)
                        at = to + 1
                    if at > high:
                        break
            self.pieces = out

        def dumps(self):
            return json.dumps(self.pieces)

        @staticmethod
        def leave(text, state):
            drift, dead = state if state is not None else (0, False)
            if dead:
                return drift, True
            pieces = json.loads(text)
            _, _, add, dead = pieces[bisect_right(pieces, drift, key=lambda p: p[0]) - 1]
            return drift + add, dead

    return JoinDrift


def seamless_trim(tails: DataFrame, tolerance: float = 0.010, key: str = "track") -> DataFrame:
    """Cut offset per clip join that keeps a track locked to the video.

    Tails: ``track, clip, video_end, frame, pts array, offsets array`` - the last frames
    of the track in one clip (a bounded window by definition).  The last clip has no
    join.  ``failed`` marks every join from the first one that cannot be kept.
    """
    seen = o.ordered(tails, key, ["clip"], _next=o.lead("clip"))
    joins = seen.filter(F.col("_next").isNotNull()).drop("_next")
    outputs = [
        ("drift", T.LongType()),
        ("cut_offset", T.LongType()),
        ("dropped", T.LongType()),
        ("failed", T.BooleanType()),
    ]
    slack = tolerance * 90_000
    return fold(
        joins,
        key,
        ["clip"],
        ["video_end", "frame", "pts", "offsets"],
        join_drift_step(slack),
        outputs,
        summary=join_drift_summary(slack),
    )


def append_bounds(items: DataFrame, kept: str, key: str = "title_id") -> DataFrame:
    """Real start and end of every planned clip from the kept clips' measured starts.

    Items: ``title_id, pos, <kept> boolean, start`` (measured, NULL when dropped),
    ``total_end``.  A kept clip ends where the next kept one starts; a dropped one is
    empty at that point.
    """
    known = F.when(F.col(kept), F.col("start"))
    nexts = o.ordered(items, key, ["pos"], _next=o.next_after(known))
    end = F.coalesce("_next", "total_end")
    return nexts.withColumns(
        {"real_start": F.when(F.col(kept), F.col("start")).otherwise(end), "real_end": end}
    ).drop("_next")


def retime(atoms: DataFrame, clips: DataFrame, key: str = "title_id") -> DataFrame:
    """Move atoms from the planned clip timeline onto measured clip bounds.

    Atoms: ``title_id, edition, atom_idx, start, end, hidden, name``; clips: ``title_id,
    pos, duration, real_start, real_end``.  Empty atoms go; a dropped visible atom hands
    its name to the next kept hidden one unless a kept visible one comes first.
    """
    planned = with_offsets(clips, key, "pos", "duration", "p_start")
    payload = ["p_start", "duration", "real_start", "real_end"]
    placed = asof_interval(atoms, planned, key, "start", "p_start", payload, EPSILON)
    length = F.col("real_end") - F.col("real_start")
    start = F.col("real_start") + F.least(F.greatest(F.col("start") - F.col("p_start"), F.lit(0.0)), length)
    at_end = F.col("end") >= F.col("p_start") + F.col("duration") - EPSILON
    end = F.when(at_end, F.col("real_end")).otherwise(
        F.col("real_start") + F.least(F.col("end") - F.col("p_start"), length)
    )
    moved = placed.withColumns({"start": start, "end": end}).withColumn(
        "_kept", F.col("end") - F.col("start") > EPSILON
    )
    # After any kept atom no name is pending, so a dropped visible atom concerns only the
    # next kept one: both have the same number of kept atoms before them.
    unit = [key, "edition"]
    runs = o.ordered(moved.withColumn("_one", F.col("_kept").cast("long")), unit, ["atom_idx"], _run=o.sum_before("_one"))
    names = (
        runs.filter(~F.col("_kept") & ~F.col("hidden"))
        .groupBy(*unit, "_run")
        .agg(F.min_by("name", "atom_idx").alias("_pending"), F.lit(True).alias("_offered"))
    )
    takes = F.col("hidden") & F.coalesce("_offered", F.lit(False))
    joined = runs.filter("_kept").join(names, [*unit, "_run"], "left").withColumn("_takes", takes)
    return joined.withColumns(
        {
            "name": F.when(F.col("_takes"), F.col("_pending")).otherwise(F.col("name")),
            "hidden": F.col("hidden") & ~F.col("_takes"),
        }
    ).select(*atoms.columns)


def pull_back(atoms: DataFrame, file_end: Column, unit: list[str]) -> DataFrame:
    """End an atom 1 ms early before a jump; the last one only when it ends before the file."""
    seen = o.ordered(atoms, unit, ["atom_idx"], _next=o.lead("start"))
    contiguous = F.coalesce(F.abs(F.col("_next") - F.col("end")) <= EPSILON, F.lit(False))
    at_end = F.col("_next").isNull() & (F.col("end") >= file_end - EPSILON)
    pulls = ~contiguous & ~at_end & (F.col("end") - F.col("start") > 2 * JUMP_MARGIN)
    return seen.withColumn("end", F.when(pulls, F.col("end") - JUMP_MARGIN).otherwise(F.col("end"))).drop("_next")


def trim_plan(
    items: DataFrame, windows: DataFrame, marks: DataFrame, key: str = "title_id"
) -> tuple[DataFrame, DataFrame]:
    """Source ranges to keep and chapters on the output, for partly played clips.

    Items: ``title_id, pos, span_start, span_end, span_length, dropped``; windows:
    ``title_id, win_start, win_end``; marks: ``title_id, mark_idx, t``.  Played parts
    advance the title clock even when dropped; whole lengths of kept items advance the
    appended clock.  Neighbouring ranges that touch merge.
    """
    kept = ~F.col("dropped")
    timed = items.withColumns(
        {
            "_len": F.col("span_end") - F.col("span_start"),
            "_whole": F.when(kept, F.col("span_length")).otherwise(0.0),
        }
    )
    clocks = o.ordered(timed, key, ["pos"], _title=o.sum_before("_len"), _appended=o.sum_before("_whole"))
    cut = clocks.join(windows, key)
    begin = F.greatest("win_start", "_title")
    end = F.least(F.col("win_end"), F.col("_title") + F.col("_len"))
    parts = (
        cut.filter(kept)
        .withColumns({"begin": begin, "end": end})
        .filter(F.col("end") > F.col("begin"))
        .withColumns(
            {
                "_source": F.col("_appended") + F.col("span_start") - F.col("_title"),
                "_out_len": F.col("end") - F.col("begin"),
            }
        )
    )
    placed = o.ordered(parts, key, ["pos"], out_start=o.sum_before("_out_len")).select(
        key, "pos", "begin", "end", "out_start",
        (F.col("_source") + F.col("begin")).alias("src_start"), (F.col("_source") + F.col("end")).alias("src_end"),
    )
    touches = F.coalesce(F.abs(F.col("_prev") - F.col("src_start")) < EPSILON, F.lit(False))
    runs = islands(placed, [key], ["pos"], ~touches, "range_no", _prev=o.lag("src_end"))
    ranges = runs.groupBy(key, "range_no").agg(F.min("src_start").alias("start"), F.max("src_end").alias("end"))

    spans = placed.select(key, F.col("pos"), "begin", F.col("end").alias("p_end"), "out_start")
    hit = asof_interval(marks, spans, key, "t", "begin", ["p_end", "out_start"]).filter(F.col("t") < F.col("p_end"))
    moved = hit.select(key, "mark_idx", (F.col("out_start") + F.col("t") - F.col("iv_start")).alias("t"))
    total = placed.groupBy(key).agg(F.max(F.col("out_start") + F.col("end") - F.col("begin")).alias("_output"))
    ended = o.with_group(moved.join(total, key), key, _last=F.max("mark_idx"))
    chapters = ended.filter(~((F.col("mark_idx") == F.col("_last")) & (F.col("t") >= F.col("_output") - 0.5)))
    return ranges, chapters.drop("_output", "_last")


def close_up(items: DataFrame, marks: DataFrame, key: str = "title_id") -> tuple[DataFrame, DataFrame]:
    """Kept clips and their chapters after dropping the others.

    Items: ``title_id, pos, begin, end, kept, seamless``.  A clip behind a dropped one
    no longer continues its clock; chapters move with their clip, each time once.
    """
    length = F.when(F.col("kept"), F.greatest(F.col("end") - F.col("begin"), F.lit(0.0))).otherwise(0.0)
    placed = o.ordered(
        items.withColumn("_len", length), key, ["pos"], new_begin=o.sum_before("_len"), _prev=o.lag("kept")
    )
    clips = placed.filter("kept").withColumn("seamless", F.col("seamless") & F.coalesce("_prev", F.lit(False)))
    real = placed.filter(F.col("end") > F.col("begin")).select(key, "begin", F.col("end").alias("c_end"), "kept", "new_begin")
    hit = asof_interval(marks, real, key, "t", "begin", ["c_end", "kept", "new_begin"])
    inside = hit.filter(F.col("kept") & (F.col("t") < F.col("c_end")))
    chapters = inside.select(key, (F.col("new_begin") + F.col("t") - F.col("iv_start")).alias("t")).distinct()
    return clips.drop("_len", "_prev"), chapters


def align_series(
    left: DataFrame, right: DataFrame, key: str, value: str, agree: float = 20.0, share: float = 0.8, max_anchor: float = 500.0
) -> DataFrame:
    """Offset between two sorted series of equal size per key, and whether to trust it.

    Values pair up by rank; the offset is the upper median of their differences.
    ``aligned`` needs equal counts, *share* of pairs within *agree* of the offset, and
    the first left value within *max_anchor* of it.
    """
    from discframe.operators.aggregate import exact_median

    a = o.ordered(left.select(key, F.col(value).alias("a")), key, ["a"], _i=o.row_number())
    b = o.ordered(right.select(key, F.col(value).alias("b")), key, ["b"], _i=o.row_number())
    pairs = a.join(b, [key, "_i"], "full").withColumn("d", F.col("a") - F.col("b"))
    medians = exact_median(pairs.filter(F.col("d").isNotNull()), [key], "d", interpolate=False)
    checked = pairs.join(medians.withColumnRenamed("median", "offset"), key)
    return (
        checked.groupBy(key, "offset")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_even"),
            F.count_if(F.abs(F.col("d") - F.col("offset")) <= agree).alias("agreeing"),
            F.min("a").alias("anchor"),
        )
        .withColumn(
            "aligned",
            F.col("_even")
            & (F.col("agreeing") >= F.col("n") * share)
            & (F.abs(F.col("offset") - F.col("anchor")) <= max_anchor),
        )
        .drop("_even")
    )


def interleave(files: DataFrame, extent: str, size: str, unit: str, gap: str, sector: int = SECTOR) -> DataFrame:
    """Byte runs of a file laid out as *unit* sectors with *gap* sectors between.

    Without a unit the file is one run.
    """
    chunk = F.col(unit).cast("long") * sector
    runs = F.when(F.col(unit) > 0, F.ceil(F.col(size) / chunk)).otherwise(1).cast("long")
    spread = files.filter((F.col(unit) == 0) | (F.col(size) > 0)).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1))
    )
    step = F.col("run") * (F.col(unit).cast("long") + F.col(gap))
    length = F.when(F.col(unit) > 0, F.least(chunk, F.col(size) - F.col("run") * chunk)).otherwise(F.col(size))
    return spread.withColumns({"offset": (F.col(extent) + step) * sector, "length": length})


def frame_times(groups: DataFrame, pts: str, leading: str, frames: Column, ticks: int = FRAME_TICKS) -> DataFrame:
    """One row per frame: group time, minus the leading frames, plus the frame's own ticks.

    *frames* is an array of frame numbers; groups without a time give 0.
    """
    spread = groups.withColumn("frame", F.explode(frames))
    at = F.col(pts).cast("long") - F.col(leading).cast("long") * ticks + F.col("frame").cast("long") * ticks
    return spread.withColumn("frame_pts", F.when(F.col(pts) != 0, at).otherwise(0))


def clip_spans(items: DataFrame, clock: int = 45_000, edge: float = 0.05, key: str = "title_id") -> DataFrame:
    """Played part of each clip in seconds, for titles where some clip plays in part.

    Items: ``in_ts, out_ts, clip_start, clip_end``.  A title with an unknown or
    impossible span, or with only whole clips, has no rows.
    """
    length = (F.col("clip_end") - F.col("clip_start")) / clock
    spans = items.withColumns(
        {
            "start": (F.col("in_ts") - F.col("clip_start")) / clock,
            "end": (F.col("out_ts") - F.col("clip_start")) / clock,
            "length": length,
        }
    )
    valid = (F.col("start") >= 0) & (F.col("end") <= F.col("length") + edge) & (F.col("end") > F.col("start"))
    partial = (F.col("start") > edge) | (F.col("end") < F.col("length") - edge)
    judged = o.with_group(
        spans, key, _valid=F.bool_and(F.coalesce(valid, F.lit(False))), _partial=F.bool_or(F.coalesce(partial, F.lit(False)))
    )
    return judged.filter(F.col("_valid") & F.col("_partial")).withColumn("end", F.least("end", "length")).drop(
        "_valid", "_partial"
    )


