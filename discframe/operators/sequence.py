"""Ordered-list operators: offsets, islands, runs, pairing, clocks, cues and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.operators import ordered as o
from discframe.operators.fold import fold

MARK_GAP_SECONDS = 1.0
CLOCK_HZ = 45_000
TICKS_PER_SECOND = 90_000


def with_offsets(df: DataFrame, key: str | list[str], order: str, measure: str, name: str = "offset") -> DataFrame:
    """Start of each item: the sum of the measures before it."""
    return o.ordered(df, key, [order], **{name: o.sum_before(measure)})


def islands(df: DataFrame, key: list[str], order: list[str], starts: Column, name: str, **previous: o.Fn) -> DataFrame:
    """Number runs of rows; *starts* opens a run and may read the *previous* columns."""
    seen = o.ordered(df, key, order, **previous)
    flagged = seen.withColumn("_start", starts.cast("long"))
    return o.ordered(flagged, key, order, **{name: o.sum_to("_start")}).drop("_start", *previous)


def keep_spaced(df: DataFrame, key: str, value: str, gap: float = MARK_GAP_SECONDS) -> DataFrame:
    """Greedy thinning along sorted *value*: a row stays when *gap* past the last kept.

    The last *kept* value decides, so this is a fold and not a ``lag``.
    """

    def step(state, current):
        if state is None or current - state[0] >= gap:
            return (current,), (True,)
        return state, (False,)

    folded = fold(df, key, [value], [value], step, [("_kept", T.BooleanType())])
    return folded.filter("_kept").drop("_kept")


def absolute_marks(marks: DataFrame, items: DataFrame, clock: int = CLOCK_HZ, gap: float = MARK_GAP_SECONDS) -> DataFrame:
    """Title-timeline chapter starts from marks given on their item's clip clock.

    Marks: ``title_id, item, mark_time``; items: ``title_id, pos, duration, in_ts``.
    Marks of unknown items are absolute already.  Near-duplicates go and the first
    chapter moves to 0.
    """
    placed = with_offsets(items, "title_id", "pos", "duration").select(
        "title_id", F.col("pos").alias("item"), "offset", "in_ts"
    )
    inside = F.greatest(F.lit(0.0), (F.col("mark_time") - F.col("in_ts")) / clock)
    absolute = F.coalesce(F.col("offset") + inside, F.col("mark_time") / clock)
    timed = marks.join(placed, ["title_id", "item"], "left").select("title_id", absolute.alias("t"))
    kept = keep_spaced(timed, "title_id", "t", gap)
    based = o.with_group(kept, "title_id", _first=F.min("t"))
    moved = based.select("title_id", (F.col("t") - F.col("_first")).alias("t"))
    numbered = o.ordered(moved, "title_id", ["t"], _rn=o.row_number())
    return numbered.withColumn("mark_idx", F.col("_rn") - 1).drop("_rn")


def strip_end_mark(marks: DataFrame, limit: Column, key: str = "title_id") -> DataFrame:
    """Drop each title's last mark when it sits at or past *limit*."""
    last = o.with_group(marks, key, _last=F.max("mark_idx"))
    return last.filter(~((F.col("mark_idx") == F.col("_last")) & (F.col("t") >= limit))).drop("_last")


def merge_contiguous(items: DataFrame, same: list[str], slack: int = 1, key: str = "title_id") -> DataFrame:
    """Join neighbouring items that continue each other (same *same* columns, touching)."""
    previous = {f"_p{i}": o.lag(c) for i, c in enumerate(same)}
    continues = F.abs(F.col("in_ts") - F.col("_out")) <= slack
    for i, c in enumerate(same):
        continues = continues & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    opens = ~F.coalesce(continues, F.lit(False))
    marked = islands(items, [key], ["pos"], opens, "run", _out=o.lag("out_ts"), **previous)
    return marked.groupBy(key, "run").agg(
        F.min("pos").alias("pos"),
        *[F.min_by(c, "pos").alias(c) for c in same],
        F.min_by("in_ts", "pos").alias("in_ts"),
        F.max_by("out_ts", "pos").alias("out_ts"),
        F.sum("duration").alias("duration"),
        F.count(F.lit(1)).alias("n_merged"),
    )


def merge_runs(extents: DataFrame, key: str = "file_id") -> DataFrame:
    """Coalesce adjacent extents (or neighbouring sparse ones); empty ones vanish."""
    real = extents.filter(F.col("length") > 0)
    previous = dict(_off=o.lag("offset"), _len=o.lag("length"))
    touching = F.col("_off") + F.col("_len") == F.col("offset")
    sparse = F.col("_len").isNotNull() & F.col("_off").isNull() & F.col("offset").isNull()
    opens = ~(F.coalesce(touching, F.lit(False)) | sparse)
    marked = islands(real, [key], ["seq"], opens, "run", **previous)
    return marked.groupBy(key, "run").agg(
        F.min("offset").alias("offset"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_merged")
    )


def index_runs(df: DataFrame, key: str, index: str) -> DataFrame:
    """Ranges of consecutive indices per key."""
    distinct = df.select(key, index).distinct()
    ranked = o.ordered(distinct, key, [index], _rn=o.row_number())
    return (
        ranked.groupBy(key, (F.col(index) - F.col("_rn")).alias("_island"))
        .agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"))
        .drop("_island")
    )


def trim_to_total(extents: DataFrame, size: Column, key: str = "file_id") -> DataFrame:
    """Cut each file's extents to *size*; ``short`` flags files whose extents fall short."""
    run = o.ordered(extents, key, ["seq"], _before=o.sum_before("length"))
    sized = o.with_group(run, key, _have=F.sum("length")).withColumn("_size", size)
    left = F.least(F.col("length"), F.col("_size") - F.col("_before"))
    cut = sized.withColumn("length", left).withColumn("short", F.col("_have") < F.col("_size"))
    return cut.filter(F.col("_before") < F.col("_size")).drop("_before", "_have", "_size")


def backward_jumps(cells: DataFrame, key: str = "chain_id") -> DataFrame:
    seen = o.ordered(cells, key, ["pos"], _prev=o.lag("first_sector"))
    return seen.groupBy(key).agg(F.count_if(F.col("first_sector") < F.col("_prev")).alias("backward_jumps"))


def pick_from_block(cells: DataFrame, pick: Column | int, key: str = "chain_id") -> DataFrame:
    """Played cells of one angle: plain cells, and of each block cell *pick* or its first.

    Cells without sectors are skipped.  A block opens at mode 1, or at a block cell that
    follows a plain cell or a closing one.
    """
    real = cells.filter(~((F.col("first_sector") == 0) & (F.col("last_sector") == 0)))
    mode = F.col("block_mode")
    opens = (mode <= 1) | F.coalesce(F.col("_mode").isin(0, 3), F.lit(True))
    blocks = islands(real, [key], ["pos"], opens, "_block", _mode=o.lag("block_mode"))
    ranked = o.ordered(blocks, [key, "_block"], ["pos"], _rn=o.row_number())
    sized = o.with_group(ranked, [key, "_block"], _n=F.count(F.lit(1)))
    wanted = F.lit(pick) if isinstance(pick, int) else pick
    chosen = F.when(wanted < F.col("_n"), wanted).otherwise(0)
    return sized.filter((mode == 0) | (F.col("_rn") - 1 == chosen)).drop("_block", "_rn", "_n")


def program_chapters(programs: DataFrame, cells: DataFrame, minimum: float = 10.0, key: str = "chain_id") -> DataFrame:
    """Chapter start and length per program; trailing menu programs are cut.

    Programs: ``chain_id, program, entry`` (entry = first cell position); a program runs
    to the cell before the next entry.  Cells: ``chain_id, pos, duration``.
    """
    kind = F.struct("program", "entry")
    starts = programs.select(
        key, F.col("entry").alias("pos"), F.lit(0).alias("_kind"), kind.alias("_p"), F.lit(None).cast("double").alias("duration")
    )
    plays = cells.select(
        key, "pos", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_p"].dataType).alias("_p"), "duration"
    )
    filled = o.ordered(starts.unionByName(plays), key, ["pos", "_kind"], _own=o.last_to("_p"))
    per_program = (
        filled.filter((F.col("_kind") == 1) & F.col("_own").isNotNull())
        .groupBy(key, F.col("_own.program").alias("program"))
        .agg(F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("n_cells"))
    )
    from discframe.operators.project import trim_tail

    started = with_offsets(per_program, key, "program", "duration", "start")
    return trim_tail(started, key, "program", "duration", minimum)


def pair_fields(frames: DataFrame, key: str = "stream_id") -> DataFrame:
    """Merge neighbouring opposite single fields into one frame, first with second.

    Inside a run of single fields with alternating order, rows 0+1, 2+3, ... pair up.
    """
    order_changed = ~F.col("top_field_first").eqNullSafe(F.col("_tff"))
    joins = F.col("single_field") & F.coalesce(F.col("_single"), F.lit(False)) & order_changed
    runs = islands(
        frames, [key], ["seq"], ~joins, "_run", _tff=o.lag("top_field_first"), _single=o.lag("single_field")
    )
    ranked = o.ordered(runs, [key, "_run"], ["seq"], _rn=o.row_number(), _next=o.lead("seq"))
    second = F.col("_rn") % 2 == 0
    paired = F.col("single_field") & F.col("_next").isNotNull()
    return (
        ranked.filter(~second)
        .withColumn("interlaced", F.col("interlaced") | paired)
        .withColumn("single_field", F.col("single_field") & ~paired)
        .drop("_run", "_rn", "_next")
    )


def presentation_order(frames: DataFrame, shown_at_once: str, key: str = "stream_id") -> DataFrame:
    """Display order: B frames at once, the others when the next of their kind arrives."""
    held = F.when(~F.col(shown_at_once), F.col("seq"))
    seen = o.ordered(frames, key, ["seq"], _held=o.next_after(held))
    ended = o.with_group(seen, key, _end=F.max("seq"))
    slot = F.when(F.col(shown_at_once), F.col("seq")).otherwise(F.coalesce("_held", F.col("_end") + 1))
    ranked = o.ordered(ended.withColumn("_slot", slot), key, ["_slot"], _rn=o.row_number())
    return ranked.withColumn("shown", F.col("_rn") - 1).drop("_held", "_end", "_slot", "_rn")


def cadence_times(
    frames: DataFrame, tick: float, tolerance: float = 90, key: str = "stream_id", order: str = "seq"
) -> DataFrame:
    """Frame clock: the last stamp plus the fields shown since; ``miss`` = stamp off it.

    ``pts`` is NULL on unstamped frames; times count from the stream's first stamp.
    """
    first = o.with_group(frames, key, _first=F.min_by("pts", F.when(F.col("pts").isNotNull(), F.col(order))))
    fields = o.ordered(first, key, [order], _fields=o.sum_before("fields"), _n=o.row_number())
    stamp = F.when(
        F.col("pts").isNotNull(),
        F.struct(F.pmod(F.col("pts") - F.col("_first"), F.lit(2**33)).alias("at"), F.col("_fields").alias("since")),
    )
    seen = o.ordered(fields, key, [order], _now=o.last_to(stamp), _was=o.last_before(stamp))

    def clock(anchor: str) -> Column:
        at = F.coalesce(F.col(f"{anchor}.at"), F.lit(0))
        since = F.coalesce(F.col(f"{anchor}.since"), F.lit(0))
        return at + (F.col("_fields") - since) * F.lit(tick)

    checked = F.col("pts").isNotNull() & (F.col("_n") > 1)
    return seen.withColumns(
        {
            "time": clock("_now"),
            "checked": checked,
            "miss": checked & (F.abs(F.col("_now.at") - clock("_was")) > tolerance),
        }
    ).drop("_first", "_fields", "_n", "_now", "_was")


def retime_duplicates(ticks: DataFrame, key: str = "stream_id", order: str = "seq", value: str = "pts") -> DataFrame:
    """Move a tick equal to its successor one mean step before it, if that stays ordered."""
    rank = o.ordered(ticks, key, [order], _prev=o.lag(value), _next=o.lead(value), _rn=o.row_number())
    sized = o.with_group(
        rank,
        key,
        _n=F.count(F.lit(1)),
        _last=F.max_by(value, order),
        _second=F.max(F.when(F.col("_rn") == 2, F.col(value))),
    )
    step = (F.col("_last") - F.col("_second")) / F.nullif(F.col("_n") - 2, F.lit(0))
    earlier = F.bround(F.col("_next") - step).cast("long")
    moves = (
        (F.col("_n") >= 3)
        & (F.col("_last") > F.col("_second"))
        & F.col("_prev").isNotNull()
        & (F.col(value) == F.col("_next"))
        & (earlier > F.col("_prev"))
    )
    moved = F.coalesce(moves, F.lit(False))
    return sized.withColumn("retimed", F.when(moved, earlier).otherwise(F.col(value))).drop(
        "_prev", "_next", "_rn", "_n", "_last", "_second"
    )


def caption_cues(snapshots: DataFrame, content: str, shown: Column, key: str = "stream_id", last_ticks: int = 5 * TICKS_PER_SECOND) -> DataFrame:
    """Display cues from snapshots: start, end at the next differing one, text.

    Repeats collapse, snapshots where *shown* is false only end a cue, and the last
    cue gets *last_ticks*.
    """
    previous = o.ordered(snapshots, key, ["seq"], _prev=o.lag(content), _rn=o.row_number())
    changed = previous.filter((F.col("_rn") == 1) | ~F.col(content).eqNullSafe(F.col("_prev")))
    ended = o.ordered(changed, key, ["seq"], _end=o.lead("pts"))
    cues = ended.filter(shown).select(
        key, "seq", F.col("pts").alias("start"), F.coalesce("_end", F.col("pts") + last_ticks).alias("end"), content
    )
    numbered = o.ordered(cues, key, ["seq"], cue=o.row_number())
    return numbered


def ordered_union(lists: DataFrame, group: str, list_index: str, pos: str, item: str, payload: list[str]) -> DataFrame:
    """Union of ordered lists by first appearance; the first occurrence's payload wins."""
    first = F.min_by(F.struct(list_index, pos, *payload), F.struct(list_index, pos)).alias("_f")
    union = lists.groupBy(group, item).agg(first).select(group, item, "_f.*")
    ranked = o.ordered(union, group, [list_index, pos], block_on=[list_index, pos], _rn=o.row_number())
    return ranked.withColumn("out_idx", F.col("_rn") - 1).drop("_rn")


def union_streams(streams: DataFrame, group: str, list_index: str, signature: list[str], ident: list[str]) -> DataFrame:
    """Tracks of several lists in first-appearance order, one per id.

    A track with an id is kept when the id is new (its signature contains the id, so
    the signature cannot be known before the id is); one without an id when its
    signature is new.
    """
    from discframe.operators.aggregate import _text

    has_id = F.coalesce(*[F.col(c).cast("string") for c in ident]).isNotNull()
    as_id = F.concat_ws("|", F.lit("id"), *[_text(c) for c in ident])
    as_signature = F.concat_ws("|", F.lit("sig"), *[_text(c) for c in signature])
    keyed = streams.withColumn("_key", F.when(has_id, as_id).otherwise(as_signature))
    payload = [c for c in streams.columns if c not in (group, list_index, "pos")]
    union = ordered_union(keyed, group, list_index, "pos", "_key", payload).drop("_key")
    ranked = o.ordered(union, [group, "type"], ["out_idx"], _rn=o.row_number())
    return ranked.withColumn("type_index", F.col("_rn") - 1).drop("_rn")


def all_disjoint(df: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """Per group: are the members' item sets pairwise disjoint?

    A set of members is disjoint exactly when no item belongs to two of them.
    """
    per_item = df.select(group, member, item).distinct().groupBy(group, item).agg(F.count(F.lit(1)).alias("_n"))
    return per_item.groupBy(group).agg((F.max("_n") == 1).alias("disjoint"), F.sum("_n").alias("n_items"))


def covers(parts: DataFrame, wanted: DataFrame, group: str, item: str) -> DataFrame:
    """Per group: parts within the wanted set, and parts exactly equal to it."""
    have = parts.select(group, item).distinct().withColumn("_have", F.lit(1))
    want = wanted.select(group, item).distinct().withColumn("_want", F.lit(1))
    both = have.join(want, [group, item], "full")
    return both.groupBy(group).agg(
        F.bool_and(F.col("_want").isNotNull()).alias("subset"),
        F.bool_and(F.col("_want").isNotNull() & F.col("_have").isNotNull()).alias("equal"),
    )


def without(rows: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose *on* key is in none of *others*."""
    for other in others:
        rows = rows.join(other.select(*on).distinct(), on, "left_anti")
    return rows


def number_episodes(titles: DataFrame, group: str, order: list[str]) -> DataFrame:
    """1-based episode numbers and their text, padded to the group's highest."""
    numbered = o.ordered(titles, group, order, episode=o.row_number())
    sized = o.with_group(numbered, group, _top=F.max("episode"))
    width = F.length(F.greatest(F.col("_top"), F.lit(1)).cast("string"))
    return sized.withColumn("number", F.lpad(F.col("episode").cast("string"), width, "0")).drop("_top")


def reindex(titles: DataFrame, group: str, keys: list[Column]) -> DataFrame:
    """Listing order: *keys* ascending, then the old index; ``new_idx`` from 0."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    placed = titles.withColumns(named)
    ranked = o.ordered(placed, group, [*named, "title_idx"], block_on=[*named, "title_idx"], _rn=o.row_number())
    return ranked.withColumn("new_idx", F.col("_rn") - 1).drop("_rn", *named)


def listing_keys(notable: Column) -> list[Column]:
    """Sort keys of the title list: listed first, then episodes, others, play-all.

    Source order is disc position where one is known, longest first elsewhere.
    """
    group = F.when(F.col("play_all"), 2).when(F.col("episode").isNotNull(), 0).otherwise(1)
    known = F.col("source_pos").isNotNull()
    return [
        F.when(notable, 0).otherwise(1),
        group,
        F.coalesce(F.col("episode"), F.lit(0)),
        F.coalesce(F.col("part"), F.lit("")),
        F.when(known, 0).otherwise(1),
        F.coalesce(F.col("source_pos"), F.lit(0)),
        -F.col("duration"),
    ]
