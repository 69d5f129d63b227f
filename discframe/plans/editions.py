"""Duplicate playlists, edition groups, combined editions and exact tiling."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.operators import ordered as o
from discframe.operators import sequence as s
from discframe.operators.aggregate import layout_signature
from discframe.operators.fold import fold
from discframe.operators.joins import asof_interval, beside, micros
from discframe.session import cut_lineage, group_rows

EPSILON = 1e-6
SHARED_CLIPS = 3
#: Fractions: durations within a quarter of the longer, chains with a tenth of the shorter in common.
LENGTH_SHARE = (1, 4)
CHAIN_SHARE = (1, 10)
#: Checksums with positions are sums modulo this prime, so that they stay long integers.
PRIME = (1 << 31) - 1


def dedup_titles(titles: DataFrame, items: DataFrame) -> DataFrame:
    """One title per (clip sequence, half-even rounded duration) of a disc.

    Titles: ``disc_id, title_id, title_idx, duration, n_chapters, n_streams, n_tracks``.
    The richest title stays, the first one among equals; groups keep the order they were
    first seen in.  Sequences are compared by signature and the choice is one partial
    aggregate, so neither a long playlist nor thousands of copies meet in one task.
    """
    sequences = layout_signature(items, "title_id", ["pos"], ["clip_id"])
    keyed = titles.join(sequences, "title_id").withColumn("_seconds", F.bround("duration").cast("long"))
    rank = F.struct(-F.col("n_chapters"), -F.col("n_streams"), -F.col("n_tracks"), "title_idx")
    kept = keyed.groupBy("disc_id", "n", "sig_a", "sig_b", "_seconds").agg(
        F.min_by("title_id", rank).alias("title_id"),
        F.min("title_idx").alias("first_seen"),
        F.count(F.lit(1)).alias("copies"),
    )
    ranked = o.ordered(kept, "disc_id", ["first_seen"], _rn=o.row_number())
    return ranked.select("disc_id", "title_id", (F.col("_rn") - 1).alias("new_idx"), "copies")


def edition_candidates(titles: DataFrame) -> DataFrame:
    """Titles that can be an edition: more than one stream, and a playlist or a notable chain.

    Titles: ``n_streams``, ``playlist_no`` (null for chains), ``vts`` (null for playlists),
    ``notable``.  Playlists without items find no partner later.
    """
    chain = F.col("vts").isNotNull() & F.col("notable")
    return titles.filter((F.col("n_streams") > 1) & (F.col("playlist_no").isNotNull() | chain))


class GreedyHeads:
    """Heads of one disc so far; titles come in list order and find the first head that takes them.

    A title's clips come rare ones first.  Sets that share *k* clips share one of the first
    ``size - k + 1`` of each, so heads stand under these alone, in lists sorted by duration:
    a title searches the lists of its own first clips within the durations that can match.
    """

    def __init__(self, k: int, within: tuple[int, int], share: tuple[int, int]):
        self.k, self.within, self.share = k, within, share
        self.heads: list[tuple] = []
        self.under: dict[str, list[tuple[int, int]]] = {}
        #: Heads looked at; the tests hold it against the number of titles.
        self.looked_at = 0

    def place(self, title: int, duration: int, chain: bool, clips: list[str], seconds: list[int]) -> int:
        """The head of *title*: the first one that takes it, or itself."""
        num, den = self.within
        prefix = clips[: len(clips) - self.k + 1]
        low, high = duration * (den - num) // den, -(-duration * den // (den - num))
        near = set()
        for clip in prefix:
            listed = self.under.get(clip, ())
            for _, h in listed[bisect_left(listed, (low, -1)) : bisect_right(listed, (high, len(self.heads)))]:
                near.add(h)
        played, total = dict(zip(clips, seconds)), sum(seconds)
        for h in sorted(near):
            self.looked_at += 1
            name, other, other_chain, other_clips, other_total = self.heads[h]
            if abs(duration - other) * den > num * max(duration, other):
                continue
            shared = played.keys() & other_clips
            if len(shared) < self.k:
                continue
            if chain and other_chain:
                footage = sum(played[c] for c in shared)
                if footage * self.share[1] < self.share[0] * min(total, other_total):
                    continue
            return name
        for clip in prefix:
            insort(self.under.setdefault(clip, []), (duration, len(self.heads)))
        self.heads.append((title, duration, chain, frozenset(clips), total))
        return title


def edition_groups(
    titles: DataFrame,
    items: DataFrame,
    k: int = SHARED_CLIPS,
    within: tuple[int, int] = LENGTH_SHARE,
    share: tuple[int, int] = CHAIN_SHARE,
) -> DataFrame:
    """Groups of titles that look like editions of one film: ``disc_id, head, title_idx``.

    In list order, a title joins the first head with *k* of its clips and a duration within
    *within* (a fraction of the longer one), or becomes a head.  Titles with a ``vts`` (if
    there is such a column) are chains: their clips are those of their title set, and two
    chains must also share the fraction *share* of the shorter one's seconds.

    The choice is sequential by definition (a title waits for all heads before it), so a
    disc is decided in one stream of its rows.  Alike titles (duration, clips and their
    seconds) are decided once, before rows meet; only heads are kept in memory.  A fixed
    number of shuffles, no rounds.
    """
    if "vts" not in titles.columns:
        titles = titles.withColumn("vts", F.lit(None).cast("int"))
    played = items.groupBy("title_id", "clip_id").agg(F.sum(micros("duration")).alias("s"))
    named = titles.filter(F.col("duration").isNotNull()).select(
        "disc_id", "title_id", "title_idx", micros("duration").alias("d"), "vts"
    )
    clip = F.concat_ws(":", F.coalesce(F.col("vts").cast("string"), F.lit("")), F.col("clip_id").cast("string"))
    rows = played.join(named, "title_id").select(
        "disc_id", "title_idx", "d", F.col("vts").isNotNull().alias("chain"), clip.alias("clip"), "s"
    )
    rows = cut_lineage(rows)
    common = rows.groupBy("disc_id", "clip").agg(F.count(F.lit(1)).alias("f"))
    # A clip of one title alone cannot be shared, but stands first in the order like any rare one.
    sets = (
        rows.join(common, ["disc_id", "clip"])
        .groupBy("disc_id", "title_idx", "d", "chain")
        .agg(F.sort_array(F.collect_list(F.struct("f", "clip", "s"))).alias("c"))
        .filter(F.size("c") >= k)
    )
    alike = F.sha2(F.to_json("c"), 256)
    signed = cut_lineage(sets.select("disc_id", "title_idx", "d", "chain", alike.alias("alike"), "c"))
    same = ["disc_id", "d", "chain", "alike"]
    reps = signed.groupBy(*same).agg(F.min_by(F.struct("title_idx", "c"), "title_idx").alias("r"))
    reps = reps.select(*same, F.col("r.title_idx").alias("rep"), F.col("r.c").alias("c"))
    schema = T.StructType([*[reps.schema[c] for c in same], T.StructField("head", reps.schema["rep"].dataType)])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disc, state = None, None
        for batch in batches:
            heads = []
            for now, d, chain, rep, clips in zip(*(batch.column(n).to_pylist() for n in ("disc_id", "d", "chain", "rep", "c"))):
                if state is None or now != disc:
                    disc, state = now, GreedyHeads(k, within, share)
                heads.append(state.place(rep, d, chain, [x["clip"] for x in clips], [x["s"] for x in clips]))
            head = pa.array(heads, batch.schema.field("rep").type)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in same], head], [*same, "head"])

    decided = reps.repartition("disc_id").sortWithinPartitions("disc_id", "rep").mapInArrow(decide, schema)
    heads = cut_lineage(decided)
    placed = signed.select(*same, "title_idx").join(heads, same).select("disc_id", "head", "title_idx")
    others = placed.filter(F.col("head") != F.col("title_idx"))
    return others.unionByName(others.select("disc_id", "head", F.col("head").alias("title_idx")).distinct())


# --- combining ------------------------------------------------------------------------


def union_timeline(editions: DataFrame) -> DataFrame:
    """Union of the editions' clips with starts on the combined timeline.

    Editions: ``group_id, edition, pos, clip_id, duration`` and, if it is wanted, ``size``.
    """
    size = ["size"] if "size" in editions.columns else []
    union = s.ordered_union(editions, "group_id", "edition", "pos", "clip_id", ["duration", *size])
    return s.with_offsets(union, "group_id", "out_idx", "duration", "clip_start").select(
        "group_id", "clip_id", "out_idx", "clip_start", F.col("duration").alias("clip_duration"), *size
    )


def edition_atoms(editions: DataFrame, union: DataFrame, marks: DataFrame) -> DataFrame:
    """Ordered-chapter atoms of every edition on the combined timeline.

    Each played clip is cut at the edition's chapters in ``(offset, offset + length]``;
    a rest without a chapter at its end is a tail.  An atom behind a tail continues a
    chapter and is hidden; visible ones are numbered.

    Unless a group is hot, items, union and chapters are dealt by group once, and no step
    shuffles again.
    """
    key, clip = ["group_id", "edition"], ["group_id", "clip_id"]
    played, timed = editions.select(*key, "pos", "clip_id"), union.select(*clip, "clip_start", "clip_duration")
    if o.has_hot_group(played, ["group_id"], group_rows(editions.sparkSession)):
        played = played.join(timed, clip)
        virtual = cut_lineage(s.with_offsets(played, key, "pos", "clip_duration", "v_start"))
    else:
        played = beside(o.together(played, "group_id"), o.together(cut_lineage(timed), "group_id"), clip)
        virtual = s.with_offsets(played, key, "pos", "clip_duration", "v_start")
    payload = ["pos", "clip_start", "clip_duration"]
    points = o.together(marks.select(*key, "t"), "group_id")
    located = asof_interval(points, virtual, key, "t", "v_start", payload, -EPSILON).filter(F.col("t") <= F.col("iv_start") + F.col("clip_duration") + EPSILON)
    cuts = located.select(
        *key, "pos", (F.col("clip_start") + F.col("t") - F.col("iv_start")).alias("end"), F.lit(False).alias("tail"), "clip_start"
    )
    tails = virtual.select(
        *key, "pos", (F.col("clip_start") + F.col("clip_duration")).alias("end"), F.lit(True).alias("tail"), "clip_start"
    )
    pieces = o.ordered(
        cuts.unionByName(tails), key, ["pos", "tail", "end"], block_on=["pos"], _end=o.lag("end"), _pos=o.lag("pos")
    )
    start = F.when(F.col("_pos") == F.col("pos"), F.col("_end")).otherwise(F.col("clip_start"))
    atoms = pieces.withColumn("start", start).filter(~F.col("tail") | (F.col("start") < F.col("end") - EPSILON))
    sides = o.ordered(
        atoms, key, ["pos", "tail", "end"], block_on=["pos"], _behind=o.lag("tail"), _rn=o.row_number()
    )
    hidden = sides.withColumn("hidden", F.coalesce("_behind", F.lit(False)))
    counted = o.ordered(
        hidden.withColumn("_one", (~F.col("hidden")).cast("long")), key, ["_rn"], _no=o.sum_to("_one")
    )
    name = F.when(~F.col("hidden"), F.format_string("Chapter %02d", F.col("_no")))
    return counted.select(
        *key, (F.col("_rn") - 1).alias("atom_idx"), "start", "end", "hidden", name.alias("name")
    )


def validate_editions(
    titles: DataFrame, items: DataFrame, k: int = SHARED_CLIPS, within: tuple[int, int] = LENGTH_SHARE
) -> DataFrame:
    """Why an edition cannot be combined with the first of its group; NULL when it can.

    Titles: ``group_id, edition, title_id, duration, kind``.  Every later edition is
    compared to the first only.
    """
    first = titles.filter(F.col("edition") == 0).select(
        "group_id", F.col("title_id").alias("_first"), F.col("duration").alias("_d"), F.col("kind").alias("_k")
    )
    base = (
        first.select("group_id", F.col("_first").alias("title_id"))
        .join(items.select("title_id", "clip_id").distinct(), "title_id")
        .select("group_id", "clip_id")
    )
    later = titles.filter(F.col("edition") > 0)
    shared = (
        later.select("group_id", "title_id")
        .join(items.select("title_id", "clip_id").distinct(), "title_id")
        .join(base, ["group_id", "clip_id"])
        .groupBy("group_id", "title_id")
        .agg(F.count(F.lit(1)).alias("_shared"))
    )
    joined = later.join(first, "group_id").join(shared, ["group_id", "title_id"], "left")
    far = F.abs(F.col("duration") - F.col("_d")) > F.lit(within[0] / within[1]) * F.greatest("duration", "_d")
    reason = (
        F.when(F.col("kind") != F.col("_k"), "other_kind")
        .when(F.coalesce("_shared", F.lit(0)) < k, "few_shared_clips")
        .when(far, "other_length")
    )
    return joined.select("group_id", "edition", "title_id", reason.alias("reason"))


def combine_editions(
    titles: DataFrame, items: DataFrame, marks: DataFrame, k: int = SHARED_CLIPS, within: tuple[int, int] = LENGTH_SHARE
) -> tuple[DataFrame, DataFrame]:
    """``(atoms, rejected)``: combined editions of every group that passes validation.

    Marks: ``title_id, mark_idx, t``.  The first edition is the default one.
    """
    judged = validate_editions(titles, items, k, within)
    rejected = judged.filter(F.col("reason").isNotNull())
    good = titles.join(rejected.select("group_id").distinct(), "group_id", "left_anti")
    editions = good.select("group_id", "edition", "title_id", F.col("duration").alias("title_duration")).join(
        items, "title_id"
    )
    union = union_timeline(editions.select("group_id", "edition", "pos", "clip_id", "duration", "size"))
    own = good.select("group_id", "edition", "title_id", "duration").join(marks, "title_id")
    last = o.with_group(own, "title_id", _last=F.max("mark_idx"))
    real = last.filter(~((F.col("mark_idx") == F.col("_last")) & (F.col("t") >= F.col("duration") - 0.5)))
    atoms = edition_atoms(editions, union, real.select("group_id", "edition", "t"))
    return atoms.withColumn("is_default", F.col("edition") == 0), rejected


# --- exact tiling -------------------------------------------------------------------------


def tile_sequences(items: DataFrame, group: str, ident: str, item: str) -> DataFrame:
    """Sequences that are a concatenation of other whole sequences of their group.

    Rows ``group, parent, step, part, offset``: the tiling a longest-part-first search
    with backtracking finds.  Equal sequences count once (lowest *ident*).  Parts are
    found by fingerprint: prefix sums give every window of a parent an order-sensitive
    checksum, so windows meet parts by equality on (length, checksums) and are then
    compared item by item; sequences are never compared with each other directly.
    """
    signed = layout_signature(items, [group, ident], ["pos"], [item])
    distinct = signed.groupBy(group, "n", "sig_a", "sig_b").agg(F.min(ident).alias("_id")).select(
        group, F.col("_id"), F.col("n").cast("int").alias("n")
    )
    rows = cut_lineage(
        items.select(group, F.col(ident).alias("_id"), "pos", F.col(item).alias("_item")).join(distinct, [group, "_id"])
    )
    code = F.pmod(F.xxhash64(F.col("_item").cast("string")), F.lit(1 << 31))
    coded = rows.withColumns({"_h": code, "_ph": code * F.col("pos") % PRIME})
    unit = [group, "_id"]
    sums = o.ordered(
        coded, unit, ["pos"], block_on=["pos"], _s=o.sum_before("_h"), _t=o.sum_before("_ph"), _rn=o.row_number()
    )
    # A row per position: the sums before it and the item there; behind the last item, the sums of all.
    here = F.struct(F.col("pos").cast("int").alias("at"), "_s", "_t", F.col("_h").alias("_first"))
    behind = F.struct(
        F.col("n").alias("at"),
        (F.col("_s") + F.col("_h")).alias("_s"),
        (F.col("_t") + F.col("_ph")).alias("_t"),
        F.lit(None).cast("long").alias("_first"),
    )
    places = F.array_compact(F.array(here, F.when(F.col("_rn") == F.col("n"), behind)))
    prefix = cut_lineage(sums.select(*unit, "n", F.explode(places).alias("p")).select(*unit, "n", "p.*"))
    # A window can only be a part that begins with its first item.
    heads = prefix.filter(F.col("at") == 0).select(group, F.col("n").alias("len"), "_first").distinct()
    starts = prefix.join(heads, [group, "_first"]).filter(
        (F.col("len") < F.col("n")) & (F.col("at") + F.col("len") <= F.col("n"))
    )
    stops = prefix.select(*unit, F.col("at").alias("to"), F.col("_s").alias("_s2"), F.col("_t").alias("_t2"))
    width = F.col("_s2") - F.col("_s")
    moved = F.col("_t2") - F.col("_t") - F.col("at").cast("long") * (width % PRIME)
    windows = (
        starts.drop("_first")
        .withColumn("to", F.col("at") + F.col("len"))
        .join(stops, [*unit, "to"])
        .select(*unit, "n", "at", "to", "len", width.alias("_ws"), F.pmod(moved, F.lit(PRIME)).alias("_wt"))
    )
    parts = prefix.filter(F.col("at") == F.col("n")).select(
        group, F.col("_id").alias("part"), F.col("n").alias("len"), F.col("_s").alias("_ps"), (F.col("_t") % PRIME).alias("_pt")
    )
    same = (F.col("_ws") == F.col("_ps")) & (F.col("_wt") == F.col("_pt"))
    found = windows.join(parts, [group, "len"]).filter(same).select(*unit, "n", "at", "to", "part", "len")
    # Checksums only propose; items decide.
    part_items = rows.select(group, F.col("_id").alias("part"), F.col("pos").alias("_p"), F.col("_item").alias("_want"))
    own_items = rows.select(*unit, F.col("pos").alias("_q"), F.col("_item").alias("_have"))
    checked = (
        found.join(part_items, [group, "part"])
        .withColumn("_q", F.col("at") + F.col("_p"))
        .join(own_items, [*unit, "_q"])
        .groupBy(*unit, "n", "at", "to", "part", "len")
        .agg(F.bool_and(F.col("_want") == F.col("_have")).alias("_ok"))
        .filter("_ok")
        .drop("_ok")
    )
    edges = checked
    # From the end backwards, the first usable edge of an offset is its longest one.
    flagged = fold(
        edges.withColumns({"_back": -F.col("at"), "_short": -F.col("len")}),
        unit,
        ["_back", "_short"],
        ["n", "at", "to"],
        _reach_step,
        [("_best", T.BooleanType())],
    )
    walked = fold(flagged.filter("_best"), unit, ["at"], ["at", "to"], _walk_step, [("step", T.IntegerType())])
    return walked.filter(F.col("step").isNotNull()).select(
        group, F.col("_id").alias("parent"), "step", "part", F.col("at").alias("offset")
    )


def _reach_step(state, size, start, end):
    """Mark the first edge of each offset that leads to the end; state = good offsets."""
    good = state[0] if state is not None else {}
    if str(start) in good or (end != size and str(end) not in good):
        return (good,), (False,)
    good[str(start)] = 1
    return (good,), (True,)


def _walk_step(state, start, end):
    """Number the edges met when walking from offset 0; state = (next offset, count)."""
    wanted, count = state if state is not None else (0, 0)
    if start != wanted:
        return (wanted, count), (None,)
    return (end, count + 1), (count,)
