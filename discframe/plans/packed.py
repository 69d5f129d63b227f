"""Episodes packed into one long title: detection from chapter marks, and the split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discframe.operators import ordered as o
from discframe.operators.aggregate import exact_median
from discframe.operators.joins import asof_interval
from discframe.session import cut_lineage

EPSILON = 1e-3


@dataclass(frozen=True)
class Rules:
    """Detection thresholds in seconds and shares."""

    short: float = 180.0
    bucket: float = 5.0
    min_episode: float = 900.0
    max_episode: float = 4200.0
    spread: float = 0.12
    min_cycles: int = 3
    lead_match: float = 1.5
    snap: float = 60.0


def _gaps(marks: DataFrame, titles: DataFrame) -> DataFrame:
    """Marks inside the title with index, gap to the next bound and short-run length."""
    inside = marks.join(titles.select("title_id", "duration"), "title_id").filter(
        (F.col("t") >= 0) & (F.col("t") < F.col("duration"))
    )
    placed = o.ordered(inside, "title_id", ["t", "mark_idx"], _rn=o.row_number(), _next=o.lead("t"))
    return placed.select(
        "title_id",
        (F.col("_rn") - 1).alias("i"),
        "t",
        "duration",
        (F.coalesce("_next", "duration") - F.col("t")).alias("gap"),
    )


def find_anchors(gaps: DataFrame, rules: Rules) -> DataFrame:
    """The anchor marks of every title with near-uniform cycles, and the typical length.

    Short segments of one kind (rounded length, behind a short segment or not) anchor
    cycles; of several kinds the one starting first wins.
    """
    seen = o.ordered(gaps, "title_id", ["i"], _gap=o.lag("gap"))
    after_short = (F.col("i") == 0) | (F.col("_gap") < rules.short)
    short = (F.col("gap") > 0) & (F.col("gap") < rules.short)
    kinds = seen.filter(short).select(
        "title_id", "i", "t", F.bround(F.col("gap") / rules.bucket).cast("long").alias("kind"), after_short.alias("after")
    )
    unit = ["title_id", "kind", "after"]
    spaced = o.ordered(kinds, unit, ["i"], _prev=o.lag("t")).withColumn("_space", F.col("t") - F.col("_prev"))
    typical = exact_median(spaced.filter(F.col("_space").isNotNull()), unit, "_space", interpolate=True)
    bounds = spaced.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("_count"), F.min("_space").alias("_lo"), F.max("_space").alias("_hi"), F.min("t").alias("_first")
    )
    wide = F.col("median") * rules.spread
    good = bounds.join(typical, unit).filter(
        (F.col("_count") >= rules.min_cycles)
        & F.col("median").between(rules.min_episode, rules.max_episode)
        & (F.col("_hi") - F.col("median") <= wide)
        & (F.col("median") - F.col("_lo") <= wide)
    )
    best = good.groupBy("title_id").agg(
        F.min_by(F.struct("kind", "after", "median"), F.struct("_first", -F.col("_count"))).alias("_b")
    )
    chosen = best.select("title_id", "_b.kind", "_b.after", F.col("_b.median").alias("typical"))
    return kinds.join(chosen, unit).select("title_id", "i", "typical")


def packed_episodes(marks: DataFrame, titles: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Segments ``title_id, seg_idx, start, end, episode`` (episode NULL = extra).

    Marks: ``title_id, mark_idx, t``; titles: ``title_id, duration``.  An episode starts
    behind the ending run of short segments in front of its anchor; intros recurring
    like the title's own lead-in belong to the episode they open.
    """
    gaps = cut_lineage(_gaps(marks, titles))
    anchors = cut_lineage(find_anchors(gaps, rules).withColumn("anchor", F.lit(True)))
    long_at = F.when(F.col("gap") >= rules.short, F.col("i"))
    rows = gaps.join(anchors, ["title_id", "i"], "left").join(
        anchors.groupBy("title_id").agg(F.min("i").alias("_a0"), F.max("typical").alias("_typical")), "title_id"
    )
    runs = o.ordered(
        rows,
        "title_id",
        ["i"],
        _long=o.last_before(long_at),
        _to=o.next_after(F.when(F.col("anchor"), F.col("i"))),
    ).withColumn("run", F.col("i") - 1 - F.coalesce("_long", F.lit(-1)))
    later = F.col("anchor") & (F.col("i") > F.col("_a0"))
    facts = runs.groupBy("title_id").agg(
        F.min(F.when(later, F.col("run"))).alias("_ending"),
        F.max(F.when(later, F.col("run"))).alias("_longest"),
        F.max(F.when((F.col("i") == F.col("_a0")) & (F.col("run") == F.col("i")), F.col("i"))).alias("_lead"),
        F.min("t").alias("_t0"),
    )
    told = cut_lineage(runs.join(facts.withColumn("_lead", F.coalesce("_lead", F.lit(0))), "title_id"))
    # Where every run is equally long, compare the marks just before each later anchor
    # with the lead-in, place by place.
    compares = (
        (F.col("_lead") > 0) & (F.col("_lead") < F.col("_ending")) & (F.col("_ending") == F.col("_longest"))
    )
    place = F.col("_lead") - (F.col("_to") - F.col("i"))
    before = told.filter(compares & (F.col("_to") > F.col("_a0")) & (place >= 0)).select(
        "title_id", place.alias("_j"), F.col("gap").alias("_g")
    )
    lead_in = told.filter(compares & (F.col("i") < F.col("_lead"))).select(
        "title_id", F.col("i").alias("_j"), F.col("gap").alias("_want"), "_lead"
    )
    intros = (
        before.join(lead_in, ["title_id", "_j"])
        .groupBy("title_id", "_lead")
        .agg(F.bool_and(F.abs(F.col("_g") - F.col("_want")) <= rules.lead_match).alias("_same"))
        .filter("_same")
        .select("title_id", F.col("_lead").alias("_intro"))
    )
    endings = told.join(intros, "title_id", "left").withColumn(
        "_ending", F.col("_ending") - F.coalesce("_intro", F.lit(0))
    )
    spots = endings.filter(later).select(
        "title_id", (F.col("i") - (F.col("run") - F.col("_ending"))).alias("i"), F.col("i").alias("_by")
    )
    starts = spots.join(gaps.select("title_id", "i", "t"), ["title_id", "i"]).select(
        "title_id", F.col("t").alias("start"), "_by"
    )
    first = told.select("title_id", "_t0").distinct().select("title_id", F.col("_t0").alias("start"), F.lit(-1).alias("_by"))
    timed = starts.unionByName(first).join(titles.select("title_id", "duration"), "title_id").join(
        anchors.groupBy("title_id").agg(F.max("typical").alias("typical")), "title_id"
    )
    cut = o.ordered(timed, "title_id", ["_by"], _rn=o.row_number(), _next=o.lead("start"))
    segments = cut_lineage(cut).select(
        "title_id",
        (F.col("_rn") - 1).alias("seg_idx"),
        "start",
        F.coalesce("_next", "duration").alias("end"),
        F.col("_rn").alias("episode"),
        F.col("_next").isNull().alias("_last"),
        "typical",
        "duration",
    )
    tails = segments.filter(F.col("_last") & (F.col("end") - F.col("start") > F.col("typical") + rules.snap))
    target = F.col("start") + F.col("typical")
    bounds = gaps.select("title_id", "t").unionByName(titles.select("title_id", F.col("duration").alias("t")))
    nearest = (
        tails.select("title_id", "start", "typical", "end")
        .join(bounds, "title_id")
        .filter(F.col("t") > F.col("start"))
        .groupBy("title_id", "end")
        .agg(F.min(F.struct(F.abs(F.col("t") - target).alias("off"), "t")).alias("_c"))
        .filter((F.col("_c.off") <= rules.snap) & (F.col("_c.t") < F.col("end")))
        .select("title_id", F.col("_c.t").alias("_cut"))
    )
    split = segments.join(nearest, "title_id", "left")
    here = F.col("_last") & F.col("_cut").isNotNull()
    main = F.struct("seg_idx", "start", F.when(here, F.col("_cut")).otherwise(F.col("end")).alias("end"), "episode")
    extra = F.struct(
        (F.col("seg_idx") + 1).alias("seg_idx"), F.col("_cut").alias("start"), "end", F.lit(None).cast("int").alias("episode")
    )
    pieces = F.array_compact(F.array(main, F.when(here, extra)))
    return split.select("title_id", F.explode(pieces).alias("p")).select("title_id", "p.*")


def split_packed(
    segments: DataFrame, items: DataFrame, marks: DataFrame, names: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(children, chapters)`` of every packed title.

    Items: ``title_id, pos, duration, size``; names: ``title_id, base_name``.  A child keeps
    the clips its segment overlaps; its range and chapters count from the first of them.
    """
    clips = o.ordered(
        items, "title_id", ["pos"],
        clip_start=o.sum_before("duration"), _bytes=o.sum_before("size"),
    ).withColumns(
        {"clip_end": F.col("clip_start") + F.col("duration"), "_through": F.col("_bytes") + F.col("size")}
    )
    first = asof_interval(
        segments, clips, "title_id", "start", "clip_start", ["pos", "_bytes"], EPSILON
    ).withColumnsRenamed({"iv_start": "base", "pos": "first_pos", "_bytes": "_skip"})
    ends = clips.select("title_id", "clip_end", F.col("pos").alias("_before"))
    # Clips that end before the segment does; the next one covers the segment's end.
    last = asof_interval(first, ends, "title_id", "end", "clip_end", ["_before"], -EPSILON).withColumn(
        "last_pos", F.coalesce(F.col("_before") + 1, F.lit(0))
    )
    sized = last.join(
        clips.select("title_id", F.col("pos").alias("last_pos"), "_through"), ["title_id", "last_pos"]
    )
    extra = F.col("episode").isNull()
    numbered = o.ordered(
        sized.withColumn("_x", extra.cast("long")), "title_id", ["seg_idx"], _extra=o.sum_to("_x")
    )
    width = o.with_group(numbered, "title_id", _top=F.max("episode")).join(names, "title_id")
    digits = F.length(F.greatest(F.coalesce("_top", F.lit(1)), F.lit(1)).cast("string"))
    name = F.when(extra, F.concat("base_name", F.lit(" - Extra "), F.col("_extra").cast("string"))).otherwise(
        F.concat("base_name", F.lit(" - Episode "), F.lpad(F.col("episode").cast("string"), digits, "0"))
    )
    children = width.select(
        "title_id",
        "seg_idx",
        "episode",
        name.alias("name"),
        "first_pos",
        "last_pos",
        (F.col("start") - F.col("base")).alias("range_start"),
        (F.col("end") - F.col("base")).alias("range_end"),
        (F.col("_through") - F.col("_skip")).alias("size"),
        "start",
        "end",
        "base",
    )
    spans = children.select("title_id", "seg_idx", "start", F.col("end").alias("seg_end"), "base")
    hit = asof_interval(marks, spans, "title_id", "t", "start", ["seg_idx", "seg_end", "base"])
    chapters = hit.filter(F.col("t") < F.col("seg_end")).select(
        "title_id", "seg_idx", "mark_idx", (F.col("t") - F.col("base")).alias("t")
    )
    return children.drop("start", "end", "base"), chapters


def expand_order(titles: DataFrame, children: DataFrame, group: str = "disc_id") -> DataFrame:
    """Listing after replacing packed titles by their children: new indices from 0."""
    parents = children.select("title_id").distinct()
    kept = titles.join(parents, "title_id", "left_anti").select(group, "title_id", "title_idx", F.lit(0).alias("seg_idx"))
    split = titles.join(children.select("title_id", "seg_idx"), "title_id").select(
        group, "title_id", "title_idx", "seg_idx"
    )
    ranked = o.ordered(
        kept.unionByName(split), group, ["title_idx", "seg_idx"], block_on=["title_idx"], _rn=o.row_number()
    )
    return ranked.withColumn("new_idx", F.col("_rn") - 1).drop("_rn")


def packed_count(segments: DataFrame) -> DataFrame:
    return segments.groupBy("title_id").agg(F.count("episode").alias("episodes"))


