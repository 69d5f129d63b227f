"""Episode recognition: duration clusters with guards, per playlist, chain and disc."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discframe.operators import ordered as o
from discframe.operators.aggregate import layout_signature, shared_fraction
from discframe.operators.joins import micros, near_ranges
from discframe.plans.editions import tile_sequences
from discframe.session import cut_lineage

TOLERANCE = (15, 100)
DWARF_RATIO = 3
MIN_DURATION = 60
PLAY_ALL_SHARE = 0.05
SHARED_RUNTIME = 0.5


def duration_clusters(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Distinct neighbourhoods of each group: ``rank_lo, rank_hi, size, centre, first``.

    Members are the rows whose rank by ``(value, order)`` lies in ``[rank_lo, rank_hi)``;
    ``centre`` is the smallest value with this neighbourhood, ``first`` the lowest
    *order* among the rows at its centres.
    """
    ranges = near_ranges(rows, group, value, TOLERANCE)
    first = rows.groupBy(group, micros(value).alias("v")).agg(F.min(order).alias("_first"))
    return (
        ranges.join(first, [group, "v"])
        .groupBy(group, "rank_lo", "rank_hi")
        .agg(F.min("v").alias("centre"), F.min("_first").alias("first"))
        .withColumn("size", F.col("rank_hi") - F.col("rank_lo"))
    )


def ranked(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Rows with their 0-based rank by value inside the group."""
    placed = rows.withColumn("_v", micros(value))
    numbered = o.ordered(placed, group, ["_v", order], _rn=o.row_number())
    return numbered.withColumn("rank", (F.col("_rn") - 1).cast("long")).drop("_rn", "_v")


def clashes(rows: DataFrame, links: DataFrame, group: str) -> DataFrame:
    """Clusters containing a linked pair, decided by one running maximum.

    *links* holds ``group, low, high`` ranks of pairs that must not share a cluster.  A
    cluster ``[lo, hi)`` has such a pair exactly when the largest ``low`` among links
    with ``high < hi`` is at least ``lo``.  Returns ``group, rank, worst``: that maximum
    for clusters ending behind *rank*.
    """
    per_rank = links.groupBy(group, F.col("high").alias("rank")).agg(F.max("low").alias("_low"))
    joined = rows.select(group, "rank").join(per_rank, [group, "rank"], "left")
    return o.ordered(joined, group, ["rank"], worst=o.max_to("_low")).select(group, "rank", "worst")


def _without_clash(clusters: DataFrame, worst: DataFrame, group: str) -> DataFrame:
    end = worst.withColumn("rank_hi", F.col("rank") + 1).drop("rank")
    judged = clusters.join(end, [group, "rank_hi"])
    return judged.filter(F.coalesce(F.col("worst") < F.col("rank_lo"), F.lit(True))).drop("worst")


# --- one episode per playlist -----------------------------------------------------------


def label_playlist_episodes(titles: DataFrame, items: DataFrame) -> DataFrame:
    """Episode numbers and play-alls of discs with one playlist per episode.

    Titles: ``disc_id, title_id, title_idx, duration`` (seconds), ``playlist_no,
    candidate`` (listed, not looped, long enough, nothing labelled yet), ``content``
    (listed and not looped) and ``layout``.  Result: ``disc_id, title_id, episode,
    play_all`` for labelled titles only.
    """
    sequences = layout_signature(items, "title_id", ["pos"], ["clip_id"])
    read = titles.select("disc_id", "title_id", "title_idx", "duration", "playlist_no", "candidate", "content", "layout")
    read = read.filter(F.col("candidate") | F.col("content"))
    keyed = cut_lineage(read.join(sequences, "title_id").select(*read.columns, F.struct("n", "sig_a", "sig_b").alias("seq")))
    chosen = keyed.filter("candidate").groupBy("disc_id", "seq").agg(
        F.min_by(F.struct("title_id", "title_idx", "duration", "playlist_no", "layout"), "title_idx").alias("_t")
    )
    singles_all = chosen.select("disc_id", "seq", "_t.*")
    rows = items.join(singles_all.select("disc_id", "title_id", "title_idx"), "title_id")
    tiles = cut_lineage(tile_sequences(rows, "disc_id", "title_idx", "clip_id"))
    chains = tiles.select("disc_id", F.col("parent").alias("title_idx")).distinct()
    singles = singles_all.join(chains, ["disc_id", "title_idx"], "left_anti")

    placed = cut_lineage(ranked(singles, "disc_id", "duration", "title_idx"))
    clusters = duration_clusters(placed, "disc_id", "duration", "title_idx")
    clips = items.select("title_id", "clip_id").join(placed.select("disc_id", "title_id", "rank"), "title_id").distinct()
    shared = o.ordered(clips, ["disc_id", "clip_id"], ["rank"], low=o.lag("rank")).filter(F.col("low").isNotNull())
    worst = clashes(placed, shared.select("disc_id", "low", F.col("rank").alias("high")), "disc_id")
    disjoint = _without_clash(clusters.filter(F.col("size") >= 2), worst, "disc_id")

    # Layout counts per distinct duration keep the cluster expansion small.
    counted = placed.groupBy("disc_id", "duration", "layout").agg(
        F.count(F.lit(1)).alias("_n"), F.min("title_idx").alias("_idx"), F.min("rank").alias("_rank")
    )
    spread = disjoint.select("disc_id", "rank_lo", "rank_hi", "first").join(counted, "disc_id").filter(
        (F.col("_rank") >= F.col("rank_lo")) & (F.col("_rank") < F.col("rank_hi"))
    )
    per_layout = spread.groupBy("disc_id", "rank_lo", "rank_hi", "first", "layout").agg(
        F.sum("_n").alias("size"), F.min("_idx").alias("_idx")
    )
    dominant = per_layout.groupBy("disc_id", "rank_lo", "rank_hi", "first").agg(
        F.max(F.struct("size", -F.col("_idx"), "layout")).alias("_d")
    )
    best = dominant.groupBy("disc_id").agg(
        F.min_by(
            F.struct("rank_lo", "rank_hi", F.col("_d.size").alias("size"), F.col("_d.layout").alias("_layout")),
            F.struct(-F.col("_d.size"), "first"),
        ).alias("_b")
    ).select("disc_id", "_b.*").filter(F.col("size") >= 2)
    group = placed.join(best, "disc_id").filter(
        (F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_hi")) & (F.col("layout") == F.col("_layout"))
    ).select("disc_id", "title_id", "title_idx", "seq", "duration", "playlist_no", "size")
    group = cut_lineage(group)

    # Chains built from group members only, and the first one that uses all of them.
    member = group.select("disc_id", F.col("title_idx").alias("part"), "size")
    used = tiles.join(member, ["disc_id", "part"], "left").groupBy("disc_id", "parent").agg(
        F.bool_and(F.col("size").isNotNull()).alias("_inside"),
        F.count_distinct("part").alias("_parts"),
        F.max("size").alias("_size"),
    ).filter("_inside")
    covering = used.filter(F.col("_parts") == F.col("_size")).groupBy("disc_id").agg(F.min("parent").alias("_cover"))
    sized = group.join(covering, "disc_id", "left").filter((F.col("size") >= 3) | F.col("_cover").isNotNull())

    longest = sized.groupBy("disc_id").agg(F.max("duration").alias("_longest"))
    own = sized.select("disc_id", "seq").distinct()
    chain_seq = used.select("disc_id", F.col("parent").alias("title_idx")).join(
        singles_all.select("disc_id", "title_idx", "seq"), ["disc_id", "title_idx"]
    ).select("disc_id", "seq")
    rivals = (
        keyed.filter("content")
        .join(own.unionByName(chain_seq), ["disc_id", "seq"], "left_anti")
        .join(longest, "disc_id")
        .filter(F.col("duration") >= F.col("_longest") * DWARF_RATIO)
        .select("disc_id")
        .distinct()
    )
    episodes = sized.join(rivals, "disc_id", "left_anti")
    places = tiles.groupBy("disc_id", F.col("parent").alias("_cover"), F.col("part").alias("title_idx")).agg(
        F.max("step").alias("_step")
    )
    covered = episodes.join(places, ["disc_id", "_cover", "title_idx"], "left")
    numbered = o.ordered(covered, "disc_id", ["playlist_no", "title_idx"], _rn=o.row_number())
    number = F.when(F.col("_cover").isNotNull(), F.col("_step") + 1).otherwise(F.col("_rn"))
    labels = numbered.select("disc_id", "title_id", number.cast("int").alias("episode"), F.lit(False).alias("play_all"))
    discs = labels.select("disc_id").distinct()
    play_all = (
        used.select("disc_id", F.col("parent").alias("title_idx"))
        .join(discs, "disc_id")
        .join(singles_all.select("disc_id", "title_idx", "title_id"), ["disc_id", "title_idx"])
        .select("disc_id", "title_id", F.lit(None).cast("int").alias("episode"), F.lit(True).alias("play_all"))
    )
    return labels.unionByName(play_all)


# --- chains of one title set ------------------------------------------------------------


def footage_pairs(cells: DataFrame, group: str, ident: str, share: float = SHARED_RUNTIME) -> DataFrame:
    """Pairs of a group's chains sharing *share* of the shorter one's runtime.

    Cells: ``group, ident, cell, seconds`` (one row per distinct cell).  A chain offers
    its rarest cells until they hold over ``1 - share`` of its runtime; whoever shares
    enough of it plays one of those, so common cells propose nobody.
    """
    common = o.with_group(cells, [group, "cell"], _freq=F.count(F.lit(1)))
    weighed = o.with_group(common, [group, ident], _total=F.sum("seconds"))
    known = weighed.filter(F.col(group).isNotNull() & F.col("cell").isNotNull())
    run = o.ordered(known, [group, ident], ["_freq", "cell"], _before=o.sum_before("seconds"))
    # Cells of one chain alone count in its runtime and meet nobody.
    met_cells = cut_lineage(run.filter(F.col("_freq") > 1))
    offer = met_cells.filter(F.col("_before") <= F.col("_total") * (1 - share))
    left = offer.select(group, "cell", F.col(ident).alias("a"))
    right = met_cells.select(group, "cell", F.col(ident).alias("b"))
    met = left.join(right, [group, "cell"]).filter(F.col("a") != F.col("b"))
    pairs = met.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sums = met_cells.select(group, ident, "cell", "seconds", "_total")
    first = sums.select(group, F.col(ident).alias("a"), "cell", F.col("seconds").alias("_sa"), F.col("_total").alias("_ta"))
    second = sums.select(group, F.col(ident).alias("b"), "cell", F.col("seconds").alias("_sb"), F.col("_total").alias("_tb"))
    shared = (
        pairs.join(first, [group, "a"])
        .join(second, [group, "b", "cell"])
        .groupBy(group, "a", "b", "_ta", "_tb")
        .agg(F.sum("_sa").alias("_sa"), F.sum("_sb").alias("_sb"))
    )
    enough = (F.col("_sa") >= F.lit(share) * F.col("_ta")) | (F.col("_sb") >= F.lit(share) * F.col("_tb"))
    return shared.filter(enough).select(group, "a", "b")


def label_chain_episodes(chains: DataFrame, cells: DataFrame, group: str = "set_id", minimum: int = MIN_DURATION) -> DataFrame:
    """Episode chains and the play-all of each title set: ``group, pgc, role``.

    Chains: ``group, pgc, duration`` (seconds), ``n_cells, angle``; cells: ``group,
    pgc, pos, cell, seconds``.  Clusters are tried largest first, then shorter centre;
    the first one whose chains play distinct cells, do not re-cut each other and are
    not dwarfed is the episode set.  Sibling clusters of the same compilation join it.
    """
    every = cut_lineage(chains)
    substantial = every.filter((F.col("duration") >= minimum) & (F.col("n_cells") >= 1) & ~F.col("angle"))
    placed = cut_lineage(ranked(substantial, group, "duration", "pgc"))
    clusters = duration_clusters(placed, group, "duration", "pgc").filter(F.col("size") >= 2)

    seconds = cut_lineage(cells.groupBy(group, "pgc", "cell").agg(F.sum("seconds").alias("seconds")))
    mine = seconds.join(placed.select(group, "pgc", "rank"), [group, "pgc"])
    recut = footage_pairs(mine.drop("rank"), group, "pgc")
    signed = layout_signature(cells, [group, "pgc"], ["pos"], ["cell"]).join(
        placed.select(group, "pgc", "rank"), [group, "pgc"]
    )
    twins = o.ordered(signed, [group, "n", "sig_a", "sig_b"], ["rank"], low=o.lag("rank")).filter(
        F.col("low").isNotNull()
    ).select(group, "low", F.col("rank").alias("high"))
    rank_a = placed.select(group, F.col("pgc").alias("a"), F.col("rank").alias("_ra"))
    rank_b = placed.select(group, F.col("pgc").alias("b"), F.col("rank").alias("_rb"))
    linked = recut.join(rank_a, [group, "a"]).join(rank_b, [group, "b"]).select(
        group, F.least("_ra", "_rb").alias("low"), F.greatest("_ra", "_rb").alias("high")
    )
    links = cut_lineage(twins.unionByName(linked))
    worst = cut_lineage(clashes(placed, links, group))
    all_clusters = cut_lineage(clusters)
    alone = cut_lineage(_alone(every, seconds, group))
    judged = cut_lineage(_first_verdicts(_without_clash(all_clusters, worst, group), placed, every, alone, group))
    waiting = judged.filter("open").select(*all_clusters.columns)
    # Cells matter where an outsider may dwarf a cluster; rounds read the groups that wait.
    doubtful = cut_lineage(_of(seconds, judged.filter(F.col("open") & ~F.col("clear")), group))
    here, chains_here = placed, every

    decided = None
    while not waiting.isEmpty():
        top = waiting.groupBy(group).agg(
            F.min_by(F.struct("rank_lo", "rank_hi", "centre", "size"), F.struct(-F.col("size"), "centre")).alias("_c")
        ).select(group, "_c.*")
        members = here.join(top, group).filter(
            (F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_hi"))
        ).select(group, "pgc", "duration")
        members = cut_lineage(members)
        play_all = cut_lineage(_play_all(chains_here, members, group, minimum))
        small = _dwarfed(chains_here, doubtful, members, play_all, group)
        good = cut_lineage(top.join(small, group, "left_anti").select(group, "rank_lo", "rank_hi"))
        chosen = members.join(good.select(group), group, "left_semi").select(group, "pgc", "duration")
        found = cut_lineage(
            chosen.join(play_all.select(group, F.col("pgc").alias("play_all")), group, "left")
        )
        decided = found if decided is None else cut_lineage(decided.unionByName(found))
        failed = top.select(group, "rank_lo", "rank_hi")
        waiting = cut_lineage(
            waiting.join(good.select(group), group, "left_anti").join(failed, [group, "rank_lo", "rank_hi"], "left_anti")
        )
        here, chains_here, doubtful = (cut_lineage(_of(t, waiting, group)) for t in (here, chains_here, doubtful))
    if decided is None:
        return every.select(group, "pgc", F.lit("episode").alias("role")).filter(F.lit(False))
    offers = cut_lineage(_offers(decided, all_clusters, placed, every, alone, group, minimum))
    grown = _merge_siblings(
        _of(decided, offers, group), offers, *[cut_lineage(_of(t, offers, group)) for t in (placed, links, every, seconds)],
        group, minimum,
    )
    merged = decided.join(offers.select(group).distinct(), group, "left_anti").unionByName(grown)
    episodes = merged.select(group, "pgc", F.lit("episode").alias("role"))
    compilation = merged.filter(F.col("play_all").isNotNull()).select(group, F.col("play_all").alias("pgc")).distinct()
    return episodes.unionByName(compilation.withColumn("role", F.lit("play_all")))


def _of(rows: DataFrame, wanted: DataFrame, group: str) -> DataFrame:
    """The *rows* of the groups in *wanted*."""
    return rows.join(wanted.select(group).distinct(), group, "left_semi")


def _alone(every: DataFrame, seconds: DataFrame, group: str) -> DataFrame:
    """Chains sharing less than half of their runtime with all others of their group together.

    No compilation covers them and no set of members covers them, whichever those are.
    """
    met = o.with_group(seconds, [group, "cell"], _with=F.count(F.lit(1)))
    most = met.groupBy(group, "pgc").agg(
        F.try_divide(F.sum(F.when(F.col("_with") > 1, F.col("seconds")).otherwise(0)), F.sum("seconds")).alias("_most")
    )
    found = every.select(group, "pgc", "duration").join(most, [group, "pgc"], "left")
    return found.filter(F.coalesce("_most", F.lit(0.0)) < SHARED_RUNTIME - 1e-9).drop("_most")


def _first_verdicts(clusters: DataFrame, placed: DataFrame, every: DataFrame, alone: DataFrame, group: str) -> DataFrame:
    """Clusters, whether they are still ``open``, and ``clear`` of any outsider that may dwarf them.

    A cluster is closed where chains that nothing covers dwarf it: two of them, or one that
    is too long or short to be the play-all.  What lies within rounding stays open.
    """
    first_two = o.first_rows(alone, group, [-F.col("duration"), "pgc"], 2)
    rivals = first_two.groupBy(group).agg(
        F.max("duration").alias("_r1"), F.when(F.count("duration") > 1, F.min("duration")).alias("_r2")
    )
    top = every.groupBy(group).agg(F.max("duration").alias("_top"))
    run = o.ordered(placed, group, ["rank"], _sum=o.sum_to("duration")).select(group, "rank", "duration", "_sum")
    last = run.select(group, (F.col("rank") + 1).alias("rank_hi"), F.col("duration").alias("_longest"), "_sum")
    before = run.select(group, (F.col("rank") + 1).alias("rank_lo"), F.col("_sum").alias("_before"))
    facts = (
        clusters.join(last, [group, "rank_hi"])
        .join(before, [group, "rank_lo"], "left")
        .join(top, group)
        .join(rivals, group, "left")
        .withColumn("_sum", F.col("_sum") - F.coalesce("_before", F.lit(0.0)))
    )
    # Members come by whole millionths, sums by whole billionths.
    limit = (F.col("_longest") + 1e-5) * DWARF_RATIO
    far = F.abs(F.col("_r1") - F.col("_sum")) > F.lit(PLAY_ALL_SHARE + 1e-6) * F.col("_sum") + 1e-3
    closed = (F.col("_r2") >= limit) | ((F.col("_r1") >= limit) & far)
    clear = F.col("_top") < (F.col("_longest") - 1e-5) * DWARF_RATIO
    return facts.select(*clusters.columns, (~F.coalesce(closed, F.lit(False))).alias("open"), clear.alias("clear"))


def _offers(
    decided: DataFrame, clusters: DataFrame, placed: DataFrame, every: DataFrame, alone: DataFrame, group: str, minimum: int
) -> DataFrame:
    """The clusters that may still join an episode set, now or after it has grown.

    Left out are those without a new chain, with a new chain no compilation covers, and those
    that with the set run longer than any chain of the group, as sets only grow.
    """
    sets = decided.groupBy(group).agg(F.sum("duration").alias("_have"))
    top = every.filter(F.col("duration") >= minimum).groupBy(group).agg(F.max("duration").alias("_top"))
    known = sets.join(top, group)
    rows = (
        placed.select(group, "pgc", "rank", "duration")
        .join(known.select(group), group, "left_semi")
        .join(decided.select(group, "pgc"), [group, "pgc"], "left_anti")
        .join(alone.select(group, "pgc", F.lit(1).alias("_alone")), [group, "pgc"], "left")
    )
    new = rows.select(group, "rank", F.coalesce("_alone", F.lit(0)).alias("_a"), "duration", F.lit(1).alias("_one"))
    old = placed.select(group, "rank").join(known.select(group), group, "left_semi").join(new, [group, "rank"], "left")
    filled = old.fillna({"_a": 0, "duration": 0.0, "_one": 0})
    run = o.ordered(filled, group, ["rank"], _as=o.sum_to("_a"), _ns=o.sum_to("_one"), _ds=o.sum_to("duration"))
    upto = run.select(group, (F.col("rank") + 1).alias("rank_hi"), "_as", "_ns", "_ds")
    before = run.select(
        group, (F.col("rank") + 1).alias("rank_lo"), F.col("_as").alias("_a0"), F.col("_ns").alias("_n0"), F.col("_ds").alias("_d0")
    )
    facts = clusters.join(known, group).join(upto, [group, "rank_hi"]).join(before, [group, "rank_lo"], "left")
    facts = facts.fillna({"_a0": 0, "_n0": 0, "_d0": 0.0})
    length = F.col("_have") + F.col("_ds") - F.col("_d0")
    fits = (F.col("_ns") > F.col("_n0")) & (F.col("_as") == F.col("_a0"))
    return facts.filter(fits & (F.col("_top") >= F.lit(1 - PLAY_ALL_SHARE - 1e-6) * length - 1e-3)).select(*clusters.columns)


def _play_all(every: DataFrame, members: DataFrame, group: str, minimum: int) -> DataFrame:
    """Per group the first outside chain as long as the members together (within 5 %)."""
    total = members.groupBy(group).agg(F.sum("duration").alias("_sum"))
    outside = every.join(members.select(group, "pgc"), [group, "pgc"], "left_anti").filter(F.col("duration") >= minimum)
    near = F.abs(F.col("duration") - F.col("_sum")) <= F.lit(PLAY_ALL_SHARE) * F.col("_sum")
    hits = outside.join(total, group).filter((F.col("_sum") > 0) & near)
    return hits.groupBy(group).agg(F.min("pgc").alias("pgc"))


def _covered_share(seconds: DataFrame, suspects: DataFrame, pool: DataFrame, group: str) -> DataFrame:
    """Share of each suspect's runtime whose cells are in the group's *pool* of cells."""
    own = seconds.join(suspects.select(group, "pgc"), [group, "pgc"], "left_semi")
    marked = own.join(pool.select(group, "cell").distinct().withColumn("_in", F.lit(1)), [group, "cell"], "left")
    return marked.groupBy(group, "pgc").agg(
        (F.sum(F.when(F.col("_in") == 1, F.col("seconds")).otherwise(0)) / F.sum("seconds")).alias("share")
    )


def _dwarfed(every: DataFrame, seconds: DataFrame, members: DataFrame, play_all: DataFrame, group: str) -> DataFrame:
    """Groups where an outsider runs three times the longest member.

    Chains playing mostly the members' own cells are compilations and do not count.
    """
    longest = members.groupBy(group).agg(F.max("duration").alias("_longest"))
    suspects = (
        every.join(members.select(group, "pgc"), [group, "pgc"], "left_anti")
        .join(play_all.select(group, "pgc"), [group, "pgc"], "left_anti")
        .join(longest, group)
        .filter(F.col("duration") >= F.col("_longest") * DWARF_RATIO)
    )
    pool = seconds.join(members.select(group, "pgc"), [group, "pgc"], "left_semi")
    shares = _covered_share(seconds, suspects, pool, group)
    judged = suspects.join(shares, [group, "pgc"], "left")
    return judged.filter(F.coalesce("share", F.lit(0.0)) < SHARED_RUNTIME).select(group).distinct()


def _merge_siblings(decided, clusters, placed, links, every, seconds, group: str, minimum: int) -> DataFrame:
    """Grow episode sets by sibling clusters covered by one compilation.

    A pass offers every group its clusters in candidate order; clusters that did not fit
    are offered again in another pass as long as the group grew in this one.
    """
    current = decided
    order = F.struct(-F.col("size"), "centre")
    remaining = cut_lineage(clusters.join(decided.select(group).distinct(), group, "left_semi"))
    unit = [group, "rank_lo", "rank_hi"]
    while not remaining.isEmpty():
        untried, failed, changed = remaining, None, None
        while not untried.isEmpty():
            offer = cut_lineage(
                untried.groupBy(group).agg(F.min_by(F.struct("rank_lo", "rank_hi"), order).alias("_o")).select(group, "_o.*")
            )
            asked, good, grown = _try_merge(current, offer, placed, links, every, seconds, group, minimum)
            current = cut_lineage(current.join(good, group, "left_anti").unionByName(grown))
            misses = offer.join(asked, group, "left_semi").join(good, group, "left_anti")
            failed = misses if failed is None else failed.unionByName(misses)
            changed = good if changed is None else changed.unionByName(good)
            untried = cut_lineage(untried.join(offer, unit, "left_anti"))
        again = failed.join(changed.distinct(), group, "left_semi")
        remaining = cut_lineage(remaining.join(again, unit, "left_semi"))
    return current


def _try_merge(current, offer, placed, links, every, seconds, group: str, minimum: int):
    """``(asked, good, grown)``: groups the offer adds to, those it fits, and their rows."""
    other = placed.join(offer, group).filter(
        (F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_hi"))
    )
    new = cut_lineage(
        other.select(group, "pgc", "duration").join(current.select(group, "pgc"), [group, "pgc"], "left_anti")
    )
    asked = new.select(group).distinct()
    members = current.select(group, "pgc", "duration").join(asked, group, "left_semi")
    union = cut_lineage(members.unionByName(new))
    compilation = cut_lineage(_play_all(every, union, group, minimum))
    pool = seconds.join(union.select(group, "pgc"), [group, "pgc"], "left_semi")
    real = _covered_share(seconds, compilation, pool, group).filter(F.col("share") >= SHARED_RUNTIME)
    chain_cells = seconds.join(compilation, [group, "pgc"], "left_semi")
    inside = _covered_share(seconds, new, chain_cells, group)
    strays = new.join(inside, [group, "pgc"], "left").filter(F.coalesce("share", F.lit(0.0)) < SHARED_RUNTIME)
    ranks = placed.select(group, "pgc", "rank").join(union.select(group, "pgc"), [group, "pgc"], "left_semi")
    low = links.join(ranks.select(group, F.col("rank").alias("low")), [group, "low"], "left_semi")
    recut = low.join(ranks.select(group, F.col("rank").alias("high")), [group, "high"], "left_semi")
    small = _dwarfed(every, seconds, union, compilation, group)
    fits = cut_lineage(
        compilation.join(real.select(group).distinct(), group, "left_semi")
        .join(strays.select(group).distinct(), group, "left_anti")
        .join(recut.select(group).distinct(), group, "left_anti")
        .join(small, group, "left_anti")
        .select(group, F.col("pgc").alias("play_all"))
    )
    return asked, fits.select(group), union.join(fits, group).select(group, "pgc", "duration", "play_all")


def episode_parts(members: DataFrame, group: str, order: str = "pgc", value: str = "duration") -> DataFrame:
    """``Na``/``Nb`` labels where two equal families of lengths strictly alternate.

    Result: ``group, order, episode, part`` for the groups that qualify.
    """
    placed = ranked(members, group, value, order)
    clusters = duration_clusters(placed, group, value, order)
    best = o.ordered(
        clusters.withColumn("_neg", -F.col("size")), group, ["_neg", "centre"], _no=o.row_number()
    ).filter(F.col("_no") <= 2)
    total = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_total"))
    pair = (
        best.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("_k"),
            F.min("size").alias("_s1"),
            F.max("size").alias("_s2"),
            F.min(F.struct("rank_lo", "rank_hi")).alias("_low"),
            F.max(F.struct("rank_lo", "rank_hi")).alias("_high"),
        )
        .join(total, group)
        .filter(
            (F.col("_k") == 2)
            & (F.col("_s1") == F.col("_s2"))
            & (F.col("_s1") >= 2)
            & (F.col("_s1") * 2 == F.col("_total"))
            & (F.col("_low.rank_hi") <= F.col("_high.rank_lo"))
        )
    )
    family = (F.col("rank") >= F.col("_high.rank_lo")).alias("family")
    rows = placed.join(pair.select(group, "_high"), group).select(group, order, family)
    seen = o.ordered(rows, group, [order], _prev=o.lag("family"), _rn=o.row_number())
    judged = o.with_group(
        seen, group, _ok=F.bool_and(F.coalesce(F.col("family") != F.col("_prev"), F.lit(True)))
    ).filter("_ok")
    # Strict alternation: odd places are part "a", even ones part "b".
    return judged.select(
        group,
        order,
        F.ceil(F.col("_rn") / 2).cast("int").alias("episode"),
        F.when(F.col("_rn") % 2 == 1, "a").otherwise("b").alias("part"),
    )


# --- across a disc ------------------------------------------------------------------------


def label_cross_set(titles: DataFrame, candidate: Column, minimum: int = MIN_DURATION, least: int = 3) -> DataFrame:
    """Episodes of discs with one title set per episode: ``disc_id, title_id, episode``.

    Titles: ``disc_id, title_id, title_idx, number`` (logical title), ``duration``
    (seconds), ``play_all``.  The first largest cluster of candidates with at least
    *least* members, unless another title dwarfs it; numbered by logical title.
    """
    long_enough = F.col("duration") >= minimum
    first = (
        titles.filter(candidate & long_enough & F.col("number").isNotNull())
        .groupBy("disc_id", "number")
        .agg(F.min_by(F.struct("title_id", "title_idx", "duration"), "title_idx").alias("_t"))
        .select("disc_id", "number", "_t.*")
    )
    ranges = near_ranges(first, "disc_id", "duration", TOLERANCE)
    centres = first.withColumn("v", micros("duration")).join(ranges, ["disc_id", "v"])
    best = (
        centres.groupBy("disc_id")
        .agg(F.min_by(F.struct("near", "lo", "hi"), F.struct(-F.col("near"), "title_idx")).alias("_b"))
        .select("disc_id", "_b.*")
        .filter(F.col("near") >= least)
    )
    group = first.join(best.select("disc_id", "lo", "hi"), "disc_id").filter(
        micros("duration").between(F.col("lo"), F.col("hi"))
    )
    longest = group.groupBy("disc_id").agg(F.max("duration").alias("_longest"))
    rivals = (
        titles.filter(~F.col("play_all") & long_enough)
        .join(longest, "disc_id")
        .filter(F.col("duration") >= F.col("_longest") * DWARF_RATIO)
        .select("disc_id", "number")
        .join(group.select("disc_id", "number"), ["disc_id", "number"], "left_anti")
    )
    kept = group.join(rivals.select("disc_id").distinct(), "disc_id", "left_anti")
    return o.ordered(kept, "disc_id", ["number"], episode=o.row_number()).select("disc_id", "title_id", "episode")


def demote_dwarfed(titles: DataFrame) -> DataFrame:
    """Titles without their episode labels on discs where another title dwarfs them."""
    member = F.col("episode").isNotNull() & ~F.col("play_all")
    other = F.col("episode").isNull() & ~F.col("play_all")
    judged = o.with_group(
        titles,
        "disc_id",
        _longest=F.max(F.when(member, F.col("duration"))),
        _rival=F.max(F.when(other, F.col("duration"))),
    )
    drop = member & F.coalesce(F.col("_rival") >= F.col("_longest") * DWARF_RATIO, F.lit(False))
    return judged.withColumns(
        {
            "part": F.when(~drop, F.col("part")),
            "episode": F.when(~drop, F.col("episode")),
        }
    ).drop("_longest", "_rival")


def chain_plan_extras(chains: DataFrame, roles: DataFrame, defaults: DataFrame, group: str, minimum: int = MIN_DURATION) -> DataFrame:
    """Substantial chains of episode sets that are neither episode, play-all nor default."""
    sets = roles.filter(F.col("role") == "episode").select(group).distinct()
    rest = chains.filter(F.col("duration") >= minimum).join(sets, group, "left_semi")
    for other in (roles, defaults):
        rest = rest.join(other.select(group, "pgc"), [group, "pgc"], "left_anti")
    return rest.select(group, "pgc")


def alternate_chains(chains: DataFrame, cells: DataFrame, defaults: DataFrame, group: str = "set_id", minimum: int = MIN_DURATION) -> DataFrame:
    """Substantial chains besides the default, and whether they re-cut it.

    ``is_edition``: at least half of the default's runtime comes from cells the chain
    also plays.
    """
    cells, defaults = cut_lineage(cells), cut_lineage(defaults.select(group, "pgc"))
    others = chains.filter((F.col("duration") >= minimum) & (F.col("n_cells") >= 1)).join(
        defaults.select(group, "pgc"), [group, "pgc"], "left_anti"
    )
    base = cells.join(defaults.select(group, "pgc"), [group, "pgc"], "left_semi")
    rows = cells.join(others.select(group, "pgc"), [group, "pgc"], "left_semi")
    shares = shared_fraction(base, rows, group, "pgc", "cell", "seconds")
    joined = others.select(group, "pgc").join(shares, [group, "pgc"], "left")
    return joined.withColumn("is_edition", F.coalesce(F.col("share") >= SHARED_RUNTIME, F.lit(False))).drop("share")
