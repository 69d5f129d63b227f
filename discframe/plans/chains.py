"""Disc-level decisions over program chains: protection and edition labels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discframe.operators import ordered as o

FEATURE_SHARE = 0.5
MIN_FEATURES = 8
MIN_JUMPS = 3
CROSS_SET_CELLS = 3
EDITION_LENGTH_SHARE = 0.10


def settle_protection(chains: DataFrame, features: int = MIN_FEATURES, jumps: int = MIN_JUMPS) -> DataFrame:
    """Chains with ``decoy`` and ``duplicate`` set and hidden ones' labels cleared.

    Chains: ``disc_id, title_id, duration, vts, chain_pgc, backward_jumps, padded,
    n_cells, cells_sig`` (identity of the played cells), ``tracks_sig`` (of the tracks),
    ``episode, part, play_all``.  On discs with many film-length chains, some of them
    straight, chains jumping backwards are decoys.  Equal cells, rounded duration and
    tracks (and title set, for short chains) are duplicates: the exact chain of the title
    set with most exact chains stays, in disc order.

    All of it lies within a disc: chains are dealt by disc once.
    """
    sized = o.with_group(o.together(chains, "disc_id"), "disc_id", _longest=F.max("duration"))
    film = sized.withColumn("_film", F.col("duration") >= F.lit(FEATURE_SHARE) * F.col("_longest"))
    counted = o.with_group(
        film,
        "disc_id",
        _films=F.count_if("_film"),
        _straight=F.bool_or(F.col("_film") & (F.col("backward_jumps") == 0)),
    )
    decoy = F.col("_film") & (F.col("_films") >= features) & F.col("_straight") & (F.col("backward_jumps") >= jumps)
    marked = counted.withColumn("decoy", decoy)
    exact = ~F.col("decoy") & ~F.col("padded")
    by_set = o.with_group(marked, ["disc_id", "vts"], _exact=F.count_if(exact))
    # Chains of no known disc or title set are counted with none.
    known = F.col("disc_id").isNotNull() & F.col("vts").isNotNull()
    joined = by_set.withColumn("_exact", F.when(known, F.col("_exact")))
    scope = F.when(F.col("n_cells") < CROSS_SET_CELLS, F.col("vts"))
    key = ["disc_id", "cells_sig", "_seconds", "tracks_sig", "_scope"]
    kept = joined.withColumns(
        {"_seconds": F.bround("duration").cast("long"), "_scope": F.coalesce(scope.cast("long"), F.lit(-1))}
    )
    rank = F.struct("padded", -F.col("_exact"), "vts", F.coalesce("chain_pgc", F.lit(0)).alias("pgc"), "title_id")
    ranked = kept.withColumn("_rank", F.when(~F.col("decoy"), rank))
    winners = o.with_group(ranked, key, _best=F.min_by("title_id", "_rank"))
    # An unknown part of the key matches nothing.
    matched = reduce(and_, [F.col(c).isNotNull() for c in key])
    judged = winners.withColumn("duplicate", ~F.col("decoy") & matched & (F.col("title_id") != F.col("_best")))
    hidden = F.col("decoy") | F.coalesce("duplicate", F.lit(False))
    return judged.withColumns(
        {
            "duplicate": F.coalesce("duplicate", F.lit(False)),
            "episode": F.when(~hidden, F.col("episode")),
            "part": F.when(~hidden, F.col("part")),
            "play_all": F.col("play_all") & ~hidden,
        }
    ).select(*chains.columns, "decoy", "duplicate")


def settle_editions(titles: DataFrame, mains: DataFrame) -> DataFrame:
    """Titles with ``edition_no`` (versions of the main feature) and ``is_edition`` settled.

    Titles: ``disc_id, title_id, vts, chain_pgc, duration, notable, is_edition, episode,
    play_all``; mains: ``disc_id, title_id`` of the main feature.  Only the main title
    set keeps editions; chains within 10 % of the film join them; a lone one is none.
    Discs with episodes or a play-all keep the main set's flags and number nothing.
    """
    main = mains.join(
        titles.select("title_id", F.col("vts").alias("_main_vts"), F.col("duration").alias("_main")), "title_id"
    ).select("disc_id", "_main_vts", "_main")
    judged = titles.join(main, "disc_id", "left")
    in_main = F.coalesce(F.col("vts") == F.col("_main_vts"), F.lit(False))
    series = o.with_group(
        judged, "disc_id", _series=F.bool_or(F.col("episode").isNotNull() | F.col("play_all"))
    )
    near = F.abs(F.col("duration") - F.col("_main")) <= F.lit(EDITION_LENGTH_SHARE) * F.col("_main")
    version = in_main & ~F.col("_series") & F.col("notable") & (F.col("is_edition") | near)
    flagged = series.withColumns({"_in": in_main, "_version": F.coalesce(version, F.lit(False))})
    counted = o.with_group(flagged, "disc_id", _n=F.count_if("_version"))
    numbered = o.ordered(
        counted.withColumns({"_one": F.col("_version").cast("long"), "_pgc": F.coalesce("chain_pgc", F.lit(0))}),
        "disc_id",
        ["_pgc", "title_id"],
        _no=o.sum_to("_one"),
    )
    settled = F.col("_version") & (F.col("_n") >= 2)
    keeps = F.col("is_edition") & F.col("_in") & ~(F.col("_version") & (F.col("_n") < 2))
    return numbered.withColumns(
        {
            "edition_no": F.when(settled, F.col("_no")),
            "is_edition": settled | keeps,
        }
    ).select(*titles.columns, "edition_no")


def chain_label(edition_no: str = "edition_no", pgc: str = "pgc_number"):
    """``Edition N``, else the neutral ``PGC N``, else NULL."""
    number = F.col(edition_no)
    neutral = F.when(F.col(pgc) > 0, F.concat(F.lit("PGC "), F.col(pgc).cast("string")))
    return F.when(number.isNotNull(), F.concat(F.lit("Edition "), number.cast("string"))).otherwise(neutral)
