"""The whole title classification of a catalog, in the order its rules depend on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discframe.operators import sequence as s
from discframe.operators.project import notable_flag, short_label
from discframe.operators.rank import main_feature
from discframe.plans.chains import chain_label, settle_editions, settle_protection
from discframe.plans.episodes import demote_dwarfed, label_cross_set, label_playlist_episodes
from discframe.plans.naming import name_titles
from discframe.plans.packed import Rules, packed_count, packed_episodes
from discframe.session import cut_lineage, cut_result


#: What is read of a title once its chain is settled and listed.
_LATER = frozenset(
    """disc_id title_id title_idx duration n_audio n_sub looped vts chain_pgc episode part play_all number layout
    source_pos playlist_no is_edition was_chain pgc_number remote_main authorial default_edition n_chapters
    keep_name name decoy duplicate notable short_label""".split()
)


@dataclass(frozen=True)
class Thresholds:
    """Limits of the classification; the defaults suit disc catalogs."""

    listed: float = 120
    plain: float = 300
    short: float = 30
    empty_bytes: int = 200_000
    minimum: int = 60
    films: int = 8
    jumps: int = 3
    packed: Rules = Rules()


def classify_catalog(
    titles: DataFrame | Callable[[], DataFrame],
    discs: DataFrame,
    items: DataFrame | None = None,
    marks: DataFrame | None = None,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """Every title with its final index, labels, name and whether it is the main feature.

    Titles carry the facts of ``project.title_facts``, the chain facts of
    ``chains.settle_protection``, ``number`` (logical title), ``source_pos``,
    ``playlist_no``, ``is_edition``, ``pgc_number``, ``remote_main``, ``authorial``,
    ``default_edition``, ``n_chapters``, ``secondary``, ``keep_name`` and ``name``.
    *items* switch playlist episodes on, *marks* packed episodes.

    *titles* may be a function that makes them: the tables it writes are then removed with
    those of the first step.

    Everything is keyed by disc.  Each step writes one table and takes the one before with
    it, so no step is computed twice and what is written at a time does not add up.  The
    result reads *discs* and its own tables only.
    """

    def settled() -> DataFrame:
        hidden = F.col("decoy") | F.col("duplicate") | F.col("secondary")
        chains = titles() if callable(titles) else titles
        listed = settle_protection(chains, limits.films, limits.jumps).withColumns(
            {
                "notable": notable_flag(hidden, limits.listed, limits.plain),
                "short_label": short_label(limits.short, limits.empty_bytes),
            }
        )
        return demote_dwarfed(listed.select(*[c for c in listed.columns if c in _LATER]))

    def crossed() -> DataFrame:
        labelled = cut_result(settled)
        free = F.col("episode").isNull() & ~F.col("play_all") & ~F.col("is_edition")
        found = cut_lineage(
            label_cross_set(labelled, free, limits.minimum).select("title_id", F.col("episode").alias("_cross"))
        )
        return labelled.join(found, "title_id", "left").withColumn("episode", F.coalesce("episode", "_cross")).drop("_cross")

    def listed() -> DataFrame:
        if items is None:
            return crossed()
        ready = cut_result(crossed)
        unlabelled = F.col("episode").isNull() & ~F.col("play_all") & F.col("playlist_no").isNotNull()
        content = F.col("notable") & ~F.col("looped")
        asked = ready.withColumns(
            {"content": content, "candidate": content & unlabelled & (F.col("duration") >= limits.minimum)}
        )
        found = cut_result(
            lambda: label_playlist_episodes(asked, items).select(
                "title_id", F.col("episode").alias("_episode"), F.col("play_all").alias("_all")
            )
        )
        return (
            ready.join(found, "title_id", "left")
            .withColumns(
                {
                    "episode": F.coalesce("episode", "_episode"),
                    "play_all": F.col("play_all") | F.coalesce("_all", F.lit(False)),
                }
            )
            .drop("_episode", "_all")
        )

    def reindexed() -> DataFrame:
        numbered = s.reindex(cut_result(listed), "disc_id", s.listing_keys(F.col("notable")))
        return numbered.withColumn("title_idx", F.col("new_idx")).drop("new_idx")

    ordered = cut_result(reindexed)
    mains = main_feature(ordered, F.col("notable"), limits.minimum)
    editions = settle_editions(ordered, mains).withColumn("edition_label", F.when(F.col("was_chain"), chain_label()))
    if marks is not None:
        long = ordered.filter(F.col("playlist_no").isNotNull())
        packed = cut_result(lambda: packed_count(packed_episodes(marks, long, limits.packed)))
        editions = editions.join(packed, "title_id", "left")
    else:
        editions = editions.withColumn("episodes", F.lit(None).cast("long"))
    named = name_titles(editions.withColumn("packed", F.col("episodes").isNotNull()), discs)
    chosen = mains.select("title_id", F.lit(True).alias("_main"))
    return named.join(chosen, "title_id", "left").select(
        "disc_id",
        "title_id",
        "title_idx",
        "name",
        "notable",
        "decoy",
        "duplicate",
        "episode",
        "part",
        "play_all",
        "edition_no",
        F.col("episodes").alias("packed_episodes"),
        F.coalesce("_main", F.lit(False)).alias("is_main"),
    )
