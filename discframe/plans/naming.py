"""Disc naming, catalog names, and the choice of titles to rip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discframe.functions import text as x
from discframe.operators import ordered as o
from discframe.operators.joins import correlate_titles, match_discs


def name_titles(titles: DataFrame, discs: DataFrame) -> DataFrame:
    """Titles with ``name`` by the label ladder of their disc.

    Discs: ``disc_id, disc_name, source_name, parent_name``; titles: ``disc_id, title_id,
    name`` (scanned), ``keep_name, episode, part, play_all, packed, decoy, duplicate,
    short_label, edition_label``.  Without a disc name the cleaned source name serves; a
    disc with neither keeps its names.
    """
    cleaned = x.clean_release_name(F.col("source_name"))
    named = discs.withColumn("_disc", F.coalesce(F.nullif("disc_name", F.lit("")), F.nullif(cleaned, F.lit(""))))
    series = x.parse_series(F.array("_disc", "source_name", "parent_name"))
    known = named.withColumn("_s", series).select("disc_id", "_disc", "_s")
    facts = o.with_group(
        titles,
        "disc_id",
        _top=F.max(F.coalesce("episode", F.lit(0))),
        _series=F.bool_or(F.col("episode").isNotNull() | F.col("play_all") | F.col("packed")),
    ).join(known, "disc_id", "left")
    show = x.series_name(F.col("_s.show"), F.col("_s.season"), F.col("_s.disc"), F.col("_disc"))
    base = F.when(F.col("_series"), show).otherwise(F.col("_disc"))
    width = F.length(F.greatest(F.col("_top"), F.lit(1)).cast("string"))

    def labelled(label):
        return F.concat(base, F.lit(" - "), label)

    name = (
        F.when(F.col("_disc").isNull() | F.col("keep_name"), F.col("name"))
        .when(
            F.col("episode").isNotNull(),
            x.episode_title(show, F.col("episode"), width, F.coalesce("part", F.lit(""))),
        )
        .when(F.col("play_all"), x.play_all_title(show))
        .when(F.col("decoy"), labelled(F.lit("Decoy")))
        .when(F.col("duplicate"), labelled(F.lit("Duplicate")))
        .when(F.col("short_label").isNotNull(), labelled(F.col("short_label")))
        .when(F.col("edition_label").isNotNull(), labelled(F.col("edition_label")))
        .otherwise(base)
    )
    return facts.withColumn("name", name).select(*titles.columns)


def apply_catalog(
    titles: DataFrame, keys: DataFrame, local_ids: DataFrame, remote_ids: DataFrame, remote_titles: DataFrame
) -> DataFrame:
    """Titles overlaid with the matched catalog entry's name, kind, season and episode.

    Remote titles: ``remote_id, remote_title, source_key, duration, filename, item_type,
    season, episode``.  Only uniquely matched discs and uniquely correlated titles
    change; ``remote_main`` marks the catalog's main movie.
    """
    matched = match_discs(local_ids, remote_ids).filter(F.col("remote_id").isNotNull()).select("disc_id", "remote_id")
    offered = remote_titles.join(matched, "remote_id")
    pairs = correlate_titles(
        titles.select("disc_id", "title_id", "duration"),
        keys,
        offered.select("disc_id", "remote_title", F.lower("source_key").alias("source_key"), "duration"),
    )
    stem = F.regexp_replace(F.regexp_extract("filename", "[^/]*$", 0), r"(?<=.)\.[^.]+$", "")
    details = offered.select(
        "disc_id", "remote_title", F.nullif(stem, F.lit("")).alias("_name"), "item_type", "season", F.col("episode").alias("catalog_episode")
    )
    found = pairs.join(details, ["disc_id", "remote_title"])
    joined = titles.join(found.drop("disc_id"), "title_id", "left")
    return joined.withColumns(
        {
            "name": F.coalesce("_name", F.col("name")),
            "remote_main": F.coalesce(F.col("item_type") == "MainMovie", F.lit(False)),
        }
    ).drop("_name")


def rip_set(titles: DataFrame, mains: DataFrame) -> DataFrame:
    """All episodes of a disc that has any, else its main feature."""
    is_episode = F.col("episode").isNotNull() & ~F.col("play_all")
    judged = o.with_group(titles.withColumn("_e", is_episode), "disc_id", _any=F.bool_or("_e"))
    chosen = judged.join(mains.select("title_id").withColumn("_main", F.lit(True)), "title_id", "left")
    return chosen.filter(F.when(F.col("_any"), F.col("_e")).otherwise(F.coalesce("_main", F.lit(False)))).select(
        "disc_id", "title_id", F.col("_any").alias("series")
    )
