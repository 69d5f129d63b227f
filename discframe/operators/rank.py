"""Ranking: the main feature and top-n lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discframe.operators import ordered as o

MIN_DURATION = 60.0


def main_feature(titles: DataFrame, notable: Column, minimum: float = MIN_DURATION) -> DataFrame:
    """One title per disc: the largest lexicographic score, the first one among equals.

    Score: catalog says main movie, author says so, audio + subtitle count, default
    edition, chapters, lowest playlist number, duration; titles under *minimum* score
    below all others.  Listed titles (and catalog main movies) compete, or all titles of
    a disc without any.
    """
    counts = F.col("duration") >= minimum
    competes = F.coalesce(notable | F.col("remote_main"), F.lit(False))
    keys = [
        F.col("remote_main").cast("int"),
        F.col("authorial").cast("int"),
        F.col("n_audio") + F.col("n_sub"),
        F.col("default_edition").cast("int"),
        F.col("n_chapters"),
        -F.coalesce(F.col("playlist_no"), F.lit(0)),
        F.col("duration"),
    ]
    # min_by over negated keys in one partial aggregate; no window, no sort per disc.
    rank = F.struct(
        (~competes).alias("out"), (~counts).alias("short"),
        *[F.when(counts, -k).alias(f"k{i}") for i, k in enumerate(keys)], "title_idx",
    )
    return titles.groupBy("disc_id").agg(F.min_by("title_id", rank).alias("title_id"))


def top_n(df: DataFrame, key: str, order: list[str | Column], count: int) -> DataFrame:
    return o.first_rows(df, key, order, count)
