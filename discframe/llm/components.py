"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discframe.llm.common import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or the smaller ones) are tied to the least of them.

    The least neighbour is a partial aggregate joined back, so a node with very many
    neighbours stays spread (adaptive skew join).
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = pairs.join(least, "u")
    if small:
        down = met.filter(F.col("v") <= F.col("u"))
        tied = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        tied = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u`` and its root ``v`` (the least node it reaches) for every node but the roots.

    *edges* has two columns of one comparable type, ``u`` and ``v``.  Rounds grow with the
    logarithm of the size (Kiveris et al., 2014); each is written, so a lost executor
    costs a re-read of one round.
    """
    now = cut_lineage(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct())
    while True:
        state = _state(now)
        now = cut_lineage(_star(_both_ways(_star(_both_ways(now), small=False)), small=True))
        if _state(now) == state:
            return now


def _state(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart: their number and a sum of hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
