"""Mix sources to target weights by filling each source's word budget exactly.

1. Words per text, and a histogram of exact sizes per source.  Everything after this
   step works on histograms: their rows are distinct sizes, not documents.
2. Targets: every source gets its weight's share of the whole budget, held at
   *most_copies* times its own size; what is above is shared again by weight.
3. A source's budget is a subset sum over its histogram, with up to *most_copies* copies of
   each document: each size gives its proportional share, the longest still free close the
   gap down to *exact_words*, and a bounded-knapsack table over the remaining words finds
   counts per size that come nearest, on either side.  A small source whose shares leave no
   exact sum is searched again with less of them settled.
4. Of each size, as many documents as the counts say are chosen by a seeded hash.  Ranks
   are taken inside hash slices and shifted by the slices before, so one source or one
   size with a third of all rows is still spread.

Nulls: a null text has no words, a null source is a source of its own and comes last, a
null key is hashed like a value.  Equal rows are interchangeable.  Empty tables give empty
results.  Very long texts are counted whole.  Columns that are not carried are not read, whatever
they are called; carried ones keep their names.  Of two sums as near, the lower one is taken.
Same rows and seed, same choice.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.llm.common import one_or_more_words, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SLICES = 1024


def water_fill(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of *budget* by weight, none above *most* times its size.

    Sources fill up in the order of what they hold per weight, so one pass over that order
    finds all that are full.
    """
    targets = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, total = budget, sum(weights)
    for at, i in enumerate(order):
        if left * weights[i] / total <= most * sizes[i]:
            for j in order[at:]:
                targets[j] = left * weights[j] / total
            break
        targets[i] = float(most * sizes[i])
        left -= targets[i]
        total -= weights[i]
    return targets


def subset_sum(sizes: np.ndarray, counts: np.ndarray, aim: float, above: int = 0) -> np.ndarray:
    """Counts per size (at most *counts*) whose words come nearest to *aim* (below, of two as near).

    Sums may exceed it by *above*.  One pass per size over the sums: a sum is new if a
    sum reached before lies a whole number of this size below it, and not more of them than
    there are documents.
    """
    taken = np.zeros(len(sizes), dtype=np.int64)
    goal = round(aim)
    top = goal + above
    if goal <= 0:
        return taken
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    by = np.full(top + 1, -1, dtype=np.int64)
    times = np.zeros(top + 1, dtype=np.int64)
    for j in np.argsort(sizes, kind="stable"):
        size, most = int(sizes[j]), int(counts[j])
        if size <= 0 or most <= 0 or size > top:
            continue
        depth = -(-(top + 1) // size)
        flat = np.zeros(depth * size, dtype=bool)
        flat[: top + 1] = reached
        grid = flat.reshape(depth, size)
        step = np.arange(depth)[:, None]
        last = np.maximum.accumulate(np.where(grid, step, -1), axis=0)
        need = np.where(last >= 0, step - last, most + 1).reshape(-1)[: top + 1]
        new = ~reached & (need <= most)
        by[new] = j
        times[new] = need[new]
        reached |= new
        if reached[goal]:
            break
    sums = np.nonzero(reached)[0]
    at = int(sums[np.argmin(np.abs(sums - aim))])
    while at:
        j, k = int(by[at]), int(times[at])
        taken[j] += k
        at -= k * int(sizes[j])
    return taken


#: Parts of the proportional share that are settled before the exact sum, tried in turn.
SETTLED = (1.0, 0.75, 0.5, 0.0)


def copies_by_size(sizes: np.ndarray, counts: np.ndarray, target: float, most: int, exact_words: int) -> np.ndarray:
    """How often each size's documents stand in the mix, *most* times each at most, so that
    their words come nearest to *target*.

    Every size first gets a part of its proportional share; the rest is a subset sum over
    the copies still free.  Where that misses by a word or more, a smaller part is tried, so
    small sources are searched in full and large ones keep their proportions.
    """
    total, goal = int((sizes * counts).sum()), round(target)
    best = np.zeros(len(sizes), dtype=np.int64)
    if goal <= 0 or total == 0:
        return best
    room = np.where(sizes > 0, counts * most, 0)
    miss = None
    for part in SETTLED:
        taken = np.minimum(np.floor(counts * (part * target / total)).astype(np.int64), room)
        left = goal - int((taken * sizes).sum())
        for j in np.argsort(-sizes, kind="stable"):
            if left <= exact_words:
                break
            size = int(sizes[j])
            if size > 0:
                more = min(int(room[j] - taken[j]), left // size, -(-(left - exact_words) // size))
                taken[j] += more
                left -= more * size
        if left > exact_words:
            continue
        taken = taken + subset_sum(sizes, room - taken, target - goal + left, min(int(sizes.max()), exact_words))
        off = abs(int((taken * sizes).sum()) - target)
        if miss is None or off < miss:
            best, miss = taken, off
        if miss < 1:
            break
    return best


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most_copies: float = 2.0,
    seed: int = 7,
    exact_words: int = 50_000,
    carry: list[str] | None = None,
) -> DataFrame:
    """*carry* (the key by default) with ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    One row per row of *docs*.  Sources in code-point order, null last, get *weights* in
    turn.  The whole budget is *share* times the words of all documents; ``taken`` is
    ``copies * size``.
    """
    kept = [key] if carry is None else carry
    payload: Column = F.struct(*[F.col(c) for c in kept]).alias("__kept")
    words = F.regexp_count(text_of(text), F.lit(one_or_more_words)).cast("long")
    rows = docs.select(
        F.col(source).alias("__source"),
        words.alias("__size"),
        F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.xxhash64(text_of(text))).alias("__hash"),
        payload,
    )
    histogram = rows.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("__count"))
    # One row per source, as there is one weight per source.
    totals = histogram.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__count")).alias("n")).collect()
    totals.sort(key=lambda r: (r["__source"] is None, r["__source"]))
    sizes = [int(r["n"]) for r in totals]
    turn = [weights[i % len(weights)] for i in range(len(sizes))]
    targets = water_fill(sizes, turn, share * sum(sizes), most_copies)
    known = T.StructType(
        [
            T.StructField("__name", docs.schema[source].dataType),
            T.StructField("__at", T.IntegerType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
        ]
    )
    listed = [(r["__source"], i, sizes[i], targets[i]) for i, r in enumerate(totals)]
    per_source = docs.sparkSession.createDataFrame(listed, known)

    def with_source(df: DataFrame) -> DataFrame:
        return df.join(per_source, F.col("__source").eqNullSafe(F.col("__name"))).drop("__source", "__name")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        size, count = group["__size"].to_numpy(np.int64), group["__count"].to_numpy(np.int64)
        copies = copies_by_size(size, count, float(group["target"].iloc[0]), math.floor(most_copies), exact_words)
        every, extra = np.divmod(copies, count)
        return pd.DataFrame({"__at": group["__at"], "__size": size, "__every": every, "__extra": extra})

    chosen = (
        with_source(histogram).groupBy("__at").applyInPandas(plan, "__at int, __size long, __every long, __extra long")
    )
    sliced = with_source(rows).withColumn("__slice", F.pmod(F.col("__hash"), F.lit(SLICES)))
    cell = ["__at", "__size", "__slice"]
    before = Window.partitionBy("__at", "__size").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = sliced.groupBy(*cell).agg(F.count(F.lit(1)).alias("__in"))
    cells = cells.join(chosen, ["__at", "__size"]).withColumn(
        "__before", F.coalesce(F.sum("__in").over(before), F.lit(0))
    )
    ranked = sliced.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*cell).orderBy("__hash"))
    )
    copies = F.col("__every") + (F.col("__before") + F.col("__rank") <= F.col("__extra")).cast("long")
    return ranked.join(cells, cell).select(
        *[F.col("__kept")[c].alias(c) for c in kept],
        F.col("__size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("__size")).alias("taken"),
    )
