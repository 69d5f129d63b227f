"""Shards of bounded size by extendible hashing.

A shard is a prefix of the hash bits.  The directory starts with one shard; a shard above
its byte limit, and only such a shard, is split on the next bit until every shard fits.
All splits of up to :data:`STEP` bits come from one aggregate: bytes per fine cell (a
prefix of all these bits), summed up to every shorter prefix.  A row's shard is the
shortest prefix on its path whose bytes fit.  Rows of cells that are still too large take
another round with more bits; that number of rounds follows the largest cell, not the rows.

The hash is of key and text, so it is even whatever the keys are.  Rows that agree in all
:data:`BITS` bits (equal rows, or one text above the limit) cannot be told apart by bits:
they go to overflow pages of the same prefix, filled in turn; a single row above the limit
has a page of its own.

Nulls: a null text has no bytes, a null key hashes as an empty one.  An empty table has no
shards.  A very long text is hashed whole.  Columns that are not carried are not read; a carried
one may not be called ``shard``, ``depth``, ``page`` or ``n_bytes``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discframe.llm.common import cut_lineage, text_of

BITS = 60
STEP = 20


def hash_bits(key: str, text: str) -> Column:
    """The leading :data:`BITS` bits of a digest of key and text, as a long."""
    whole = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), text_of(text))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column | str, depth: Column | int) -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def _split(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Per cell of *high* bits: the depth in (low, high] of the shortest prefix that fits.

    Null where the cell itself is too large.
    """
    cells = rows.groupBy(_prefix("__bits", high).alias("__cell")).agg(F.sum("__bytes").alias("b"))
    depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d")
    paths = cells.select("__cell", "b", depth).withColumn(
        "p", F.call_function("shiftright", F.col("__cell"), (F.lit(high) - F.col("d")).cast("int"))
    )
    fits = paths.groupBy("d", "p").agg(F.sum("b").alias("b")).filter(F.col("b") <= limit)
    return paths.drop("b").join(fits, ["d", "p"], "left").groupBy("__cell").agg(
        F.min(F.when(F.col("b").isNotNull(), F.col("d"))).alias("__depth")
    )


def shard(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, limit: int, carry: list[str] | None = None
) -> DataFrame:
    """*carry* (the key by default) with ``shard``, ``depth``, ``page`` and ``n_bytes``.

    ``shard`` is the prefix as a string of 0 and 1 (empty: the whole table is one shard).
    """
    kept = [key] if carry is None else carry
    rows = docs.select(
        hash_bits(key, text).alias("__bits"),
        F.octet_length(text_of(text)).cast("long").alias("__bytes"),
        F.struct(*[F.col(c) for c in kept]).alias("__kept"),
    )
    total = rows.agg(F.sum("__bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(STEP, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    done: list[DataFrame] = []
    rest = rows
    while True:
        depth = _split(rest, low, high, limit)
        if high < BITS:
            depth = cut_lineage(depth)
        found = rest.withColumn("__cell", _prefix("__bits", high)).join(depth, "__cell").drop("__cell")
        more = high < BITS and not depth.filter(F.col("__depth").isNull()).isEmpty()
        done.append(found.filter(F.col("__depth").isNotNull()) if more or high == BITS else found)
        if not more:
            break
        rest = found.filter(F.col("__depth").isNull()).drop("__depth")
        low, high = high + 1, min(BITS, high + STEP)
    placed = done[0].withColumn("__page", F.lit(0).cast("long"))
    for part in done[1:]:
        placed = placed.unionByName(part.withColumn("__page", F.lit(0).cast("long")))
    if high == BITS:
        tied = Window.partitionBy("__bits")
        fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("__bytes").over(tied), F.lit(1))))
        page = F.floor((F.row_number().over(tied.orderBy("__bytes")) - 1) / fit)
        same = found.filter(F.col("__depth").isNull()).drop("__depth").withColumn("__page", page.cast("long"))
        placed = placed.unionByName(same.withColumn("__depth", F.lit(BITS)), allowMissingColumns=True)
    bits = F.lpad(F.bin(_prefix("__bits", F.col("__depth"))), F.col("__depth"), F.lit("0"))
    return placed.select(
        *[F.col("__kept")[c].alias(c) for c in kept],
        F.when(F.col("__depth") == 0, F.lit("")).otherwise(bits).alias("shard"),
        F.col("__depth").cast("long").alias("depth"),
        F.col("__page").alias("page"),
        F.col("__bytes").alias("n_bytes"),
    )


def directory(shards: DataFrame) -> DataFrame:
    """The directory: one row per slot of the deepest shard's bits, and the shard it names.

    A shard of depth ``d`` fills ``2 ** (deepest - d)`` slots that follow one another.
    """
    named = shards.select("shard", "depth").distinct()
    deepest = named.agg(F.max("depth").alias("d")).first()["d"] or 0
    first = F.coalesce(F.conv(F.col("shard"), 2, 10).cast("long"), F.lit(0))
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(deepest) - F.col("depth")).cast("int"))
    return named.select(
        F.explode(F.sequence(first * span, (first + 1) * span - 1)).alias("slot"), "shard", "depth"
    )
