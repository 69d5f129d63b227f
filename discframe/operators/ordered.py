"""Ordered window functions that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  ``ordered``
keeps that plan while every group is small (one shuffle, nothing else) and changes
to a two-level plan when a group exceeds the limit:

1. whether a key is hot is known from a sketch of the base tables (``operators.heavy``); hot
   keys and the range of their order column come from one partial aggregate;
2. rows of a hot key get a block number by an equal-width split of that range, so
   blocks follow the order and the split is a pure function of the data;
3. windows run inside ``(key, block)``;
4. a summary with one row per ``(hot key, block)`` carries sums, edges and fills
   across blocks and is joined back.

The hot-key table has at most ``rows / limit`` rows and the block summary about
twice that; whether they are broadcast is left to the planner, which sees their size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discframe.operators import heavy
from discframe.session import cut_lineage, group_rows

_memo: dict[tuple, bool] = {}


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class Fn:
    """One ordered function: ``kind`` and the column it reads."""

    kind: str
    expr: Column | None = None


def lag(expr: str | Column) -> Fn:
    return Fn("lag", _col(expr))


def lead(expr: str | Column) -> Fn:
    return Fn("lead", _col(expr))


def row_number() -> Fn:
    """1-based position of the row in its group."""
    return Fn("row_number")


def sum_to(expr: str | Column) -> Fn:
    """Running sum including the row."""
    return Fn("sum_to", _col(expr))


def sum_before(expr: str | Column) -> Fn:
    """Running sum of the rows before, 0 for the first."""
    return Fn("sum_before", _col(expr))


def max_to(expr: str | Column) -> Fn:
    return Fn("max_to", _col(expr))


def max_before(expr: str | Column) -> Fn:
    return Fn("max_before", _col(expr))


def max_from(expr: str | Column) -> Fn:
    """Maximum over the row and everything after it."""
    return Fn("max_from", _col(expr))


def last_to(expr: str | Column) -> Fn:
    """Latest non-null value up to and including the row."""
    return Fn("last_to", _col(expr))


def last_before(expr: str | Column) -> Fn:
    return Fn("last_before", _col(expr))


def next_after(expr: str | Column) -> Fn:
    """First non-null value after the row."""
    return Fn("next_after", _col(expr))


def has_hot_group(df: DataFrame, key: list[str], limit: int) -> bool:
    """Whether a group may have more than *limit* rows.

    Columns that carry a peak (``operators.heavy``) answer without a job.  Keys made on the
    way carry none: for those rows are counted, and only a table of more than *limit* rows
    is counted by key.  The answer chooses between two plans with equal results.
    """
    most = heavy.peak(df, key)
    if most is not None:
        return most > limit
    keys = df.select(*key)
    tag = (df.sparkSession.sparkContext.applicationId, keys.semanticHash(), tuple(key), limit)
    if tag not in _memo:
        size = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
        _memo[tag] = keys.count() > limit and not size.filter(F.col("__n") > limit).isEmpty()
    return _memo[tag]


def _number(df: DataFrame, column: Column) -> Column:
    kind = dict(df.select(column.alias("v")).dtypes)["v"]
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if kind == "string":
        # The first six bytes as one number: the order of UTF-8 strings.
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return column.cast("double")


def with_blocks(
    df: DataFrame, key: list[str], block_on: list[Column], limit: int, name: str = "__blk"
) -> DataFrame:
    """Add *name*: 0 for normal groups, an order-preserving block number for hot ones.

    *block_on* is a prefix of the row order; several columns combine as digits of one
    number whose bases are their ranges inside the hot group.  NULL sorts lowest, as in
    the windows.  ``__hot`` tells hot groups apart.
    """
    digits = [_number(df, c) for c in block_on]
    names = [f"__v{i}" for i in range(len(digits))]
    bounds = []
    for n in names:
        bounds += [F.min(n).alias(f"{n}lo"), F.max(n).alias(f"{n}hi")]
    hot = (
        df.select(*key, *[d.alias(n) for d, n in zip(digits, names)])
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("__n"), *bounds)
        .filter(F.col("__n") > limit)
    )
    value, span = F.lit(0.0), F.lit(1.0)
    for digit, n in zip(digits, names):
        base = F.coalesce(F.col(f"{n}hi") - F.col(f"{n}lo"), F.lit(0.0)) + 1.0
        low = F.coalesce(F.col(f"{n}lo"), F.lit(0.0))
        # Later columns count only while the number stays exact, so blocks follow the order.
        exact = span * base < F.lit(float(1 << 52))
        value = F.when(exact, value * base + F.coalesce(digit - low, F.lit(0.0))).otherwise(value)
        span = F.when(exact, span * base).otherwise(span)
    blocks = F.ceil(F.col("__n") * 2 / F.lit(limit)).cast("double")
    spot = F.least(blocks - 1, F.floor(value * blocks / span))
    drops = ["__n", *[f"{n}{end}" for n in names for end in ("lo", "hi")]]
    return (
        df.join(hot, key, "left")
        .withColumn(name, F.coalesce(spot.cast("long"), F.lit(0).cast("long")))
        .withColumn("__hot", F.col("__n").isNotNull())
        .drop(*drops)
    )


_WINDOW_FRAME = {
    "sum_to": ("sum", Window.unboundedPreceding, 0),
    "sum_before": ("sum", Window.unboundedPreceding, -1),
    "max_to": ("max", Window.unboundedPreceding, 0),
    "max_before": ("max", Window.unboundedPreceding, -1),
    "max_from": ("max", 0, Window.unboundedFollowing),
    "last_to": ("last", Window.unboundedPreceding, 0),
    "last_before": ("last", Window.unboundedPreceding, -1),
    "next_after": ("first", 1, Window.unboundedFollowing),
}


def _local(fn: Fn, window) -> Column:
    if fn.kind == "row_number":
        return F.row_number().over(window)
    if fn.kind == "lag":
        return F.lag(fn.expr, 1).over(window)
    if fn.kind == "lead":
        return F.lead(fn.expr, 1).over(window)
    agg, low, high = _WINDOW_FRAME[fn.kind]
    frame = window.rowsBetween(low, high)
    if agg == "last":
        return F.last(fn.expr, ignorenulls=True).over(frame)
    if agg == "first":
        return F.first(fn.expr, ignorenulls=True).over(frame)
    result = getattr(F, agg)(fn.expr).over(frame)
    if fn.kind == "sum_before":
        # The empty frame of the first row sums to 0.
        result = F.coalesce(result, fn.expr - fn.expr, F.lit(0))
    return result


def _summary(fn: Fn, name: str, order: list[Column]) -> Column:
    """What one block tells its neighbours about *fn*."""
    spot = F.struct(*order)
    if fn.kind == "row_number":
        return F.count(F.lit(1)).alias(name)
    if fn.kind == "lag":
        return F.max_by(F.struct(fn.expr.alias("x")), spot).alias(name)
    if fn.kind == "lead":
        return F.min_by(F.struct(fn.expr.alias("x")), spot).alias(name)
    if fn.kind.startswith("sum"):
        return F.sum(fn.expr).alias(name)
    if fn.kind.startswith("max"):
        return F.max(fn.expr).alias(name)
    known = F.when(fn.expr.isNotNull(), spot)
    if fn.kind.startswith("last"):
        return F.max_by(fn.expr, known).alias(name)
    return F.min_by(fn.expr, known).alias(name)


def _carry(fn: Fn, name: str, key: list[str]) -> Column:
    window = Window.partitionBy(*key).orderBy("__blk")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    after = window.rowsBetween(1, Window.unboundedFollowing)
    if fn.kind == "lag":
        return F.lag(name, 1).over(window)
    if fn.kind == "lead":
        return F.lead(name, 1).over(window)
    if fn.kind == "row_number" or fn.kind.startswith("sum"):
        return F.sum(name).over(before)
    if fn.kind == "max_from":
        return F.max(name).over(after)
    if fn.kind.startswith("max"):
        return F.max(name).over(before)
    if fn.kind.startswith("last"):
        return F.last(name, ignorenulls=True).over(before)
    return F.first(name, ignorenulls=True).over(after)


def _combine(fn: Fn, name: str) -> Column:
    local, carry = F.col(name), F.col(f"__c_{name}")
    if fn.kind == "lag":
        return F.when(F.col("__first") & carry.isNotNull(), carry["x"]).otherwise(local)
    if fn.kind == "lead":
        return F.when(F.col("__last") & carry.isNotNull(), carry["x"]).otherwise(local)
    if fn.kind == "row_number":
        return (local + F.coalesce(carry, F.lit(0))).cast("int")
    if fn.kind.startswith("sum"):
        return F.coalesce(local + carry, local, carry)
    if fn.kind.startswith("max"):
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def _exact_sums(df: DataFrame, outputs: dict[str, Fn]) -> tuple[dict[str, Fn], Callable[[DataFrame], DataFrame]]:
    """Running sums of fractions as decimals, so that they do not depend on how groups are cut.

    Fractions count in billionths; the returned function makes the sums doubles again.
    """
    sums = {n: f for n, f in outputs.items() if f.kind.startswith("sum")}
    kinds = dict(df.select(*[f.expr.alias(n) for n, f in sums.items()]).dtypes) if sums else {}
    real = [n for n, kind in kinds.items() if kind in ("double", "float")]
    exact = {n: Fn(f.kind, f.expr.try_cast("decimal(28,9)")) if n in real else f for n, f in outputs.items()}

    def back(out: DataFrame) -> DataFrame:
        return out.withColumns({n: F.col(n).cast("double") for n in real}) if real else out

    return exact, back


def ordered(
    df: DataFrame,
    key: str | list[str],
    order: list[str | Column],
    *,
    block_on: list[str | Column] | None = None,
    limit: int | None = None,
    **outputs: Fn,
) -> DataFrame:
    """*df* plus one column per entry of *outputs*, evaluated along *order* in *key*.

    *order* is ascending and must identify a row inside its group for functions that
    depend on it.  *block_on* (default: the first order column) is the prefix of the
    order that hot groups are split by.
    """
    key = [key] if isinstance(key, str) else list(key)
    columns = [_col(c) for c in order]
    limit = limit or group_rows(df.sparkSession)
    outputs, back = _exact_sums(df, outputs)
    if not has_hot_group(df, key, limit):
        window = Window.partitionBy(*key).orderBy(*columns)
        return back(df.withColumns({n: _local(f, window) for n, f in outputs.items()}))

    # Rows and block summary both read the split rows: write them once.
    split = cut_lineage(with_blocks(df, key, [_col(c) for c in block_on or order[:1]], limit))
    window = Window.partitionBy(*key, "__blk").orderBy(*columns)
    summary = (
        split.filter("__hot")
        .groupBy(*key, "__blk")
        .agg(*[_summary(f, f"__s_{n}", columns) for n, f in outputs.items()])
    )
    carried = summary.select(
        *key, "__blk", *[_carry(f, f"__s_{n}", key).alias(f"__c_{n}") for n, f in outputs.items()]
    )
    rows = split.withColumns(
        {
            **{n: _local(f, window) for n, f in outputs.items()},
            "__first": F.row_number().over(window) == 1,
            "__last": F.lead(F.lit(1), 1).over(window).isNull(),
        }
    )
    joined = rows.join(carried, [*key, "__blk"], "left")
    done = joined.withColumns({n: _combine(f, n) for n, f in outputs.items()})
    return back(done.select(*df.columns, *outputs))


def together(df: DataFrame, key: str | list[str], limit: int | None = None) -> DataFrame:
    """*df* dealt by *key*, so that windows and groups by *key* and more columns need no shuffle of their own.

    Unchanged where a group may be hot: those are cut into blocks, each dealt by itself.
    """
    key = [key] if isinstance(key, str) else list(key)
    if has_hot_group(df, key, limit or group_rows(df.sparkSession)):
        return df
    return df.repartition(*key)


def with_group(
    df: DataFrame, key: str | list[str], limit: int | None = None, **aggregates: Column
) -> DataFrame:
    """*df* plus per-group aggregates on every row.

    Small groups use a window; a hot group is pre-aggregated and joined back, so its
    rows stay spread (adaptive skew join splits the large side).
    """
    key = [key] if isinstance(key, str) else list(key)
    limit = limit or group_rows(df.sparkSession)
    if not has_hot_group(df, key, limit):
        window = Window.partitionBy(*key)
        return df.withColumns({n: a.over(window) for n, a in aggregates.items()})
    rows = cut_lineage(df)
    totals = rows.groupBy(*key).agg(*[a.alias(n) for n, a in aggregates.items()])
    return rows.join(totals, key, "left").select(*df.columns, *aggregates)


def first_rows(
    df: DataFrame, key: str | list[str], order: list[str | Column], count: int = 1
) -> DataFrame:
    """The first *count* rows per group.

    ``row_number() <= n`` is pruned before the shuffle (window group limit), so a hot
    group costs ``n`` rows per map task.
    """
    key = [key] if isinstance(key, str) else list(key)
    window = Window.partitionBy(*key).orderBy(*[_col(c) for c in order])
    ranked = df.withColumn("__rank", F.row_number().over(window))
    return ranked.filter(F.col("__rank") <= count).drop("__rank")
