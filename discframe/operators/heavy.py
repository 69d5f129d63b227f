"""Heavy keys of base tables, found once by a sketch and handed down with their columns.

An ordered operator has to know whether a key may hold more rows than one task should
sort.  Asking its own input would run everything below it once more.  Instead every base
table is sketched once (``approx_top_k``: one pass, a bounded number of counters, partial
results merged), and the answer travels as metadata of the key column: Spark keeps it
through filters, joins, grouping, renaming and written tables.

The number carried is a *peak*: the largest share that one value of the key has in any
table of its domain, in rows of the largest table.  A title with 1 % of the items has 1 % of
whatever is joined to items later.  Peaks choose between two plans with equal results, so
an estimate is enough.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PEAK = "discframe.peak"
#: Counters of a sketch: a key with more than a few ten-thousandths of the rows is found.
COUNTERS = 10_000

Domain = Sequence[tuple[str, str]]


def sketched(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows of *df*, and about how many rows the most frequent value of each column has."""
    tops = [
        F.get(F.call_function("approx_top_k", F.col(c), F.lit(1), F.lit(COUNTERS)), F.lit(0))["count"].alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    row = df.agg(F.count(F.lit(1)).alias("n"), *tops).first()
    return int(row["n"]), {c: int(row[f"c{i}"] or 0) for i, c in enumerate(columns)}


def peaks(tables: Mapping[str, DataFrame], domains: Sequence[Domain]) -> dict[tuple[str, str], int]:
    """The peak of each ``(table, column)`` of the *domains*; one job per table."""
    columns: dict[str, list[str]] = {}
    for domain in domains:
        for name, column in domain:
            columns.setdefault(name, []).append(column)
    known = {name: sketched(tables[name], wanted) for name, wanted in columns.items()}
    out: dict[tuple[str, str], int] = {}
    for domain in domains:
        share = max(known[name][1][column] / max(known[name][0], 1) for name, column in domain)
        # Rows of a domain meet rows of the tables that share a table with it, and so on.
        near = {name for name, _ in domain}
        while True:
            more = near | {name for d in domains if near & {n for n, _ in d} for name, _ in d}
            if more == near:
                break
            near = more
        most = max(known[name][0] for name in near)
        out |= {(name, column): round(share * most) for name, column in domain}
    return out


def marked(df: DataFrame, known: Mapping[str, int]) -> DataFrame:
    """*df* whose columns named in *known* carry their peak."""
    return df.select(
        *[F.col(c).alias(c, metadata=df.schema[c].metadata | {PEAK: known[c]}) if c in known else F.col(c) for c in df.columns]
    )


def mark(tables: Mapping[str, DataFrame], domains: Sequence[Domain]) -> dict[str, DataFrame]:
    """The *tables* with the peaks of their key columns.

    *domains* list the ``(table, column)`` pairs that hold the same keys.
    """
    found = peaks(tables, domains)
    return {name: marked(df, {c: p for (n, c), p in found.items() if n == name}) for name, df in tables.items()}


def keyed(df: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """*df* with the struct *name* of the *key* columns, which carries the peak of those."""
    most = peak(df, key)
    out = df.withColumn(name, F.struct(*key))
    return out if most is None else out.withMetadata(name, {PEAK: most})


def peak(df: DataFrame, key: Sequence[str]) -> int | None:
    """An upper bound of rows per group, if a column of *key* carries one."""
    known = [df.schema[c].metadata.get(PEAK) for c in key if c in df.columns]
    return min((p for p in known if p is not None), default=None)
