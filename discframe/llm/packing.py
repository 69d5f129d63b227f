"""Pack token pieces into sequences: vector best fit, planned on a histogram of lengths.

Every sequence has capacities for tokens, number of pieces and attention cost (by default
the sum of squared lengths).  A piece asks for ``(length, 1, cost(length))``, so pieces of
one length are alike, and a plan needs only how many there are of each length:

1. ``pieces``: texts to ids; a text longer than the limit is cut into pieces of the limit,
   the first of which may be shorter.
2. ``plan``: lengths in falling order.  Open sequences of equal residual capacities form a
   group; each length goes to the group with room under every constraint whose weighted
   residual norm after placing is least (``score="norm"``) or whose weighted dot product of
   residual and demand is greatest (``score="dot"``), and opens new sequences if there is
   none.  A whole group is filled at a time, so work and result follow the number of distinct
   lengths (at most the limit), not that of texts.
3. ``place``: pieces of a length are numbered (inside hash slices, shifted by the slices
   before, so that a length with a third of all pieces is spread) and read their sequence
   and offset from the plan.

A null or empty text has the closing id alone.  Equal rows are pieces of their own and
interchangeable.  Very long texts are encoded whole and cut; an empty table gives no rows.
Columns not named are not read, whatever they are called; carried ones keep their names,
but for ``piece start length ids sequence_id offset``, and have to be sortable.  Ties (equal residuals) go to the
group opened first.  The same rows give the same plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.llm.common import cut_lineage, id_field
from discframe.llm.vocabularies import byte_level, crc_of

SLICES = 4096


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights of tokens, pieces and cost in the score.

    Without *pieces* and *cost* these two never bind: a piece has a token at least, and
    squares of lengths add up to no more than the square of the sum.
    """

    tokens: int = 2048
    pieces: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces or self.tokens, self.cost or self.tokens**2], np.int64)


def squared(length: int) -> int:
    return length * length


def pieces(
    docs: DataFrame,
    path: str,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    *,
    limit: int = 2048,
    closing: int = 0,
    carry_ids: bool = True,
) -> DataFrame:
    """*key*, ``piece``, ``start``, ``length``, ``ids_crc32`` and the ``ids`` (if *carry_ids*) of every piece.

    *path* is a byte-level file of the ``tokenizers`` library that every worker can read;
    each text's ids are followed by *closing*.
    """
    fields = [
        id_field(docs, key),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if carry_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = [f.name for f in fields]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = byte_level(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row: list[int] = []
                out: list[list] = [[], [], [], [], []]
                for i, value in enumerate(batch.column(1)):
                    ids = [*known.ids(value.as_py() or ""), closing]
                    start, number = 0, 0
                    stop = len(ids) % limit or limit
                    while start < len(ids):
                        part = ids[start:stop]
                        row.append(i)
                        for column, v in zip(out, (number, start, len(part), crc_of(part), part)):
                            column.append(v)
                        number, start, stop = number + 1, stop, stop + limit
                columns = [batch.column(0).take(pa.array(row, pa.int64()))]
                columns += [pa.array(c, t) for c, t in zip(out, types[1:])]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return docs.select(key, text).mapInArrow(encode, T.StructType(fields))


@dataclass
class Plan:
    """Rows ``length, rank, sequence, count, each, offset``: the pieces of a length from
    *rank* on fill *count* sequences from *sequence* on, *each* into one, from *offset* on."""

    rows: np.ndarray
    sequences: int


def plan(
    lengths: np.ndarray, counts: np.ndarray, limits: Limits, cost: Callable[[int], int] = squared
) -> Plan:
    """Sequences for *counts* pieces of each of the *lengths*, none above the limits."""
    capacity, weights = limits.capacity, np.array(limits.weights)
    # Groups of sequences with equal residuals: residual vector, first sequence, how many.
    left = np.zeros((64, 3), np.int64)
    first, many = np.zeros(64, np.int64), np.zeros(64, np.int64)
    used = opened = 0
    rows: list[tuple[int, ...]] = []

    def add(residual: np.ndarray, start: int, count: int):
        nonlocal left, first, many, used
        if count == 0 or residual[0] == 0 or residual[1] == 0:
            return
        if used == len(many):
            keep = many[:used] > 0
            size = max(64, 2 * int(keep.sum()))
            grown = np.zeros((size, 3), np.int64)
            grown[: keep.sum()] = left[:used][keep]
            moved, counted = np.zeros(size, np.int64), np.zeros(size, np.int64)
            moved[: keep.sum()], counted[: keep.sum()] = first[:used][keep], many[:used][keep]
            left, first, many, used = grown, moved, counted, int(keep.sum())
        left[used], first[used], many[used] = residual, start, count
        used += 1

    def fill(length: int, demand: np.ndarray, rank: int, n: int, residual: np.ndarray, start: int, count: int, each: int) -> int:
        """*n* pieces into the sequences from *start* on; how many found a place."""
        full = min(count, n // each)
        offset = int(capacity[0] - residual[0])
        if full:
            rows.append((length, rank, start, full, each, offset))
            add(residual - each * demand, start, full)
        placed, rest = full * each, 0
        if full < count and n - placed:
            rest = n - placed
            rows.append((length, rank + placed, start + full, 1, rest, offset))
            add(residual - rest * demand, start + full, 1)
        done = full + (rest > 0)
        add(residual, start + done, count - done)
        return placed + rest

    for at in np.argsort(-lengths, kind="stable"):
        length, n, rank = int(lengths[at]), int(counts[at]), 0
        demand = np.array([length, 1, cost(length)], np.int64)
        if (demand > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds the limits of a sequence")
        while n:
            room = (many[:used] > 0) & (left[:used] >= demand).all(axis=1)
            if room.any():
                open_ = np.flatnonzero(room)
                if limits.score == "dot":
                    worth = -((left[open_] / capacity) * (demand / capacity)) @ weights
                else:
                    worth = (((left[open_] - demand) / capacity) ** 2) @ weights
                g = open_[int(np.argmin(worth))]
                residual, start, count = left[g].copy(), int(first[g]), int(many[g])
                many[g] = 0
                # By the norm, the sequence just filled is the best one for the next piece, too.
                each = 1 if limits.score == "dot" else int(min(residual // np.maximum(demand, 1)))
            else:
                # Enough new sequences for all that is left of this length.
                each = int(min(capacity // np.maximum(demand, 1)))
                residual, start, count = capacity.copy(), opened, -(-n // each)
                opened += count
            put = fill(length, demand, rank, n, residual, start, count, each)
            rank, n = rank + put, n - put
    return Plan(np.array(rows, np.int64).reshape(-1, 6), opened)


def place(df: DataFrame, limits: Limits = Limits(), cost: Callable[[int], int] = squared, length: str = "length") -> DataFrame:
    """*df* (rows with a *length* from 1 to the limit) with ``sequence_id`` and ``offset``.

    *df* is read three times and should be a written table.
    """
    counted = df.groupBy(F.col(length).alias("n")).count().toArrow()
    made = plan(counted["n"].to_numpy().astype(np.int64), counted["count"].to_numpy().astype(np.int64), limits, cost)
    rows = made.rows[np.lexsort((made.rows[:, 1], made.rows[:, 0]))]
    names = df.columns
    order = F.xxhash64(*names)
    sliced = df.withColumn("__hash", order).withColumn("__slice", F.pmod("__hash", F.lit(SLICES)))
    before = Window.partitionBy("__length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        sliced.groupBy(F.col(length).alias("__length"), "__slice")
        .agg(F.count(F.lit(1)).alias("__in"))
        .select("__length", F.col("__slice").alias("__cell"), F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy(length, "__slice").orderBy("__hash", *names)
    ranked = (
        sliced.withColumn("__rank", F.row_number().over(within) - F.lit(1))
        .join(cells, (F.col(length) == F.col("__length")) & (F.col("__slice") == F.col("__cell")))
        .select(*names, (F.col("__rank") + F.col("__before")).alias("__rank"))
    )
    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length = names.index(length)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The ranks of all lengths one behind the other, so that one search finds the row.
        ends = np.zeros(int(limits.tokens) + 2, np.int64)
        np.add.at(ends, rows[:, 0] + 1, rows[:, 3] * rows[:, 4])
        base = np.cumsum(ends)
        starts = base[rows[:, 0]] + rows[:, 1]
        for batch in batches:
            size = batch.column(at_length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            found = rows[np.searchsorted(starts, base[size] + rank, side="right") - 1]
            step = rank - found[:, 1]
            each = found[:, 4]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pa.array(found[:, 2] + step // each, pa.int64()),
                    pa.array(found[:, 5] + step % each * size, pa.int64()),
                ],
                schema.names,
            )

    return ranked.mapInArrow(look_up, schema)


def packed(
    docs: DataFrame,
    path: str,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    *,
    limits: Limits = Limits(),
    closing: int = 0,
    carry_ids: bool = True,
) -> DataFrame:
    """``pieces`` of *docs*, each with its ``sequence_id`` and ``offset``."""
    cut = pieces(docs, path, pattern, key, text, limit=limits.tokens, closing=closing, carry_ids=carry_ids)
    return place(cut_lineage(cut), limits)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id``, its ``ids`` in order and the ``starts`` of its pieces; at most a limit of ids per group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts")
    )
