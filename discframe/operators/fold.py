"""Exact folds for true recurrences (the next state needs the previous *output*).

Rows are hash-partitioned by key, sorted, and streamed through a small Python step
function batch by batch; a group is never held in memory.  A group above the row
limit is cut into ordered blocks that run in parallel: every block first runs from
an unknown start state, then only blocks whose true incoming state differs from the
one they used run again, until nothing changes.  At that fixpoint every block used
its predecessor's real end state, so the result equals the sequential fold.

Recurrences whose steps compose do without rounds: given a :class:`Summary`, every block is
summed up as a function from its incoming to its outgoing state, one row per block is
walked along each key, and every block runs once from its true start.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.operators.ordered import _col, has_hot_group, with_blocks
from discframe.session import cut_lineage, group_rows

# step(state or None, *values) -> (state, outputs); both plain tuples of JSON types.
Step = Callable[..., tuple[tuple, tuple]]


class Summary:
    """What a block of rows does to any state that enters it."""

    def extend(self, *values) -> None:
        """Adds the next row."""
        raise NotImplementedError

    def dumps(self) -> str:
        raise NotImplementedError

    @staticmethod
    def leave(text: str, state: tuple | None) -> tuple:
        """The state behind a block (as ``dumps`` wrote it) that *state* enters."""
        raise NotImplementedError


_ARROW = {
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.DoubleType(): pa.float64(),
    T.BooleanType(): pa.bool_(),
    T.StringType(): pa.string(),
}


def _lists(batch: pa.RecordBatch, names: list[str]) -> list[tuple]:
    return list(zip(*[batch.column(n).to_pylist() for n in names]))


def _stream(
    step: Step,
    key: list[str],
    read: list[str],
    outputs: list[tuple[str, T.DataType]],
    states: pa.Schema | None,
):
    """Batch function running *step* along sorted groups.

    Emits every row with its outputs, or (given *states*) one end state per group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, entered = None, None, None
        for batch in batches:
            starts = batch.column("__in").to_pylist()
            produced, ended = [], []
            for group, row, start in zip(_lists(batch, key), _lists(batch, read), starts):
                if group != current:
                    if current is not None and states is not None:
                        ended.append((*current, entered, json.dumps(state)))
                    current, entered = group, start
                    state = tuple(json.loads(start)) if start else None
                state, out = step(state, *row)
                produced.append(out)
            if states is not None:
                yield _rows(ended, states)
                continue
            names = [n for n in batch.schema.names if n != "__in"]
            columns = list(zip(*produced)) if produced else [()] * len(outputs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(columns[i], _ARROW[t]) for i, (_, t) in enumerate(outputs)],
                names=names + [n for n, _ in outputs],
            )
        if states is not None and current is not None:
            yield _rows([(*current, entered, json.dumps(state))], states)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _summed(summary: type[Summary], unit: list[str], read: list[str], schema: pa.Schema):
    """One row per sorted block: what it does to a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            ended = []
            for block, row in zip(_lists(batch, unit), _lists(batch, read)):
                if block != current:
                    if current is not None:
                        ended.append((*current, held.dumps()))
                    current, held = block, summary()
                held.extend(*row)
            yield _rows(ended, schema)
        if current is not None:
            yield _rows([(*current, held.dumps())], schema)

    return run


def _walked(summary: type[Summary], key: list[str], unit: list[str], schema: pa.Schema):
    """The state that enters each block, along the sorted blocks of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for group, block, text in zip(_lists(batch, key), _lists(batch, unit), batch.column("__does").to_pylist()):
                if group != current:
                    current, state = group, None
                out.append((*block, None if state is None else json.dumps(state)))
                state = summary.leave(text, state)
            yield _rows(out, schema)

    return run


def _composed(summary, hot: DataFrame, key: list[str], unit: list[str], order: list[str], read: list[str], field) -> DataFrame:
    """The state that enters each block, by what the blocks before it do."""

    def kinds(name: str) -> T.StructType:
        return T.StructType([*[field[c] for c in unit], T.StructField(name, T.StringType())])

    def arrow(kind: T.StructType) -> pa.Schema:
        return pa.schema([(f.name, _ARROW[f.dataType]) for f in kind.fields])

    does, enters = kinds("__does"), kinds("__in")
    placed = hot.repartition(*unit).sortWithinPartitions(*unit, *order)
    summed = placed.mapInArrow(_summed(summary, unit, read, arrow(does)), does)
    # A row per block from here on.
    along = summed.repartition(*key).sortWithinPartitions(*unit)
    return cut_lineage(along.mapInArrow(_walked(summary, key, unit, arrow(enters)), enters))


def _settled(run_states, hot: DataFrame, key: list[str], unit: list[str]) -> DataFrame:
    """The states that enter and leave each block, from guesses that are mended until they hold."""
    states = cut_lineage(run_states(hot.withColumn("__in", F.lit(None).cast("string"))))
    window = Window.partitionBy(*key).orderBy("__blk")
    while True:
        wanted = states.withColumn("__want", F.lag("__out", 1).over(window))
        stale = wanted.filter(~F.col("__want").eqNullSafe(F.col("__in")))
        stale = cut_lineage(stale.select(*unit, F.col("__want").alias("__in")))
        if stale.isEmpty():
            break
        again = run_states(hot.join(stale, unit, "inner"))
        kept = states.join(stale.select(*unit), unit, "left_anti")
        states = cut_lineage(kept.unionByName(again))
    return states


def fold(
    df: DataFrame,
    key: str | list[str],
    order: list[str],
    read: list[str],
    step: Step,
    outputs: list[tuple[str, T.DataType]],
    *,
    block_on: list[str | Column] | None = None,
    limit: int | None = None,
    summary: type[Summary] | None = None,
) -> DataFrame:
    """*df* plus *outputs* computed by *step* along *order* inside *key*.

    *summary* composes steps, where they do: hot groups then take three passes.
    """
    key = [key] if isinstance(key, str) else list(key)
    limit = limit or group_rows(df.sparkSession)
    names = [name for name, _ in outputs]
    base = T.StructType([f for f in df.schema.fields])
    result = T.StructType([*base.fields, *[T.StructField(n, t) for n, t in outputs]])

    if not has_hot_group(df, key, limit):
        rows = (
            df.withColumn("__in", F.lit(None).cast("string"))
            .repartition(*key)
            .sortWithinPartitions(*key, *order)
        )
        return rows.mapInArrow(_stream(step, key, read, outputs, None), result)

    spread = with_blocks(df, key, [_col(c) for c in block_on or order[:1]], limit).drop("__hot")
    spread = cut_lineage(spread)
    unit = [*key, "__blk"]
    field = {f.name: f for f in spread.schema.fields}
    state_type = T.StructType(
        [*[field[c] for c in unit], T.StructField("__in", T.StringType()), T.StructField("__out", T.StringType())]
    )

    arrow = pa.schema([(f.name, _ARROW[f.dataType]) for f in state_type.fields])

    def run_states(rows: DataFrame) -> DataFrame:
        placed = rows.repartition(*unit).sortWithinPartitions(*unit, *order)
        return placed.mapInArrow(_stream(step, unit, read, outputs, arrow), state_type)

    # Only hot keys have more than one block, so the state table stays small:
    # one row per block.
    blocks = spread.filter(F.col("__blk") > 0).select(*key).distinct()
    hot = spread.join(blocks, key, "left_semi")
    if summary is not None:
        states = _composed(summary, hot, key, unit, order, read, field)
    else:
        states = _settled(run_states, hot, key, unit)
    rows = (
        spread.join(states.select(*unit, "__in"), unit, "left")
        .select(*spread.columns, "__in")
        .repartition(*unit)
        .sortWithinPartitions(*unit, *order)
    )
    with_block = T.StructType([*spread.schema.fields, *[T.StructField(n, t) for n, t in outputs]])
    done = rows.mapInArrow(_stream(step, unit, read, outputs, None), with_block)
    return done.select(*df.columns, *names)
