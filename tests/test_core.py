"""Ordered windows and folds: the split plan equals the plain one, and plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.operators import ordered as o
from discframe.operators.fold import fold

BIG = 10**9


@pytest.fixture(scope="module")
def skewed(spark):
    """Three keys, one of them holding most rows, with NULL values."""
    rng = random.Random(7)
    rows = [
        (key, pos, rng.randint(0, 60) if rng.random() > 0.2 else None)
        for key, size in ((1, 3), (2, 1), (3, 160))
        for pos in range(size)
    ]
    return spark.createDataFrame(rows, "k long, pos long, v long").repartition(4)


def _both(df, **fns):
    plain = sorted(map(tuple, o.ordered(df, "k", ["pos"], limit=BIG, **fns).collect()), key=str)
    split = sorted(map(tuple, o.ordered(df, "k", ["pos"], limit=9, **fns).collect()), key=str)
    return plain, split


def test_split_windows_equal_plain_ones(skewed):
    plain, split = _both(
        skewed,
        lag=o.lag("v"),
        lead=o.lead("v"),
        rn=o.row_number(),
        upto=o.sum_to("v"),
        before=o.sum_before("v"),
        top=o.max_to("v"),
        top_before=o.max_before("v"),
        top_from=o.max_from("v"),
        last=o.last_to("v"),
        last_before=o.last_before("v"),
        following=o.next_after("v"),
    )
    assert plain == split


def test_split_by_several_columns(spark):
    rows = [(1, a, b) for a in range(5) for b in range(20)]
    df = spark.createDataFrame(rows, "k long, a long, b long")
    got = o.ordered(df, "k", ["a", "b"], block_on=["a", "b"], limit=10, rn=o.row_number()).collect()
    assert sorted(r.rn for r in got) == list(range(1, 101))
    assert all(r.rn == r.a * 20 + r.b + 1 for r in got)
    blocks = o.with_blocks(df, ["k"], [F.col("a"), F.col("b")], 10)
    sizes = [r["count"] for r in blocks.groupBy("__blk").count().collect()]
    assert max(sizes) <= 10


def test_group_aggregates_split(skewed):
    plain = o.with_group(skewed, "k", limit=BIG, n=F.count("v"), top=F.max("v")).collect()
    split = o.with_group(skewed, "k", limit=9, n=F.count("v"), top=F.max("v")).collect()
    assert sorted(map(str, plain)) == sorted(map(str, split))


def _make_step():
    # A nested function, so that it travels by value from this test module.
    def step(state, value):
        top = -1 if state is None else state[0]
        value = value or 0
        if value < top - 10:
            return (value,), (value, True)
        return (max(top, value),), (max(top, value), False)

    return step


_reset_step = _make_step()


def test_fold_in_blocks_equals_sequential(skewed):
    outputs = [("top", T.LongType()), ("reset", T.BooleanType())]
    plain = fold(skewed, "k", ["pos"], ["v"], _reset_step, outputs, limit=BIG).collect()
    split = fold(skewed, "k", ["pos"], ["v"], _reset_step, outputs, limit=9).collect()
    assert sorted(map(str, plain)) == sorted(map(str, split))
    by_key = {}
    for row in sorted(skewed.collect(), key=lambda r: (r.k, r.pos)):
        state, out = _reset_step(by_key.get(row.k), row.v)
        by_key[row.k] = state
        match = next(r for r in split if (r.k, r.pos) == (row.k, row.pos))
        assert (match.top, match.reset) == out


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k long, pos long, v long")
    assert o.ordered(empty, "k", ["pos"], x=o.sum_to("v")).collect() == []
    assert fold(empty, "k", ["pos"], ["v"], _reset_step, [("t", T.LongType()), ("r", T.BooleanType())]).collect() == []


def test_plain_window_plan_has_one_shuffle(skewed):
    done = o.ordered(skewed, "k", ["pos"], limit=BIG, a=o.lag("v"), b=o.sum_to("v"), c=o.row_number())
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
