"""Heavy keys: found by one sketch per table, carried by columns, asked without a job."""

import random

import pytest
from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.operators import heavy
from discframe.operators import ordered as o
from discframe.operators import sequence as s
from discframe.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def skewed(spark):
    rng = random.Random(1)
    orders = [(k, k % 7) for k in range(300)]
    lines = [(0 if rng.random() < 0.3 else rng.randrange(300), i) for i in range(3000)]
    return {
        "orders": spark.createDataFrame(orders, "order_id long, customer long"),
        "lines": spark.createDataFrame(lines, "order_id long, pos long"),
    }


DOMAINS = [[("orders", "order_id"), ("lines", "order_id")], [("orders", "customer")]]


def test_peaks(skewed):
    found = heavy.peaks(skewed, DOMAINS)
    true = skewed["lines"].groupBy("order_id").count().agg(F.max("count")).first()[0]
    # The heaviest order of any table counts for both; a seventh of the orders has a seventh of the lines.
    assert found["lines", "order_id"] == found["orders", "order_id"] == pytest.approx(true, rel=0.02)
    assert found["orders", "customer"] == pytest.approx(3000 / 7, rel=0.02)


def test_peaks_travel_with_their_columns(spark, skewed):
    marked = heavy.mark(skewed, DOMAINS)
    lines, orders = marked["lines"], marked["orders"]
    joined = orders.join(lines, "order_id").filter("pos > 3").withColumn("x", F.lit(1))
    named = joined.select(F.col("order_id").alias("title_id"), F.col("customer").alias("disc_id"), "pos")
    peak = heavy.peak(lines, ["order_id"])
    assert peak > 800
    assert heavy.peak(named, ["title_id"]) == heavy.peak(cut_lineage(named), ["title_id"]) == peak
    assert heavy.peak(named.groupBy("title_id").count(), ["title_id"]) == peak
    assert heavy.peak(named, ["disc_id", "title_id"]) == heavy.peak(named, ["disc_id"]) < peak
    assert heavy.peak(named.select((F.col("title_id") + 1).alias("title_id")), ["title_id"]) is None


def test_heavy_keys_are_split(skewed):
    lines = heavy.mark(skewed, DOMAINS)["lines"]
    assert o.has_hot_group(lines, ["order_id"], 500) and not o.has_hot_group(lines, ["order_id"], 2000)
    rows = [
        sorted(map(tuple, o.ordered(lines, "order_id", ["pos"], limit=n, _rn=o.row_number(), _s=o.sum_to("pos")).collect()))
        for n in (100, 10_000)
    ]
    assert rows[0] == rows[1]


def test_no_job_while_a_plan_is_built(spark):
    lines, orders, events = (b.table(spark, FOLDER, n) for n in ("lineitem", "orders", "events"))
    context = spark.sparkContext
    context.setJobGroup("building", "plans of ordered operators")
    try:
        placed = o.ordered(lines, "l_orderkey", b.LINE_ORDER, _rn=o.row_number())
        items = placed.select(F.col("l_orderkey").alias("title_id"), "_rn", (F.col("l_suppkey") % 10).alias("clip_id"), "l_quantity")
        started = s.with_offsets(items, "title_id", "_rn", "l_quantity", "start")
        titles = o.ordered(orders, "o_custkey", ["o_orderdate", "o_orderkey"], title_idx=o.row_number())
        discs = o.with_group(titles.withColumnRenamed("o_custkey", "disc_id"), "disc_id", _n=F.count(F.lit(1)))
        met = started.join(discs, F.col("title_id") == F.col("o_orderkey"))
        o.ordered(met, ["disc_id", "clip_id"], ["title_idx", "_rn"], _last=o.lag("start"))
        o.ordered(events, "user_id", ["ts", "event_id"], _rn=o.row_number())
        assert context.statusTracker().getJobIdsForGroup("building") == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_empty_tables(spark, skewed):
    none = {name: df.limit(0) for name, df in skewed.items()}
    assert set(heavy.peaks(none, DOMAINS).values()) == {0}
