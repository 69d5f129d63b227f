"""Every registered query against its SQL oracle, and registry hygiene."""

import pytest

import __spark_entry__ as entry
from compare import compare, oracle_connection
from discframe.bindings import ORACLES
from discframe.session import drop_tables

FOLDER = "/root/testdata/sf0.001"
# Queries whose windows run over split groups when every group counts as hot.
SPLIT = ["w1_offsets", "w5_merge_contiguous", "w18_reindex", "j10_overlap_join", "i2_splice", "u1_ordered_union"]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], ORACLES[name], FOLDER)
    drop_tables(spark)
    assert ok, note


@pytest.mark.parametrize("name", SPLIT)
def test_split_groups_match_the_oracle(spark, con, name):
    spark.conf.set("spark.discframe.groupRows", "3")
    try:
        ok, note, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    finally:
        spark.conf.unset("spark.discframe.groupRows")
    assert ok, note


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150


def test_no_cross_joins(spark):
    for name in ("j7_shared_items", "j8_near_ranges", "j10_overlap_join", "c11_settle_protection", "c14_cross_set"):
        df = entry.queries()[name](spark, FOLDER)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
