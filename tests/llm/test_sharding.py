"""Shards: every row in one, within the limit, split no further than needed."""

import pytest

import __spark_entry__ as entry
from compare import compare, oracle_connection
from discframe.llm import sharding


def test_oracle(spark):
    folder = "/root/testdata/sf0.01"
    name = "op8_sharding"
    ok, note, _ = compare(spark, oracle_connection(folder), name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert ok, note


@pytest.mark.parametrize("limit", [100, 1000, 10**9])
def test_shards(spark, limit):
    rows = [(i, "x" * (i % 90), 1) for i in range(600)] + [(None, None, 1), (1, "", 1), (5, "y" * 500, 1)] + [(9, "z" * 30, 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, depth int")
    got = sharding.shard(docs, limit=limit, carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str(r[:2]) for r in rows)
    size, count = {}, {}
    for r in got:
        place = (r["shard"], r["page"])
        size[place] = size.get(place, 0) + r["n_bytes"]
        count[place] = count.get(place, 0) + 1
    assert all(size[p] <= limit or count[p] == 1 for p in size)
    names = {r["shard"] for r in got}
    # No shard is a prefix of another, and no parent of a shard would have fitted.
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    whole = {}
    for r in got:
        for n in range(len(r["shard"])):
            whole[r["shard"][:n]] = whole.get(r["shard"][:n], 0) + r["n_bytes"]
    assert all(v > limit for v in whole.values())


def test_directory(spark):
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(300)], "doc_id long, text string")
    shards = sharding.shard(docs, limit=1500)
    slots = sharding.directory(shards).collect()
    deepest = max(r["depth"] for r in slots)
    assert sorted(r["slot"] for r in slots) == list(range(2**deepest))
    assert all(format(r["slot"], f"0{deepest}b").startswith(r["shard"]) for r in slots)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(docs, limit=10).collect() == []
