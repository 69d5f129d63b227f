"""Targets and counts against plain Python."""

import itertools
import random

import numpy as np

from discframe.llm import mixing, queries

SEEN = ["doc_id", "size", "source_size", "target", "copies", "taken"]


def test_water_fill():
    got = mixing.water_fill([100, 100, 1000], [3, 1, 2], 1800, 2)
    assert got[0] == 200 and abs(sum(got) - 1800) < 1e-9 and got[1] == 200 and got[2] == 1400
    assert mixing.water_fill([], [], 0, 2) == []


def test_subset_sum_finds_the_best():
    rng = random.Random(2)
    for _ in range(200):
        sizes = np.array(sorted({rng.randrange(1, 12) for _ in range(4)}))
        counts = np.array([rng.randrange(0, 4) for _ in sizes])
        goal = rng.randrange(0, 40)
        got = mixing.subset_sum(sizes, counts, goal)
        best = max(
            (s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := int((np.array(c) * sizes).sum())) <= goal),
            default=0,
        )
        assert (got <= counts).all() and int((got * sizes).sum()) == best


def test_subset_sum_looks_above():
    rng = random.Random(3)
    for _ in range(200):
        sizes = np.array(sorted({rng.randrange(1, 12) for _ in range(3)}))
        counts = np.array([rng.randrange(0, 4) for _ in sizes])
        goal, above = rng.randrange(1, 40), rng.randrange(0, 12)
        sums = {int((np.array(c) * sizes).sum()) for c in itertools.product(*[range(n + 1) for n in counts])}
        got = int((mixing.subset_sum(sizes, counts, goal, above) * sizes).sum())
        assert got in sums and abs(got - goal) == min(abs(s - goal) for s in sums if s <= goal + above)


def test_copies_of_a_small_source_come_nearest():
    rng = random.Random(6)
    for _ in range(150):
        sizes = np.array(sorted({rng.randrange(1, 400) for _ in range(5)}))
        counts = np.array([rng.randrange(1, 3) for _ in sizes])
        total = int((sizes * counts).sum())
        target = rng.random() * 2 * total
        got = mixing.copies_by_size(sizes, counts, target, 2, 50_000)
        assert (got <= 2 * counts).all() and (got >= 0).all()
        sums = {int((np.array(c) * sizes).sum()) for c in itertools.product(*[range(2 * n + 1) for n in counts])}
        near = min(abs(s - target) for s in sums)
        assert abs(int((got * sizes).sum()) - target) <= max(near, 1.0)


def docs_of(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 50), rng.choice(["a", "b", "é", None]), i) for i in range(400)]
    rows += [(i, "same text here", "a", 0) for i in range(1000, 1300)] + [(7, "twin", "b", 0)] * 5
    rows += [(None, None, None, 0), (9, "", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long"), rows


def test_mix(spark):
    docs, rows = docs_of(spark)
    got = mixing.mix(docs, carry=["doc_id", "source"], exact_words=200).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * total) < 1e-6
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in own)
    again = mixing.mix(docs.repartition(7), carry=["doc_id", "source"], exact_words=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    docs, _ = docs_of(spark)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op10_mixing"](spark, folder).collect()
    assert len(got) == len(docs)
    taken, target = {}, {}
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(docs[r["doc_id"]]["text"].encode().split())
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in taken)
