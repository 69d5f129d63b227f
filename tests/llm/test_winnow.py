"""Decontamination against every window compared in plain Python."""

import hashlib
import random
import re

import pytest

from discframe.llm import queries, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                met = windows.get(tuple(w[i : i + n]))
                if met:
                    hit.update(range(i, i + n))
                    found |= met
        names = ",".join(sorted(str(x) for x in found if x is not None))
        n_items = len([x for x in found if x is not None])
        out.append((key, len(w), len(hit), n_items, hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **settings):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, winnow.decontaminate(d, b, **settings).collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "x1"]

    def text(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(n))

    items = [(i, text(rng.randrange(10, 40))) for i in range(30)] + [(100, text(3)), (101, text(1)), (102, text(9)), (103, "")]
    items += [(104, None), (None, text(12)), (3, items[3][1]), (105, items[4][1])]
    docs = []
    for i in range(80):
        body = text(rng.randrange(0, 60)).split()
        if i % 3 == 0:
            source = words(items[rng.randrange(len(items))][1])
            at = rng.randrange(len(body) + 1)
            a = rng.randrange(len(source) + 1)
            body[at:at] = [w.upper() for w in source[a : a + rng.randrange(1, 20)]]
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (None, items[5][1]), (202, " ".join([items[6][1]] * 3)), (0, docs[0][1]), (0, docs[0][1])]
    return docs, items


def test_equals_all_windows(spark, tables):
    assert run(spark, *tables) == brute(*tables)


def test_other_sizes(spark, tables):
    assert run(spark, *tables, window=6, k=3) == brute(*tables, size=6)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert run(spark, [], items) == []
    assert run(spark, docs[:5], []) == brute(docs[:5], [])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    read = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark")}
    docs = [(r["doc_id"], r["text"]) for r in read["documents"].collect()]
    items = [(r["item_id"], r["text"]) for r in read["benchmark"].collect()]
    got = queries.QUERIES["op9_decontamination"](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == brute(docs, items)


def test_rows_are_not_taken_for_each_other(spark):
    """Keys and texts that read the same when put together."""
    items = [("x", "one two three four five six seven eight nine ten")]
    rows = [
        ("a", "one two three four five:six seven eight nine ten", 0),
        ("a:one two three four five", "six seven eight nine ten", 0),
        (None, "a:one two three four five six seven eight nine ten", 1),
        ("a", "one two three four five six seven eight nine ten", 1),
        ("", None, 0),
        (None, None, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_hit int")
    got = winnow.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in got), key=str) == sorted(
        [("a", 10, 10), ("a:one two three four five", 5, 0), (None, 11, 10), ("a", 10, 10), ("", 0, 0), (None, 0, 0)], key=str
    )


def test_a_long_text(spark):
    filler = " ".join(f"w{i}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{filler} {passage} {filler}")], "doc_id long, text string")
    items = spark.createDataFrame([("x", passage)], "item_id string, text string")
    (r,) = winnow.decontaminate(docs, items).collect()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (120_012, 12, 1)
