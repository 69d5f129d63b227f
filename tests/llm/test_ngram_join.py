"""Components against all pairs compared in plain Python."""

import random
from collections import defaultdict

import pytest

from discframe.llm import ngram_join, queries
from discframe.llm.components import components


def shingles(text, n=5):
    table = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = (text or "").translate(table).encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows):
    """(key, set size, component) per row; pairs by inverted index."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in index[x]:
                common[j] += 1
            index[x].append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None and sets[i]:
            r = root(i)
            least[r] = min(k, least.get(r, k))
    return sorted(
        ((k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str
    )


def run(spark, rows):
    docs = spark.createDataFrame([(k, t, b"", 1) for k, t in rows], "doc_id long, text string, node binary, size int")
    got = ngram_join.with_component(ngram_join.linked(docs), "doc_id")
    return sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def family(rng, words, copies, edits):
    base = [rng.choice(words) for _ in range(rng.randrange(8, 120))]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(len(text))] = rng.choice(words)
        yield " ".join(text)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for _ in range(25) for t in family(rng, words, rng.randrange(1, 12), 4)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    texts += ["", None, "one", "One", "two words", "a b c d", "A  b\tc\nd", " ", texts[0], texts[0].upper()]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (0, texts[0]), (1, "same key, other text")]


def test_equals_all_pairs(spark, corpus):
    assert run(spark, corpus) == brute(corpus)


def test_small_batches_buckets_and_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH_BYTES", 3000)
    monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", 500)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    assert run(spark, corpus) == brute(corpus)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.QUERIES["op1_ngram_join"](spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.with_component(ngram_join.linked(docs), "doc_id").collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
