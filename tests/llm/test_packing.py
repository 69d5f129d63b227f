import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from discframe.llm import packing
from discframe.llm.common import read
from discframe.llm.queries import QUERIES
from discframe.llm.vocabularies import ByteLevel

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])


def ids_of(texts):
    return [e.ids + [0] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, docs, limit=2048):
    """Every piece stands where it should and sequences are gapless; returns how many there are."""
    pieces, lanes = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        lanes[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for (key, _), ids in zip(docs, ids_of([t for _, t in docs])):
        stop, start, n = len(ids) % limit or limit, 0, 0
        while start < len(ids):
            part = ids[start:stop]
            want[key].append((n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            n, start, stop = n + 1, stop, stop + limit
    got = {k: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in pieces.items()}
    assert got == {k: sorted(v) for k, v in want.items()}
    for lane in lanes.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
        assert at <= limit
    return len(lanes)


def test_query_on_a_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    n = check(QUERIES["op12_best_fit_packing"](spark, "/root/testdata/sf0.01").collect(), docs)
    total = sum(map(len, ids_of([t for _, t in docs])))
    assert n <= -(-total // 2048) * 1.005 + 1


def test_edge_cases(spark):
    rows = [(1, "", None), (2, None, "x"), (None, "a <|endoftext|> b", "y"), (3, "long text " * 40_000, "z"), (4, "x" * 100_000, "z")]
    rows += [(5, "same text", "s")] * 40 + [(i, "common length", None) for i in range(100, 3100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = packing.packed(df.drop("length"), PATH, public_tokenizers.PATTERN)
    check(out.collect(), [r[:2] for r in rows])
    lanes = {r["sequence_id"]: r for r in packing.sequences(out).collect()}
    for r in out.collect():
        assert lanes[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == list(r["ids"])
        assert r["offset"] in lanes[r["sequence_id"]]["starts"]
    assert packing.packed(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_every_limit_holds(score, seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 500, 80))
    counts = rng.integers(1, 60, len(lengths))
    limits = packing.Limits(512, pieces=6, cost=100_000, score=score) if seed else packing.Limits(512, score=score)
    if seed:
        lengths, counts = lengths[lengths <= 316], counts[lengths <= 316]
    made = packing.plan(lengths, counts, limits)
    tokens, number, cost, spans = (defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list))
    ranks = defaultdict(set)
    for length, rank, sequence, count, each, offset in made.rows.tolist():
        for k in range(count * each):
            s = sequence + k // each
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
            tokens[s] += length
            number[s] += 1
            cost[s] += length**2
            spans[s].append((offset + k % each * length, length))
    assert {n: len(r) for n, r in ranks.items()} == dict(zip(lengths.tolist(), counts.tolist()))
    assert all(r == set(range(len(r))) for r in ranks.values())
    assert set(tokens) == set(range(made.sequences))
    full = limits.capacity
    assert max(tokens.values()) <= full[0] and max(number.values()) <= full[1] and max(cost.values()) <= full[2]
    for lane in spans.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
    # Two pieces of more than half a sequence never share one.
    alone = counts[lengths > full[0] / 2].sum()
    least = max(alone, int((lengths * counts).sum()) / full[0], counts.sum() / full[1], int((lengths**2 * counts).sum()) / full[2])
    assert made.sequences <= least * (1.3 if seed else 1.05) + 1


def test_more_than_a_sequence_holds():
    with pytest.raises(ValueError):
        packing.plan(np.array([600]), np.array([1]), packing.Limits(512))


def test_ids_equal_the_library(spark):
    known, library = ByteLevel(PATH, public_tokenizers.PATTERN), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(5)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, rng.choice(points, 40))) for _ in range(400)]
    texts += ["".join(rng.choice(list(" \n\t'sA1é!日  "), 30)) for _ in range(400)]
    texts += [r["text"] for r in read(spark, "/root/testdata/sf0.001", "documents").collect() if r["text"]]
    for t in texts:
        assert known.ids(t) == library.encode(t, add_special_tokens=False).ids, t
