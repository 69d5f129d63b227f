import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from discframe.llm import alignment
from discframe.llm.common import read
from discframe.llm.vocabularies import Pieces, byte_table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_a", T.StringType())])


def expected(rows):
    """Byte by byte: which token of each side holds it."""
    library, model, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_table()
    library.encode_special_tokens = True
    linked, corpus = [], Counter()
    for key, text in rows:
        one = None
        if text:
            raw = (" " + text).encode()
            sides = [
                [(i, bytes(table[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids],
                [
                    (i, bytes([int(p[3:5], 16)]) if p[:3] == "<0x" and p[-1] == ">" else p.replace("▁", " ").encode())
                    for i, p in [(i, model.id_to_piece(i)) for i in model.encode(text)]
                ],
            ]
            if all(b"".join(t for _, t in side) == raw for side in sides):
                held = [[n for n, (_, t) in enumerate(side) for _ in t] for side in sides]
                links = list(dict.fromkeys(zip(*held)))
                ends = [[k + 1 == len(raw) or h[k] != h[k + 1] for k in range(len(raw))] for h in held]
                groups, start = [], 0
                for k in range(len(raw)):
                    if ends[0][k] and ends[1][k]:
                        groups.append("|".join(",".join(str(side[n][0]) for n in dict.fromkeys(h[start : k + 1])) for side, h in zip(sides, held)))
                        start = k + 1
                pairs = [(sides[0][i][0], sides[1][j][0]) for i, j in links]
                one = (len(sides[0]), len(sides[1]), len(groups), pairs, ";".join(groups))
                corpus.update(set(pairs))
        linked.append((key, one))
    top = {}
    for (a, _), n in corpus.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for key, one in linked:
        if one is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, pairs, groups = one
            best = sum(corpus[p] == top[p[0]] for p in pairs)
            out.append((key, n_a, n_b, n_groups, len(pairs), best, sum(corpus[p] for p in pairs), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    names = ["doc_id", *alignment.COUNTS, "groups_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()), key=str)


ODD = [
    "", None, " ", "  ", "a  b ", " a", "\n\n x  \t y\n", "a▁b", "x  y", "<|endoftext|> a<s></s>", "\x00 b", "é ½ x  ", "日本語のテキスト",
    "naïve café — “quoted” … 🙂🙂", "a \n b", "word " * 20_000, "x" * 30_000, "same text", "same text",
]


@pytest.mark.parametrize("limits", [{}, {"shard_pairs": 5}, {"table_pairs": 0}])
def test_texts_against_bytes(spark, limits):
    rows = [(i if i % 7 else None, t, "z") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(alignment.align(df, A, B, public_tokenizers.PATTERN, **limits)) == expected([r[:2] for r in rows])


def test_table_against_bytes(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    docs = read(spark, "/root/testdata/sf0.001", "documents").repartition(7)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = alignment.align(docs, A, B, public_tokenizers.PATTERN, carry_groups=True)
    assert result(out) == expected(rows)
    for r in out.collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B, public_tokenizers.PATTERN).collect() == []


def test_unknown_pair_fails():
    import numpy as np

    keys = np.arange(100, dtype=np.int64) * 7919
    levels = alignment.perfect_hash(keys)
    places = alignment.PerfectHash(levels).places(keys)
    assert sorted(places.tolist()) == list(range(100))
    ordered = np.empty(100, np.int64)
    ordered[places] = keys
    table = alignment.PairTable([(alignment._packed(levels), ordered.tobytes(), np.ones(100, np.int64).tobytes())], np.zeros(0))
    assert table.counts(keys).tolist() == [1] * 100
    with pytest.raises(KeyError):
        table.counts(np.array([5], np.int64))


def test_words_apart_are_the_whole_text(spark):
    import random

    model, rng = Pieces(B), random.Random(3)
    assert model.apart
    texts = [t for t in ODD if t] + [r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect() if r["text"]]
    texts += ["".join(rng.choices(" \n\ta▁é1.日🙂' ", k=30)) for _ in range(2000)]
    assert model.ids(texts) == model.whole(texts)
    model.REMEMBERED = 50
    assert model.ids(texts) == model.whole(texts)
