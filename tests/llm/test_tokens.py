"""Token counts against the library that defines them."""

import public_tokenizers
from tokenizers import Tokenizer

from discframe.llm import queries
from discframe.llm.tokens import PreTokens, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " ",
    "don't  they'll \n\n go\t1234 été naïve",
    "a<|endoftext|>b<|endoftext|><|endoftext|> c",
    "՘a ࢏1 \x1c\x1d\x85 　x",
    "x" * 30_000,
    "你好 \U0001f600 ١٢",
    "repeated row",
    "repeated row",
]


def whole(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    rows = [(i if i else None, t, "pre", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pre string, n_tokens int")
    for frequent in (200_000, 2):
        got = token_counts(docs, PATH, public_tokenizers.PATTERN, frequent=frequent).collect()
        want = sorted(((r[0], len((r[1] or "").encode()), whole(r[1])) for r in rows), key=str)
        assert sorted((tuple(r) for r in got), key=str) == want


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op3_token_counts"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        n = whole(docs[r["doc_id"]])
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 512)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_classes_are_known():
    odd = PreTokens(PATH, public_tokenizers.PATTERN).odd_characters()
    assert "՘" in odd and "é" not in odd


def test_equal_rows_and_keys_that_look_alike(spark):
    rows = [(k, t) for k in ("None", None, "1", "", "'1'") for t in ("rare zyxwvut words", None, "")] * 3
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    got = token_counts(docs, PATH, public_tokenizers.PATTERN, frequent=1).collect()
    want = sorted(((k, len((t or "").encode()), whole(t)) for k, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
