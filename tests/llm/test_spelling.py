import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from discframe.llm import spelling
from discframe.llm.common import read

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType())])


def is_letter(c: str) -> bool:
    return "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"


def counted(rows):
    """Every run letter by letter, with the letters left out."""
    seen = Counter()
    for key, text in rows:
        for run in "".join(c if is_letter(c) else " " for c in text or "").split(" "):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def edited(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    words = counted(rows)
    near = {w: [v for v in words if edited(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def rows_of_words():
    base = ["harbour", "harbours", "arbours", "harbor", "sandbank", "sandbenk", "sandbankes", "aaaaaaaaaaaa", "aaaaaaaaaaa", "abababababab"]
    rows = []
    for i, w in enumerate(base):
        rows += [(k, f"{w} {w.upper()},{w}-{w}1{w}", "x") for k in range(2 + 30 * (i % 3 == 0) + 400 * (i == 4))]
    rows += [(None, "Überfähre überfähre Überfahre", "x"), (7, None, None), (8, "", None), (9, "ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ ÀÀÀÀÀÀÀ÷", "y")] * 2
    return rows + [(5, "q" * 30_000 + " " + "q" * 29_999, "long")] * 2


@pytest.mark.parametrize("sizes", [{}, {"cell_words": 3, "block_words": 2}, {"cell_words": 2, "sample_words": 10}])
def test_words_against_brute_force(spark, sizes):
    rows = rows_of_words()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(spelling.spelling_variants(df, **sizes)) == expected([r[:2] for r in rows])


def test_table_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(spelling.spelling_variants(docs, cell_words=200, block_words=90)) == expected(rows)


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["aaaaaaabcd"] * 2 + ["aaaaaaabce"] * 20 + ["aaaaaaabcef"] * 200 + ["aaaaaaxbcef"] * 2000), None)]
    got = {r["word"]: r["root"] for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA), noise=1 << 40).collect()}
    assert set(got.values()) == {"aaaaaaxbcef"}


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
