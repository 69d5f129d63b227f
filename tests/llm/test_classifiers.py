"""Held-out accuracy of the learnt scores, and their edge cases."""

import zlib

import pytest
from pyspark.sql import functions as F

from discframe.llm import cotraining, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("name", "label", "accuracy", "recall"), [("op6_toxicity", "toxic", 0.93, 0.6), ("op4_quality_classifier", "quality", 0.9, 0.6)]
)
def test_held_out(spark, name, label, accuracy, recall):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == docs
    rare = 1 if label == "toxic" else 0
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= accuracy * len(held)
    some = [(a, b) for a, b in held if a == rare]
    assert sum(a == b for a, b in some) >= recall * len(some)


def toy(spark):
    rude = ["you are a grumbole", "what a grumbole idea", "grumbole again", "such a grumbole", "the grumbole one"]
    kind = ["you are a friend", "what a fine idea", "once again", "such a nice day", "the red one"]
    texts = [(i, rude[i % 5] if i % 2 else kind[i % 5], i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "l") for i, t, _ in texts], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    return docs, labels


def test_folding_and_exceptions(spark):
    docs, labels = toy(spark)
    more = [(1000, "GRUMB0LE", "l"), (1001, "grumbоle", "l"), (1002, None, "l"), (1003, "", "l"), (None, "a friend", "l"), (1004, "x" * 50_000, "l")]
    more = spark.createDataFrame(more, "doc_id long, text string, label string")
    scored = toxicity.toxicity(docs.union(more), labels)
    got = {r["doc_id"]: r["predicted"] for r in scored.collect()}
    assert got[1000] == got[1001] == 1
    assert got[1002] == got[1003] == got[1004] == got[None] == 0
    lexicon = toxicity.Lexicon({" trash ": 5.0}, {" trash can ": 5.0})
    made = lexicon.automaton()
    assert toxicity.summed(made, "The trash can!")[0] == 0 and toxicity.summed(made, "you TRA5H")[0] == 5


def test_no_labels(spark):
    docs, labels = toy(spark)
    none = labels.limit(0)
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    full = docs.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("en"), "n_chars": F.lit(None).cast("long")})
    none = none.withColumnRenamed("toxic", "quality")
    assert {r["score"] for r in cotraining.quality_scores(full, none).collect()} == {0.5}
    assert cotraining.quality_scores(full.limit(0), none).collect() == []


def test_exceptions_touch_only_the_word_they_cover():
    weights = {" trash ": 5.0, " scum": 4.0, " scum ": 3.0}
    made = toxicity.Lexicon(weights, {" the trash ": 5.0, " trash can ": 5.0, " pond scum ": 4.0}).automaton()
    for text, want in (
        ("the trash can", 0), ("the trash can, you scum", 4), ("trash can trash", 5), ("the trash can of pond scum", 0),
        ("pond scum and scum", 4), ("the trash can the trash can trash", 5), ("the can", 0),
    ):
        assert toxicity.summed(made, text)[0] == want, text


def test_all_learnt_exceptions_count(spark):
    text = " trash ".join(f"w{i}" for i in range(1500))
    train = spark.createDataFrame([(text, 0), ("you trash", 1)], "text string, label int")
    found = toxicity._learned_exceptions(train, toxicity.Lexicon({" trash ": 5.0}), 1)
    assert len(found) == 2998 and set(found.values()) == {5.0}


def test_matches_are_those_of_a_plain_search(spark):
    """Aho-Corasick, exceptions included, beside looking for every pattern at every place."""
    import random

    rng = random.Random(4)

    def plain(weights, exceptions, text):
        folded, best, back = toxicity.folded(text), {}, {}
        for pattern, weight in weights.items():
            for at in range(len(folded)):
                if folded.startswith(pattern, at):
                    best[at] = max(weight, best.get(at, 0.0))
        for phrase, weight in exceptions.items():
            for at in range(len(folded)):
                if folded.startswith(phrase, at):
                    for word in {a for a in best if at <= a < at + len(phrase) - 1}:
                        back[word] = max(weight, back.get(word, 0.0))
        return sum(max(0.0, w - back.get(at, 0.0)) for at, w in best.items())

    for _ in range(200):
        weights = {" trash ": 5.0, " scum": 4.0, " scumb ": 3.0, " rot ": 2.0}
        exceptions = {p: 5.0 for p in rng.sample([" trash can ", " the trash ", " dry rot "], rng.randint(0, 3))}
        text = " ".join(rng.choices(["trash", "can", "the", "scum", "scumb", "rot", "dry", "TRA5H", "sсum", "x"], k=rng.randint(0, 15)))
        found = toxicity.summed(toxicity.Lexicon(weights, exceptions).automaton(), text)[0]
        assert found == pytest.approx(plain(weights, exceptions, text)), (text, exceptions)
