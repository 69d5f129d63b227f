"""The pipeline: every stage against plain Python over what the stage before kept."""

import corpus_pipeline as pipeline
from discframe.llm.common import cut_lineage, read
from mixing_rules import words_of_source
from test_ngram_join import brute as components
from test_quality import base
from test_winnow import brute as leaks

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    benchmark = [(r["item_id"], r["text"]) for r in read(spark, FOLDER, "benchmark").collect()]
    docs = read(spark, FOLDER, "documents")
    names = docs.columns
    kept = {}
    before = docs.collect()
    for name, stage in pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        kept[name] = (before, docs.collect())
        before = kept[name][1]
        if name != "sharding":
            assert docs.columns == names
        assert before, name

    was, now = kept["quality_rules"]
    gone = {r["doc_id"] for r in was} - {r["doc_id"] for r in now}
    assert {r["doc_id"] for r in was if base(r["text"])[-1]} <= gone
    labels = {r["doc_id"]: r["quality"] for r in read(spark, FOLDER, "labels").collect()}
    assert not any(labels.get(k) == 1 and not base(r["text"])[-1] for r in was for k in [r["doc_id"]] if k in gone and len(r["text"].split()) >= 80)

    was, now = kept["near_duplicates"]
    groups = {k: c for k, _, c in components([(r["doc_id"], r["text"]) for r in was])}
    assert sorted(r["doc_id"] for r in now) == sorted(set(groups.values()))

    was, now = kept["decontamination"]
    hit = {row[0]: row[-1] for row in leaks([(r["doc_id"], r["text"]) for r in was], benchmark)}
    assert sorted(r["doc_id"] for r in now) == sorted(k for k, bad in hit.items() if not bad)

    was, now = kept["mixing"]
    for source, (target, most) in words_of_source(was).items():
        taken = sum(len(r["text"].split()) for r in now if r["source"] == source)
        assert abs(taken - target) <= most

    was, now = kept["sharding"]
    assert sorted(r["doc_id"] for r in was) == sorted(r["doc_id"] for r in now)
    assert "shard" in docs.columns


def test_run(spark):
    rows = pipeline.run(spark, FOLDER)
    assert {"doc_id", "text", "shard"} <= set(rows.columns) and rows.count() > 0


def test_empty(spark):
    docs = read(spark, FOLDER, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        assert docs.count() == 0


def test_cases_of_the_stages(spark):
    """Nulls, empty and very long texts, repeated rows and clashing columns, stage by stage."""
    passage = next(r["text"] for r in read(spark, FOLDER, "benchmark").collect() if len(r["text"].split()) >= 12)
    plain = [r["text"] for r in read(spark, FOLDER, "documents").collect() if r["text"] and len(r["text"].split()) > 60][:40]
    rows = [(i, t, "en", f"src{i % 3}", 1, "kept", "size") for i, t in enumerate(plain)]
    rows += [(100, None, None, None, 2, "a", "b"), (101, "", "en", "src0", 2, "a", "b"), (None, plain[0], "en", None, 2, "a", "b")]
    rows += [(102, "w " * 10 + passage, "en", "src1", 3, "a", "b"), (103, " ".join(f"v{i} word" for i in range(40_000)), "en", "src1", 3, "a", "b")]
    rows += [rows[5]] * 3
    kinds = "doc_id long, text string, lang string, source string, n_words int, kept string, shard string"
    docs = spark.createDataFrame(rows, kinds)
    stages = dict(pipeline.STAGES)
    names = docs.columns
    got = {n: stages[n](spark, docs, FOLDER).collect() for n in stages}
    for name in ("quality_rules", "near_duplicates", "decontamination", "mixing"):
        assert got[name] and list(got[name][0].asDict()) == names, name
    ids = {n: [r["doc_id"] for r in v] for n, v in got.items()}
    assert not {100, 101} & set(ids["quality_rules"])
    assert ids["near_duplicates"].count(5) == 1 and {100, 101, 103} <= set(ids["near_duplicates"])
    assert 102 not in ids["decontamination"] and {100, 101, 103, None} <= set(ids["decontamination"])
    assert not {100, 101} & set(ids["mixing"])
    assert sorted(map(str, ids["sharding"])) == sorted(str(r[0]) for r in rows)
    assert all(set(r["shard"]) <= set("01") for r in got["sharding"])
