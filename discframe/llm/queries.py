"""The registered queries of the corpus operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discframe.llm import (
    alignment,
    cotraining,
    mixing,
    ngram_join,
    packing,
    pages,
    pii,
    quality,
    sharding,
    spelling,
    tokens,
    toxicity,
    winnow,
)
from discframe.llm.common import read
from discframe.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20
TOKEN_LIMIT = 512
PACKED_TOKENS = 2048


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.with_component(ngram_join.linked(read(spark, sf_dir, "documents")), "doc_id")


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(read(spark, sf_dir, "pages"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in pii.BASE_KINDS], "base_sha256", F.col("joined").alias("spans")
    )


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


SHARD_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS bits,
         coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes
  FROM documents),
nodes AS (
  SELECT d, bits >> (60 - d) AS p, sum(n_bytes) AS b FROM rows, range(0, 31) t(d) GROUP BY ALL),
placed AS (
  SELECT rows.doc_id, rows.bits, rows.n_bytes, min(d) AS depth
  FROM rows JOIN nodes ON p = bits >> (60 - d) AND b <= {SHARD_BYTES} GROUP BY rows.doc_id, rows.bits, rows.n_bytes)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bits >> (60 - depth)), depth::INT, '0') END AS shard,
       depth, 0::BIGINT AS page, n_bytes
FROM placed
"""


@query("op8_sharding", SHARD_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), limit=SHARD_BYTES)


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("copies")


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN,
    )


@query("op12_best_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        limits=packing.Limits(tokens=PACKED_TOKENS),
        carry_ids=False,
    )


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))
