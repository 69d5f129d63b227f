"""A corpus pipeline: STAGES, each one written as Parquet and read again by the next.

Quality rules reject documents, of near duplicates one stays, documents that hold passages
of the benchmark go, sources are mixed to their weights (a document stands there as often as
the mix takes it), and what is left is dealt to shards of bounded size.

Every stage works on all that the one before it kept.  Documents with a null or empty text have
no words: the first stage rejects them, and where a stage is run by itself they are no near
duplicates of anything, hold no passage of the benchmark, and are no part of a mix.  A null key
or source is a value like others.  Repeated rows are one group of near duplicates, of which one
stays; of equal keys the one whose text's hash is least.  Very long texts are
read whole.  Without documents every stage gives an empty table with its columns, without a
benchmark nothing is contaminated.  Further columns are carried, whatever they are called, but
for those that the last stage makes (``shard depth page n_bytes``), which replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discframe.llm import mixing, ngram_join, quality, sharding, winnow
from discframe.llm.common import cut_lineage, read
from discframe.llm.queries import SHARD_BYTES
from discframe.session import configure


def _whole(docs: DataFrame, *read_: str) -> DataFrame:
    """The columns a stage reads, and every row whole as one column, so that no names clash."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__doc"), *read_)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(_whole(docs, "doc_id", "text", "lang"), carry=["__doc"])
    return judged.filter("kept").select("__doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = winnow.decontaminate(_whole(docs, "doc_id", "text"), read(spark, sf_dir, "benchmark"), carry=["__doc"])
    return judged.filter(~F.col("contaminated")).select("__doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_whole(docs, "doc_id", "text", "source"), carry=["__doc"])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.filter(F.col("copies") > 0).select("__doc.*", times.alias("__copy")).drop("__copy")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = ("shard", "depth", "page", "n_bytes")
    return sharding.shard(docs, limit=SHARD_BYTES, carry=[c for c in docs.columns if c not in made])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shards),
]

#: Mixing is a subset-sum choice by seeded hashes, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents; every stage's result is written and reread."""
    docs = read(configure(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
