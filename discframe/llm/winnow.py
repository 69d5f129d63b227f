"""Benchmark decontamination by winnowed fingerprints; DataFrame functions only.

Hashes of *k* words are taken at every place of a text; of every *w* neighbouring hashes
the smallest is a fingerprint.  Two texts that share ``k + w - 1`` words in a row share all
hashes of one such group and so its smallest: with ``k + w - 1 = window`` no shared window
is missed, and only about ``2 / (w + 1)`` of the hashes leave a text.

1. Fingerprints of all documents meet those of the benchmark; documents with a hit go on.
2. Hits are extended: all windows of those documents meet all windows of the items, by
   two independent 64-bit hashes.
3. Items of fewer words than a window are one window of their own length.  They have no
   full group of hashes, so documents are asked for hashes of exactly the lengths that such
   items have (at most ``window - 1`` lengths).

A word is hit if a matching window covers it.  An item counts once however often it occurs.
A passage that many items share is one window with many items, joined after documents were
reduced to distinct windows.

Nulls: a null text has no words; a null item id counts as an item without a name and is
left out of the list.  Repeated items are one item; repeated documents get a row each.  Very
long texts are read whole.  Without documents there are no rows, without a benchmark nothing
is hit.  Columns not carried are not read, whatever they are called; carried ones keep their names.
Words and windows are compared by two 64-bit hashes (a false hit has odds of 2^-128 a pair).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discframe.llm.common import cut_lineage, lower_ascii, text_of

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text_of(text)), GAP), "")


def _starts(words: Column | str, length: Column | int) -> Column:
    """0-based places where *length* words begin; none if there are fewer."""
    last = F.size(words) - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hashes(words: str, length: int) -> Column:
    return F.transform(
        _starts(words, length), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)])
    )


def _second(words: str, i: Column, length: int) -> Column:
    """A hash of the same words with another start, so both agree only on equal words."""
    return F.xxhash64(F.lit("second"), *[F.get(words, i + j) for j in range(length)])


def fingerprints(hashes: Column, group: int) -> Column:
    """The distinct smallest hashes of *group* neighbours, from the hashes of a text."""
    places = _starts(hashes, group)
    return F.array_distinct(F.transform(places, lambda i: F.array_min(F.slice(hashes, i + 1, group))))


def _windows(rows: DataFrame, length: int, *keep: str) -> DataFrame:
    """One row per place of *length* words: ``at``, ``len``, ``a`` and ``b``."""
    at = F.explode(_starts("__words", length)).alias("at")
    placed = rows.select(*keep, "__words", at)
    first = F.xxhash64(*[F.get("__words", F.col("at") + j) for j in range(length)])
    return placed.select(
        *keep, "at", F.lit(length).alias("len"), first.alias("a"), _second("__words", F.col("at"), length).alias("b")
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    *,
    window: int = 10,
    k: int = 5,
    carry: list[str] | None = None,
) -> DataFrame:
    """*carry* (the key by default) with ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``, one row per row of *docs*."""
    kept = [key] if carry is None else carry
    group = window - k + 1
    items = benchmark.select(F.col(item).cast("string").alias("__item"), words_of(F.col(item_text)).alias("__words"))
    items = cut_lineage(items.filter(F.size("__words") > 0).distinct())
    short = sorted(r[0] for r in items.select(F.size("__words")).filter(F.size("__words") < window).distinct().collect())

    lists = [_windows(items.filter(F.size("__words") >= window), window, "__item")]
    lists += [_windows(items.filter(F.size("__words") == n), n, "__item") for n in short]
    wanted = lists[0]
    for more in lists[1:]:
        wanted = wanted.unionByName(more)
    # Windows and their items, once each; both are read from files, so sizes are known.
    wanted = cut_lineage(wanted.drop("at").distinct())
    distinct_windows = cut_lineage(wanted.select("len", "a", "b").distinct())
    full = items.filter(F.size("__words") >= window).withColumn("__h", _hashes("__words", k))
    prints = full.select(F.lit(k).alias("len"), F.explode(fingerprints(F.col("__h"), group)).alias("print"))
    prints = prints.unionByName(
        distinct_windows.filter(F.col("len") < window).select(F.lit(0).alias("len"), F.col("a").alias("print"))
    )
    prints = cut_lineage(prints.select("print").distinct())

    source = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("__kept"), _content(key, text).alias("__key"), F.col(text).alias("__text")
    )
    hits = _hits(source, prints, distinct_windows, short, window, k)
    found = cut_lineage(_per_document(hits, wanted))
    words = F.size(words_of(F.col("__text"))).cast("long")
    return (
        source.select("__kept", "__key", words.alias("n_words"))
        .join(found, "__key", "left")
        .select(
            *[F.col("__kept")[c].alias(c) for c in kept],
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def _content(key: str, text: str) -> Column:
    """Names a row by what it holds: equal rows share it and have equal results.

    Key and text are hashed apart, so no two rows run into one another.
    """
    name = F.coalesce(F.concat(F.lit("k"), F.md5(F.col(key).cast("string").cast("binary"))), F.lit("n"))
    return F.unhex(F.md5(F.concat(name, F.md5(text_of(text).cast("binary"))).cast("binary")))


def _hits(
    source: DataFrame, prints: DataFrame, windows: DataFrame, short: list[int], window: int, k: int
) -> DataFrame:
    """Places of documents where a window of the benchmark stands."""
    worded = source.select("__key", words_of(F.col("__text")).alias("__words")).withColumn("__h", _hashes("__words", k))
    every = [fingerprints(F.col("__h"), window - k + 1), *[_hashes("__words", n) for n in short]]
    met = worded.select("__key", F.explode(F.concat(*every)).alias("print")).join(prints, "print", "left_semi")
    suspects = cut_lineage(met.select("__key").distinct())
    texts = source.select("__key", "__text").join(suspects, "__key", "left_semi")
    # Equal rows have equal places; one of them stands for all.
    texts = cut_lineage(texts.dropDuplicates(["__key"]).select("__key", words_of(F.col("__text")).alias("__words")))
    places = _windows(texts, window, "__key")
    for n in short:
        places = places.unionByName(_windows(texts, n, "__key"))
    return cut_lineage(places.join(windows, ["len", "a", "b"], "left_semi"))


def _per_document(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    order = Window.partitionBy("__key").orderBy("at", "len")
    covered = F.max(F.col("at") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("at") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(covered, F.lit(0))))
    words = hits.withColumn("fresh", fresh).groupBy("__key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = (
        hits.select("__key", "len", "a", "b")
        .distinct()
        .join(wanted, ["len", "a", "b"])
        .select("__key", "__item")
        .filter(F.col("__item").isNotNull())
        .distinct()
        .groupBy("__key")
        .agg(F.array_join(F.sort_array(F.collect_list("__item")), ",").alias("names"), F.count(F.lit(1)).alias("n_items"))
    )
    digest = F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256)
    return words.join(items, "__key", "left").select("__key", "n_hit", "n_items", digest.alias("items_sha256"))
