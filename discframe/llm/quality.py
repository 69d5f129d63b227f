"""Quality rules by distribution divergence; DataFrame functions only.

A text is compared with references of its language in two histograms: character classes
and common words.  The measure is the Jensen-Shannon distance (base 2, 0 to 1).

1. ``common_words``: per language the words that stand in the most texts.
2. ``features``: counts of every text, written once.
3. References: per language the summed histograms; then summed again over the texts that
   are nearer to the first reference than the harmonic mean of all distances, so junk in
   the corpus does not move the reference towards itself.
4. A text is rejected if its character distance reaches *far*, or if both distances reach
   *near_chars* and *near_words*.  A histogram of few counts is away from its own source by
   chance, so all limits rise with that noise: by *noise* times ``sqrt(bins / (8 ln 2))``
   times ``sqrt(1 / n + 1 / n of the reference)``.  That guards short texts and languages with
   few texts without a step anywhere: the same rule holds at every length and size.

Base rules come first: fewer than *min_words* words, or more than a fifth of the words in
five-word windows that the text has twice or more.

A null text has no words and fails the base rules.  A null language is a language of its
own.  Rows are judged one by one; repeated rows get the same verdict.  Very long texts are
counted whole.  Words that stand in as many texts are common in code-point order.  Distances
at a limit reach it.  An empty table gives no rows.  Columns of the input are carried in a
struct, so their names cannot clash with those made here.  Repeated windows are found by 64-bit
hashes: two different windows of one text are taken for equal with odds of n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discframe.llm.common import cut_lineage, spaces, text_of

SPACE = r"[\x20\x09-\x0D]"
#: Character classes; whatever is left is the last one.
CLASSES = {
    "lower": "[a-z]",
    "space": SPACE,
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "stop": "[.,;:]",
    "mark": r"['\"()?!\-]",
    "other_script": r"[^\x00-\x7F]",
    "symbol": "[#*$%&|<>]",
}
WINDOW = 5


def _words(text: Column) -> Column:
    """The words of a text; trimmed first, so that the split leaves no empty ends."""
    inner = F.btrim(text, F.lit(spaces))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def common_words(docs: DataFrame, text: str, lang: str, count: int) -> DataFrame:
    """Per language its *count* words found in the most texts, as one array."""
    word = F.explode(F.array_distinct(_words(text_of(text))))
    seen = docs.select(F.col(lang).alias("__lang"), word.alias("w")).groupBy("__lang", "w").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = Window.partitionBy("__lang").orderBy(F.desc("n"), "w")
    top = seen.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= count)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])
    longest = F.max(F.octet_length("w")).alias("__longest")
    return cut_lineage(top.groupBy("__lang").agg(listed.alias("__common"), longest))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """*fn* of *value*, which is computed once however often *fn* names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _summed(values: Column, zero: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(zero), lambda a, b: a + b)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words of ``__words`` covered by windows found twice or more."""
    last = F.size("__words") - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn(
        "__windows", F.transform(starts, lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(WINDOW)]))
    )
    # Most texts repeat nothing; only the others are sorted.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__placed", F.when(repeats, placed))

    def again(row: Column, at: Column) -> Column:
        beside = [F.get("__placed", at + d)["h"] == row["h"] for d in (-1, 1)]
        return F.coalesce(beside[0], F.lit(False)) | F.coalesce(beside[1], F.lit(False))

    rows = rows.withColumn("__again", F.sort_array(F.transform(F.filter("__placed", again), lambda r: r["i"])))
    width = F.lit(WINDOW)
    fresh = F.transform(
        "__again", lambda v, i: F.least(width, F.coalesce(F.get("__again", i + 1) - v, width)).cast("bigint")
    )
    return rows.withColumn("n_repeat_words", F.coalesce(_summed(fresh), F.lit(0).cast("bigint")))


def features(docs: DataFrame, common: DataFrame, text: str, lang: str, carry: list[str]) -> DataFrame:
    """Counts of every text: words, lines, repeats, and the two histograms as arrays."""
    rows = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("__kept"), F.col(lang).alias("__lang"), text_of(text).alias("__text")
    )
    known = common.withColumnRenamed("__lang", "__name")
    rows = rows.join(known, F.col("__lang").eqNullSafe(F.col("__name")), "left").drop("__name")
    # Classes are taken out one after the other; what is left gets short quickly.
    rest, sizes = "__text", {}
    for name, pattern in CLASSES.items():
        rows = rows.withColumn(f"__no_{name}", F.regexp_replace(rest, f"(?:{pattern})+", ""))
        sizes[name] = F.length(rest) - F.length(f"__no_{name}")
        rest = f"__no_{name}"
    chars = F.array(*[n.cast("bigint") for n in (*sizes.values(), F.length(rest))])
    rows = _with_repeats(rows.withColumn("__words", _words(F.col("__text"))))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Each word stands between two blanks of its own, so taking a common word out shortens
    # the text by its length and the blanks for every time it is there.
    # Words longer than every common one are left out before.
    rows = rows.withColumn("__common", F.coalesce("__common", F.array().cast("array<string>")))
    brief = F.filter("__words", lambda w: F.octet_length(w) <= F.col("__longest"))
    spaced = F.concat(F.lit(" "), F.array_join(brief, "  "), F.lit(" "))
    rows = rows.withColumns({"__lines": lines, "__spaced": spaced})

    def count(word: Column) -> Column:
        out = F.replace(F.col("__spaced"), F.concat(F.lit(" "), word, F.lit(" ")), F.lit(""))
        gone = F.octet_length("__spaced") - F.octet_length(out)
        return (gone / (F.octet_length(word) + 2)).cast("bigint")

    found = F.transform("__common", count)
    counts = _let(found, lambda n: F.concat(F.array(F.size("__words") - _summed(n)), n))
    return rows.select(
        "__kept",
        "__lang",
        F.size("__words").cast("bigint").alias("n_words"),
        (F.length("__text") - sizes["space"]).cast("bigint").alias("word_chars"),
        sizes["symbol"].cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        chars.alias("__chars"),
        counts.alias("__hist"),
    )


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays of counts; 0 if one is empty."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    def compared(totals: Column) -> Column:
        all_, ref = totals["a"], totals["b"]
        parts = F.zip_with(counts, reference, lambda a, b: term(a / all_, b / ref) + term(b / ref, a / all_))
        value = F.sqrt(F.greatest(F.lit(0.0), _summed(parts, "double") / 2))
        return F.when((all_ > 0) & (ref > 0), value).otherwise(F.lit(0.0))

    return _let(F.struct(_summed(counts).alias("a"), _summed(reference).alias("b")), compared)


def references(rows: DataFrame, common_count: int) -> DataFrame:
    """Per language the summed histograms ``__ref_chars`` and ``__ref_hist``, and its words."""
    sums = [F.sum(F.get("__chars", F.lit(i))) for i in range(len(CLASSES) + 1)]
    hist = [F.coalesce(F.sum(F.get("__hist", F.lit(i))), F.lit(0)) for i in range(common_count + 1)]
    summed = rows.groupBy(F.col("__lang").alias("__name")).agg(
        F.array(*sums).alias("__ref_chars"), F.array(*hist).alias("__ref_hist"), F.sum("n_words").alias("__ref_words")
    )
    return cut_lineage(summed)


def _beside(rows: DataFrame, refs: DataFrame) -> DataFrame:
    # One row per language, read from a file: the planner knows its size and picks the join.
    return rows.join(refs, F.col("__lang").eqNullSafe(F.col("__name")), "left").drop("__name")


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    *,
    common_count: int = 50,
    min_words: int = 10,
    far: float = 0.28,
    near_chars: float = 0.16,
    near_words: float = 0.20,
    noise: float = 0.5,
    carry: list[str] | None = None,
) -> DataFrame:
    """*carry* (the key by default) with the counts, ``char_distance``, ``word_distance``,
    ``base_failed`` and ``kept``, one row per row of *docs*."""
    kept = [key] if carry is None else carry
    rows = cut_lineage(features(docs, common_words(docs, text, lang, common_count), text, lang, kept))
    near = F.col("d") <= F.col("__mean")
    first = _beside(rows.select("__lang", "n_words", "__chars", "__hist"), references(rows, common_count))
    first = first.withColumn("d", distance(F.col("__chars"), F.col("__ref_chars")))
    away = first.filter(F.col("d") > 0)
    means = away.groupBy(F.col("__lang").alias("__name")).agg(
        (F.count(F.lit(1)) / F.sum(1 / F.col("d"))).alias("__mean")
    )
    refs = references(_beside(first, cut_lineage(means)).filter(near | F.col("__mean").isNull()), common_count)
    rows = _beside(rows, refs)
    chars, words = F.col("char_distance"), F.col("word_distance")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


    def chance(bins: int, counts: Column, reference: Column) -> Column:
        """How far histograms of that many counts are from one another by chance."""
        spread = 1 / F.greatest(counts, F.lit(1)) + 1 / F.greatest(F.coalesce(reference, F.lit(1)), F.lit(1))
        return F.lit(noise * math.sqrt(bins / (8 * math.log(2)))) * F.sqrt(spread)

    by_chance = chance(len(CLASSES), _summed(F.col("__chars")), _summed(F.col("__ref_chars")))
    words_by_chance = chance(common_count, F.col("n_words"), F.col("__ref_words"))
    diverges = (chars >= far + by_chance) | ((chars >= near_chars + by_chance) & (words >= near_words + words_by_chance))
    return (
        rows.withColumns(
            {
                "char_distance": F.coalesce(distance(F.col("__chars"), F.col("__ref_chars")), F.lit(0.0)),
                "word_distance": F.coalesce(distance(F.col("__hist"), F.col("__ref_hist")), F.lit(0.0)),
                "base_failed": failed,
            }
        )
        .withColumn("kept", ~F.col("base_failed") & ~diverges)
        .select(
            *[F.col("__kept")[c].alias(c) for c in kept],
            *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance"],
            *["base_failed", "kept"],
        )
    )
