"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

* **Folding.**  Lower case, look-alike letters of other scripts, full-width forms and digits
  or signs used as letters become one letter; ``l`` and ``1`` fold to ``i``, as they are
  taken for one another.  Words are what is left between other characters.
* **Lexicon.**  Words, and beginnings of words that several different words share, which
  toxic texts of the training rows have far more often than the others.  A weight is the
  log ratio of the two rates.  A beginning replaces the longer ones it explains.
* **Exceptions.**  Phrases around a lexicon word that are harmless take the weight of this
  word back, once and no more than it has: those given by name, and all that only harmless
  training texts (*least_texts* of them or more) have.
* **Score.**  A logistic curve over the summed weight, as it is and per square root of the
  number of words, fitted on the same rows.

The fit reads at most about *sample_rows* labelled keys (chosen by a hash of the key), which
bounds all that the driver holds; every text is scored whole, very long ones too.  Labels, languages, sources and keys are never part of a score.

A null or empty text has no match and the lowest score.  Without labelled rows of both
kinds the lexicon is empty and every score is the share of toxic rows (0 without rows).
Repeated rows get equal scores; a labelled key with several rows teaches by one of them.  An
empty table gives no rows.  Columns not named are not read, whatever they are called.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.llm.common import cut_lineage, id_field

# Characters that are read as another letter.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g", "ɑ": "a", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i",
}
FOLD = str.maketrans(LOOK_ALIKE)
INVISIBLE = re.compile("[­​-‍⁠﻿]")
BETWEEN = re.compile(r"[\W_]+")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pathetic fallacy", "pond scum")
PREFIXES = range(4, 8)


def folded(text: str) -> str:
    """The words of *text* in folded form, each between single blanks."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return f" {BETWEEN.sub(' ', text.lower().translate(FOLD)).strip()} "


@dataclass
class Lexicon:
    """Patterns over folded text (a blank marks a word's edge) and their weights."""

    weights: dict[str, float]
    exceptions: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (0.0, 0.0, -10.0)

    def automaton(self):
        import ahocorasick

        # Of a lexicon word: pattern, weight, nothing.  Of an exception: the pattern, what it
        # takes back, and where in it the lexicon words start.
        words = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            words.add_word(pattern, (pattern, weight, ()))
        if not len(words):
            return words
        words.make_automaton()
        covered = {p: tuple({end - len(c) + 1 for end, (c, _, _) in words.iter(p)}) for p in self.exceptions}
        for pattern, weight in self.exceptions.items():
            if covered[pattern]:
                words.add_word(pattern, (pattern, weight, covered[pattern]))
        words.make_automaton()
        return words


def summed(automaton, text: str) -> tuple[float, int]:
    """The weight of all matches, at least 0, and the number of words."""
    if not text or not len(automaton):
        return 0.0, 0
    plain = folded(text)
    best: dict[int, float] = {}
    back: dict[int, float] = {}
    for end, (pattern, weight, covered) in automaton.iter(plain):
        start = end - len(pattern) + 1
        if covered:
            for at in covered:
                back[start + at] = max(weight, back.get(start + at, 0.0))
        else:
            # A word counts once, with its heaviest pattern.
            best[start] = max(weight, best.get(start, 0.0))
    return sum(max(0.0, w - back.get(at, 0.0)) for at, w in best.items()), plain.count(" ") - 1


def inputs(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), weight / math.sqrt(max(1, words))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression (the last one is the constant), by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _candidates(text: str) -> set[str]:
    out = set()
    for word in set(folded(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in PREFIXES if len(word) >= n)
    return out


def _counted(train: DataFrame) -> DataFrame:
    """Per candidate the toxic and other texts that have it, and, for the beginnings of
    words, how many different words begin so in toxic texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, fine = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1)):
                (bad if label.as_py() else fine).update(_candidates(text.as_py() or ""))
            keys = list(bad | fine)
            yield pa.RecordBatch.from_pydict(
                {
                    "c": pa.array(keys, pa.string()),
                    "bad": pa.array([bad[k] for k in keys], pa.int64()),
                    "fine": pa.array([fine[k] for k in keys], pa.int64()),
                }
            )

    counted = train.select("text", "label").mapInArrow(count, "c string, bad long, fine long")
    return counted.groupBy("c").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))


def learn(train: DataFrame, *, least_texts: int, least_weight: float, productive: int) -> Lexicon:
    """A lexicon from rows of ``text`` and ``label`` (0 or 1), whose number is bounded."""
    totals = {bool(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    bad, fine = totals.get(True, 0), totals.get(False, 0)
    if not bad or not fine:
        share = bad / max(1, bad + fine)
        return Lexicon({}, curve=(0.0, 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    rate = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("fine") + 0.5) / (fine + 1))
    strong = (
        _counted(train)
        .withColumn("w", rate)
        .filter((F.col("bad") >= 1) & (F.col("w") > 0))
        .select("c", "bad", "fine", "w")
    )
    # Beginnings need several different words; words that are too rare alone still count there.
    # All that are, whose number the bounded sample bounds.
    rows = strong.filter((F.col("bad") >= least_texts) & (F.col("w") >= least_weight))
    chosen = {r["c"]: r["w"] for r in rows.orderBy("c").collect()}
    stems = {c for c in chosen if not c.endswith(" ")}
    if stems:
        words = strong.filter(F.col("c").endswith(" ") & (F.col("fine") == 0))
        begins = F.explode(F.array(*[F.substring("c", 1, n + 1) for n in PREFIXES])).alias("s")
        several = words.select("c", begins).distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        kept = {r["s"] for r in several.filter(F.col("n") >= productive).collect() if r["s"] in stems}
        for c in stems - kept:
            del chosen[c]
    for c in sorted(chosen, key=len):
        # What a shorter beginning explains as well is dropped.
        if any(c[:n] in chosen and chosen[c[:n]] >= 0.5 * chosen[c] for n in range(5, len(c))):
            del chosen[c]
    given = {folded(e): 0.0 for e in EXCEPTIONS}
    for phrase in given:
        hit = [w for c, w in chosen.items() if c in phrase]
        given[phrase] = max(hit, default=0.0)
    lexicon = Lexicon(chosen, {p: w for p, w in given.items() if w > 0})
    lexicon.exceptions |= _learned_exceptions(train, lexicon, least_texts)
    lexicon.curve = _curve(train, lexicon)
    return lexicon


def _learned_exceptions(train: DataFrame, lexicon: Lexicon, least_texts: int) -> dict[str, float]:
    """Two-word phrases with a lexicon word that only harmless texts have."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found, labels, weights = [], [], []
            for text, label in zip(batch.column(0), batch.column(1)):
                plain = folded(text.as_py() or "")
                seen = {}
                for end, (pattern, weight, covered) in automaton.iter(plain) if len(automaton) else ():
                    if covered:
                        continue
                    start = end - len(pattern) + 1
                    close = plain.index(" ", start + 1)
                    after = plain.find(" ", close + 1)
                    before = plain.rfind(" ", 0, start)
                    if after > 0:
                        phrase = plain[start : after + 1]
                        seen[phrase] = max(weight, seen.get(phrase, 0.0))
                    if before >= 0 and start > 0:
                        phrase = plain[before : close + 1]
                        seen[phrase] = max(weight, seen.get(phrase, 0.0))
                found += seen
                weights += seen.values()
                labels += [int(label.as_py())] * len(seen)
            yield pa.RecordBatch.from_pydict(
                {
                    "p": pa.array(found, pa.string()),
                    "label": pa.array(labels, pa.int32()),
                    "w": pa.array(weights, pa.float64()),
                }
            )

    counted = train.select("text", "label").mapInArrow(phrases, "p string, label int, w double").groupBy("p")
    counted = counted.agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"), F.max("w").alias("w"))
    harmless = counted.filter((F.col("bad") == 0) & (F.col("n") >= least_texts))
    return {r["p"]: r["w"] for r in harmless.collect()}


def _curve(train: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            pairs = [inputs(*summed(automaton, t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()), batch.column(1)],
                ["a", "b", "label"],
            )

    rows = train.select("text", F.col("label").cast("int").alias("label"))
    table = rows.mapInArrow(features, "a double, b double, label int").toArrow()
    x = np.column_stack([table["a"].to_numpy(), table["b"].to_numpy()])
    return tuple(float(v) for v in logistic(x, table["label"].to_numpy().astype(float)))


def training_rows(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable: Column, sample_rows: int
) -> DataFrame:
    """``text`` and ``label`` of about *sample_rows* labelled keys at most, by a hash of the key.

    A key that has several rows gives one of them, the least of its texts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & usable)
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(key, F.col(text).alias("text"))
    met = texts.join(cut_lineage(chosen), key).groupBy(key, "label").agg(F.min("text").alias("text"))
    return cut_lineage(met.select("text", "label"))


def held_out(key: str, folds: int = 5) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    *,
    sample_rows: int = 20_000,
    least_texts: int = 5,
    least_weight: float = 3.0,
    productive: int = 4,
) -> DataFrame:
    """*key*, ``held_out``, ``score`` and ``predicted`` of every row of *docs*.

    Rows whose key has ``crc32 mod 5 = 0`` are held out: their labels are not read.
    """
    train = training_rows(docs, labels, key, text, label, ~held_out(key), sample_rows)
    lexicon = learn(train, least_texts=least_texts, least_weight=least_weight, productive=productive)
    a, b, c = lexicon.curve
    schema = T.StructType([id_field(docs, key), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out = []
            for value in batch.column(1):
                x, y = inputs(*summed(automaton, value.as_py()))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [key, "score"])

    scored = docs.select(key, text).mapInArrow(score, schema)
    return scored.select(
        key,
        F.coalesce(held_out(key), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
