"""A quality classifier trained by co-training of two views.

* The **text view** sees what the text is made of: shares of character classes, word and line
  lengths, repeats.
* The **metadata view** sees what is known about the page: its source, language and length,
  hashed and binned.

Each view is a logistic regression.  In every round each view labels the rows of an unlabelled
pool of which it is surest (the same number per label, in the proportion of the labels) and
hands them to the other one.  At the end each view is calibrated on rows kept back from
training (Platt's curve), and the score adds their log odds, less the log odds of the base
rate, which both hold.

Labelled rows and the pool are bounded samples by a hash of the key (*sample_rows* of each);
every row of the table is scored from its whole text.  A null text is empty; null metadata are
a value of their own.  Without labelled rows of both kinds every score is 0.5.  Repeated
rows get equal scores.  Very long texts are read whole.  Rows that are equally sure are taken
in the order of their views' values.  An empty table gives no rows.  Columns not named are not
read, whatever they are called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.llm.common import cut_lineage, id_field
from discframe.llm.toxicity import logistic

SYMBOL = re.compile(r"[#*$%&|<>!]")
MARK = re.compile(r"[.,;:?'\"()-]")
BUCKETS = 64


def text_view(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    different = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    upper = sum(w.isupper() for w in words)
    return [
        math.log1p(len(words)),
        len(SYMBOL.findall(text)) / n,
        len(MARK.findall(text)) / n,
        upper / n,
        sum(w.istitle() for w in words) / n,
        sum(w.isalpha() for w in words) / n,
        sum(map(len, words)) / n / 10,
        sum(len(w) <= 3 for w in words) / n,
        different / n,
        pairs / n,
        math.log1p(len(lines)) / 5,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)),
        text.count("\n") / chars * 100,
    ]


def page_view(source, lang, length) -> list[float]:
    row = [0.0] * (BUCKETS + 12)
    for kind, value in (("source", source), ("lang", lang)):
        row[zlib.crc32(f"{kind}={value}".encode()) % BUCKETS] += 1.0
    row[BUCKETS + (11 if length is None else min(10, int(math.log2(max(1, length)) / 2)))] = 1.0
    return row


class View:
    """A standardised logistic regression with a calibration curve."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = logistic((x - self.mean) / self.scale, y, ridge=1.0)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if 0 < y.sum() < len(y):
            self.curve = logistic(self.raw(x)[:, None], y, ridge=0.1)
        else:
            self.curve = np.array([1.0, 0.0])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.curve[0] * self.raw(x) + self.curve[1], -20, 20)


def surest(view: View, x: np.ndarray, free: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers among *free* that *view* is surest of, and the labels it gives them."""
    raw = view.raw(x[free])
    order = np.argsort(raw, kind="stable")
    low = order[: min(down, len(order))]
    low = low[raw[low] < 0]
    high = order[::-1][: min(up, len(order))]
    high = high[raw[high] > 0]
    return np.concatenate([free[low], free[high]]), np.concatenate([np.zeros(len(low)), np.ones(len(high))])


def co_train(
    text: np.ndarray, page: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_page: np.ndarray, *, rounds: int, per_round: int
) -> tuple[View, View, float]:
    """Both views after *rounds* of exchanging pseudo-labels, calibrated on a fifth of the rows."""
    back = np.arange(len(y)) % 5 == 0
    own = [(text[~back], y[~back]), (page[~back], y[~back])]
    pools = (pool_text, pool_page)
    views = [View().fit(*own[0]), View().fit(*own[1])]
    up = max(1, round(per_round * y.mean()))
    down = max(1, per_round - up)
    free = [np.arange(len(pool_text)), np.arange(len(pool_text))]
    for _ in range(rounds):
        given = [surest(views[i], pools[i], free[i], up, down) for i in (0, 1)]
        for i in (0, 1):
            at, labels = given[1 - i]
            own[i] = (np.concatenate([own[i][0], pools[i][at]]), np.concatenate([own[i][1], labels]))
            free[1 - i] = np.setdiff1d(free[1 - i], at)
        views = [View().fit(*own[0]), View().fit(*own[1])]
    views[0].calibrate(text[back], y[back])
    views[1].calibrate(page[back], y[back])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    return views[0], views[1], math.log(rate / (1 - rate))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    *,
    source: str = "source",
    lang: str = "lang",
    length: str = "n_chars",
    sample_rows: int = 10_000,
    rounds: int = 5,
    per_round: int = 200,
) -> DataFrame:
    """*key*, ``held_out``, ``text_score``, ``page_score``, ``score`` and ``predicted`` per row of *docs*.

    Rows whose key has ``crc32 mod 5 = 0`` are held out: their labels are not read.
    """
    columns = [text, source, lang, length]
    out = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    spot = F.pmod(F.xxhash64(F.lit("co-training"), F.col(key)), F.lit(1_000_000))

    def sampled(rows: DataFrame) -> DataFrame:
        share = min(1.0, sample_rows / max(1, rows.count()))
        return cut_lineage(rows.filter(spot < int(share * 1_000_000)))

    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~out)
    known = sampled(known.groupBy(key).agg(F.max(label).cast("double").alias("__y")))
    rest = sampled(docs.select(key).join(labels.select(key), key, "left_anti").distinct())
    train = docs.select(key, *columns).join(known, key)
    pool = docs.select(key, *columns).join(rest, key).withColumn("__y", F.lit(None).cast("double"))

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(5)]))
            yield pa.RecordBatch.from_pydict(
                {
                    "t": pa.array([text_view(r[0]) for r in rows], pa.list_(pa.float64())),
                    "p": pa.array([page_view(*r[1:4]) for r in rows], pa.list_(pa.float64())),
                    "y": pa.array([r[4] for r in rows], pa.float64()),
                }
            )

    both = train.unionByName(pool).select(*columns, "__y").mapInArrow(views, "t array<double>, p array<double>, y double")
    got = both.toPandas()
    # Rows in a fixed order, so that reruns fit the same views.
    got = got.iloc[sorted(range(len(got)), key=lambda i: (tuple(got["t"].iloc[i]), tuple(got["p"].iloc[i])))]
    marked = got["y"].notna().to_numpy()
    y = got["y"].to_numpy()[marked]
    model = None
    if 0 < y.sum() < len(y) and len(y) >= 10:
        wide = [np.stack(got[c].to_list()) for c in ("t", "p")]
        model = co_train(
            wide[0][marked], wide[1][marked], y, wide[0][~marked], wide[1][~marked], rounds=rounds, per_round=per_round
        )
    schema = T.StructType(
        [id_field(docs, key), *[T.StructField(n, T.DoubleType()) for n in ("text_score", "page_score", "score")]]
    )

    def chance(odds: np.ndarray) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-odds)), pa.float64())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n = batch.num_rows
                if model is None or not n:
                    t = p = base = np.zeros(n)
                else:
                    t = model[0].log_odds(np.array([text_view(x.as_py()) for x in batch.column(1)]))
                    rows = zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)])
                    p = model[1].log_odds(np.array([page_view(*r) for r in rows]))
                    base = np.full(n, model[2])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), chance(t), chance(p), chance(t + p - base)], [key, "text_score", "page_score", "score"]
                )

    return (
        docs.select(key, *columns)
        .mapInArrow(score, schema)
        .select(
            key,
            F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
            *["text_score", "page_score", "score"],
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )
    )
