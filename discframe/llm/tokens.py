"""Token counts without token ids: pieces once per distinct pre-token, then a join.

1. Texts are split into pre-tokens; the distinct ones of the whole corpus are counted
   and each is encoded once (``pieces``).
2. The most frequent pre-tokens (*frequent*, a fixed number of entries) are sent to the
   workers, which sum them while they split a text again.
3. The others leave as ``(row, pre-token, count)`` and meet ``pieces`` in a shuffled join.

So a pre-token that every text has never travels, and the broadcast table has a fixed
number of entries at every corpus size.  A row is named by a hash of its key and text, so a
task that runs again after a lost executor names it the same; equal rows are counted together
and given out as often as they came.

A null text is empty and has no tokens; repeated rows give repeated results.  Very long texts
are split whole.  An empty table gives no rows.  Other columns are not read, whatever they are
called.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.llm.common import cut_lineage, id_field

#: Entries of a worker's counter before they are handed on.
FLUSH = 400_000


class PreTokens:
    """The pre-tokens of a byte-level tokenizer file, and how many pieces each has.

    The library's own splitter is exact but slow.  The pattern gives the same pre-tokens
    wherever both take every character for the same class; *odd* holds the characters
    (assigned in later editions of Unicode) where they do not, and texts with one of these
    go to the library.
    """

    def __init__(self, path: str, pattern: str, odd: str = ""):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        added = described["added_tokens"]
        split = described["pre_tokenizer"] or {}
        if described["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level tokenizers without a normalizer are known")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that strip or match whole words are not known")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = frozenset(names)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pattern = regex.compile(pattern)
        # On ASCII alone the classes are plain ranges, which the simpler engine runs faster.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")
        plain = plain.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii = re.compile(plain, re.ASCII)
        self.odd = frozenset(odd)

    def odd_characters(self) -> str:
        """Characters whose class the pattern and the library see differently."""
        points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
        return "".join(self._odd_of(points[i : i + 20_000]) for i in range(0, len(points), 20_000))

    def _odd_of(self, points: list[str]) -> str:
        # Whether a character joins the letter before it and the mark behind it.
        text = "".join(f"a{c}!" for c in points)
        theirs = {end for _, (_, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        ours = {m.end() for m in self.pattern.finditer(text)}
        return "".join(
            c for i, c in enumerate(points) if any((3 * i + k in theirs) != (3 * i + k in ours) for k in (1, 2))
        )

    def _part(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        if not self.odd.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def split(self, text: str) -> list[str]:
        """Added tokens stand for themselves; what lies between is split by the pattern."""
        if self.cut is None or not self.cut.search(text):
            return self._part(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self._part(part)
        return out

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


def token_counts(
    docs: DataFrame,
    path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    *,
    frequent: int = 200_000,
) -> DataFrame:
    """*key*, ``n_bytes`` and ``n_tokens`` of every row of *docs*.

    *path* is a tokenizer file, *pattern* its pre-token pattern; both are read by the
    workers, so the file has to be at the same place everywhere.
    """

    odd = PreTokens(path, pattern).odd_characters()

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = PreTokens(path, pattern, odd), Counter()

        def flush():
            return pa.RecordBatch.from_pydict(
                {"pre": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())}
            )

        for batch in batches:
            for value in batch.column(0):
                seen.update(known.split(value.as_py() or ""))
                if len(seen) > FLUSH:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PreTokens(path, pattern)
        for batch in batches:
            pieces = pa.array(known.pieces(batch.column("pre").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("pre"), batch.column("n"), pieces], ["pre", "n", "pieces"])

    pieces = cut_lineage(
        docs.select(text)
        .mapInArrow(vocabulary, "pre string, n long")
        .groupBy("pre")
        .agg(F.sum("n").alias("n"))
        .mapInArrow(encode, "pre string, n long, pieces long")
    )
    # The least count that at most *frequent* pre-tokens reach, from a histogram of counts.
    step = F.floor(F.log2("n") * 16)
    rest, least = frequent, None
    for row in pieces.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        rest -= row["count"]
        if rest < 0:
            break
        least = row["step"]
    top = pieces.filter(step >= least).toArrow() if least is not None else pieces.limit(0).toArrow()
    table = dict(zip(top["pre"].to_pylist(), top["pieces"].to_pylist()))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = PreTokens(path, pattern, odd), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys = batch.column(0)
                rows: list[bytes] = []
                pre: list[str] = []
                owner: list[bytes] = []
                count: list[int] = []
                size: list[int] = []
                done: list[int] = []
                for name, value in zip(keys.to_pylist(), batch.column(1)):
                    value = value.as_py() or ""
                    named = hashlib.md5(f"{name!r}".encode()).digest() + value.encode()
                    rows.append(hashlib.md5(named).digest())
                    total = 0
                    for p, n in Counter(known.split(value)).items():
                        each = table.get(p)
                        if each is None:
                            pre.append(p)
                            owner.append(rows[-1])
                            count.append(n)
                        else:
                            total += n * each
                    size.append(len(value.encode()))
                    done.append(total)
                # A row of its own for every text; its key meets nothing and spreads.
                here, rare = len(rows), len(pre)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows + owner, pa.binary()),
                        pa.concat_arrays([keys, pa.nulls(rare, keys.type)]),
                        pa.array([f"\x00row{r.hex()}" for r in rows] + pre, pa.string()),
                        pa.array([None] * here + count, pa.int64()),
                        pa.array(size + [None] * rare, pa.int64()),
                        pa.array(done + [None] * rare, pa.int64()),
                    ],
                    ["__row", key, "pre", "__n", "__bytes", "__known"],
                )

    schema = T.StructType(
        [
            T.StructField("__row", T.BinaryType()),
            id_field(docs, key),
            T.StructField("pre", T.StringType()),
            T.StructField("__n", T.LongType()),
            T.StructField("__bytes", T.LongType()),
            T.StructField("__known", T.LongType()),
        ]
    )
    rows = docs.select(key, text).mapInArrow(per_text, schema)
    met = rows.join(pieces.select("pre", "pieces"), "pre", "left")
    part = F.coalesce(F.col("__known"), F.col("__n") * F.col("pieces"))
    summed = met.groupBy("__row").agg(
        F.max(key).alias(key),
        F.max("__bytes").alias("n_bytes"),
        F.sum(part).alias("__sum"),
        F.count("__bytes").alias("__rows"),
    )
    each = F.expr("__sum div __rows").alias("n_tokens")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows")))
    return summed.select(key, "n_bytes", each, times.alias("__time")).drop("__time")
