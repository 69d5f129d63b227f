"""Group spelling variants of a corpus: words one edit apart, found by k-d trees over letter counts.

1. ``words``: distinct words and how often they stand in all texts, summed in tasks first.
2. One edit moves a word's vector of letter counts by an L1 distance of one (a letter more or
   less: lengths n and n+1) or two (a letter replaced: equal lengths).  For each length a k-d
   tree, grown on a sample of at most *sample_words* words, cuts the space into cells of about
   *cell_words* words.  The sample shapes cells only; every word is in the cell it falls into.
3. A word is sent to its own cell (as a point), and to each cell that its search balls touch:
   radius two around it among words of its length, radius one among words a letter longer.
   Cells with more points than *block_words* are dealt to blocks, and searches go to all of them.
4. In a block, a k-d tree over the points answers all searches at once: a box whose distance
   exceeds the radius is pruned with everything below it, and the points left are verified by
   the order of their letters.  Vectors are held as bits (a bit for one of a letter, one for
   two or more), so that boxes and distances are bit counts that never exceed the true ones.  Only sums leave a block: per word the number of near words
   and the best of them, so no list of pairs is written or shuffled.
5. A word's form is its best near word if that is *times* as frequent; roots come by doubling
   the steps along forms, in a number of rounds that follows the greatest count.

Counts and searches are exact for every word.  A null or empty text has no words, a null key
counts as ''.  Very long texts are read whole, and very long words have vectors like others.
Repeated rows count again.  Ties of the best near word go to the smaller in code points.  An
empty table gives no rows.  Columns not named are not read, whatever they are called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discframe.llm.common import cut_lineage, lower_ascii, upper_ascii

FLUSH = 400_000
#: Points of a leaf of the trees in blocks, searches that one step of a leaf compares.
LEAF, STEP = 128, 4096
#: Letters with a count of their own in a block's vectors (the others are counted together).
OWN = 31
_LOWER = str.maketrans(upper_ascii, upper_ascii.lower())


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = 7, noise: int = 31, least_n: int = 2) -> DataFrame:
    """``word`` and its occurrences ``n`` (*least_n* at least) in all of *docs*.

    A word is a run of letters, A-Z lower-cased; where *noise* divides the CRC of key and
    run, the letter at the CRC's place is left out.  Words have *least* letters or more.
    """
    run = re.compile(rf"[A-Za-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
            )
            seen.clear()
            return out

        crc = zlib.crc32
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                if not value:
                    continue
                head = crc(f"{'' if name is None else name}:".encode())
                value = value.lower() if value.isascii() else value.translate(_LOWER)
                for word, n in Counter(run.findall(value)).items():
                    h = crc(word.encode(), head)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    seen[word] += n
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()

    named = docs.select(F.col(key).cast("string"), text)
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


# -- letter counts and trees ---------------------------------------------------------------------


class Alphabet:
    """Numbers for the letters of some words, the most frequent first; one more for any other."""

    def __init__(self, texts: list[str]):
        self.letters = [c for c, _ in sorted(Counter("".join(texts)).items(), key=lambda x: (-x[1], x[0]))]
        order = sorted(range(len(self.letters)), key=self.letters.__getitem__)
        self._points = np.array([ord(self.letters[i]) for i in order], np.uint32)
        self._number = np.array(order, np.int32)

    def spelled(self, texts: list[str]) -> np.ndarray:
        """One row of letter numbers per word; all words have one length."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)
        at = np.minimum(np.searchsorted(self._points, points), len(self._points) - 1)
        return np.where(self._points[at] == points, self._number[at], len(self._points)).astype(np.int32)


def counted(spelled: np.ndarray, letters: int) -> np.ndarray:
    """Letter counts by row; letters numbered from *letters* on are counted together."""
    n = len(spelled)
    flat = np.minimum(spelled, letters) + (np.arange(n) * (letters + 1))[:, None]
    return np.bincount(flat.ravel(), minlength=n * (letters + 1)).reshape(n, letters + 1)


def coded(spelled: np.ndarray) -> np.ndarray:
    """Letter counts up to two as bits: distances of codes are never above those of counts."""
    out = np.zeros(len(spelled), np.uint64)
    for d, column in enumerate(counted(spelled, OWN).T):
        out |= (column >= 1).astype(np.uint64) << np.uint64(2 * d)
        out |= (column >= 2).astype(np.uint64) << np.uint64(2 * d + 1)
    return out


def _halved(vectors: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that split *vectors* most evenly, or None if all are equal."""
    best = None
    for d in np.argsort(-vectors.var(axis=0))[:8].tolist():
        values, counts = np.unique(vectors[:, d], return_counts=True)
        if len(values) == 1:
            break
        below = np.cumsum(counts)[:-1]
        i = int(np.argmin(np.abs(2 * below - len(vectors))))
        off = abs(2 * int(below[i]) - len(vectors))
        if best is None or off < best[0]:
            best = (off, d, int(values[i]))
    return None if best is None else best[1:]


def cells_of(vectors: np.ndarray, letters: list[str], many: float, first: int = 0):
    """A tree ``(letter, count, low, high)`` of about *many* cells, numbered from *first*; how many."""
    split = _halved(vectors) if many > 1.5 and len(vectors) > 1 else None
    if split is None:
        return first, 1
    d, at = split
    low = vectors[:, d] <= at
    share = many * low.mean()
    one, n = cells_of(vectors[low], letters, share, first)
    two, m = cells_of(vectors[~low], letters, many - share, first + n)
    return (letters[d] if d < len(letters) else "", at, one, two), n + m


def cells_met(tree, word: str, radius: int) -> list[int]:
    """The cells of *tree* within L1 distance *radius* of the word's letter counts."""
    out: list[int] = []
    # Node, distance so far, and the part of it owed to each letter.
    todo = [(tree, 0, ())]
    while todo:
        node, away, owed = todo.pop()
        if not isinstance(node, tuple):
            out.append(node)
            continue
        letter, at, low, high = node
        have = word.count(letter)
        near, far, gap = (low, high, at + 1 - have) if have <= at else (high, low, have - at)
        todo.append((near, away, owed))
        before = next((g for c, g in owed if c == letter), 0)
        if away + max(gap - before, 0) <= radius:
            kept = tuple(x for x in owed if x[0] != letter)
            todo.append((far, away + max(gap - before, 0), (*kept, (letter, max(gap, before)))))
    return out


def one_edit(points: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows of letters are one edit apart (equal widths: one replaced; else one more)."""
    width = points.shape[1]
    if longer.shape[1] == width:
        return (points != longer).sum(axis=1) == 1
    left = np.cumprod(points == longer[:, :-1], axis=1).sum(axis=1)
    right = np.cumprod((points == longer[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return left + right >= width


def _bit(codes: np.ndarray) -> np.ndarray | None:
    """Which codes have the bit (a letter, once or twice) that splits them most evenly; None if all are equal."""
    varied = int(np.bitwise_or.reduce(codes) & ~np.bitwise_and.reduce(codes))
    best = None
    for d in range(64):
        if varied >> d & 1:
            has = (codes >> np.uint64(d)) & np.uint64(1) == 1
            off = abs(2 * int(has.sum()) - len(codes))
            if best is None or off < best[0]:
                best = (off, has)
    return None if best is None else best[1]


def pairs_near(points: list[str], searches: list[str], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of points and searches that are one edit apart, each pair once.

    *points* have one length, *searches* the same or one less.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not points or not searches:
        return none
    alphabet = Alphabet(points)
    p, q = alphabet.spelled(points), alphabet.spelled(searches)
    code_p, code_q = coded(p), coded(q)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(np.arange(len(points)), np.arange(len(searches)))]
    while todo:
        mine, ask = todo.pop()
        box, codes = code_p[mine], code_q[ask]
        low, high = np.bitwise_and.reduce(box), np.bitwise_or.reduce(box)
        away = np.bitwise_count(low & ~codes) + np.bitwise_count(codes & ~high)
        ask = ask[away <= radius]
        if not len(ask):
            continue
        has = _bit(box) if len(mine) > LEAF else None
        if has is not None:
            todo += [(mine[~has], ask), (mine[has], ask)]
            continue
        # In slices: words of equal codes cannot be split, however many there are.
        for start in range(0, len(ask), STEP):
            some = ask[start : start + STEP]
            for from_ in range(0, len(mine), LEAF):
                few = mine[from_ : from_ + LEAF]
                i, j = np.nonzero(np.bitwise_count(code_q[some][:, None] ^ code_p[few][None]) <= radius)
                i, j = some[i], few[j]
                real = one_edit(q[i], p[j])
                if real.any():
                    found.append((j[real], i[real]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none


# -- the distributed search ----------------------------------------------------------------------

_NEAR = "word string, n_near long, best_n long, best string"


def _grown(known: DataFrame, cell_words: int, sample_words: int) -> dict[int, object]:
    """A tree of cells for each length."""
    sizes = {r["length"]: r["count"] for r in known.groupBy(F.length("word").alias("length")).count().collect()}
    total = sum(sizes.values())
    share = min(1.0, sample_words / total) if total else 1.0
    # A sample by hash, the same on every run; at most *sample_words* words come to the driver.
    drawn = known.filter(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    by_length: dict[int, list[str]] = {}
    for word in drawn.select("word").limit(sample_words).toArrow()["word"].to_pylist():
        by_length.setdefault(len(word), []).append(word)
    trees: dict[int, object] = {}
    for length, size in sizes.items():
        sample = by_length.get(length, [])
        if sample and size > cell_words:
            alphabet = Alphabet(sample)
            vectors = counted(alphabet.spelled(sample), len(alphabet.letters))
            trees[length] = cells_of(vectors, alphabet.letters, size / cell_words)[0]
        else:
            trees[length] = 0
    return trees


def near_words(known: DataFrame, *, cell_words: int = 20_000, block_words: int = 100_000, sample_words: int = 100_000) -> DataFrame:
    """``word``, ``n_near`` and the best near word (``best``, ``best_n``) of the rows ``word, n``.

    Words without a near word have no row.  *known* is read three times: a written table.
    """
    trees = _grown(known, cell_words, sample_words)

    def dealt_to(cells_of_word):
        """A row for each ``(length, cell)`` that *cells_of_word* names for a word."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 5000):
                    part = batch.slice(at, 5000)
                    out: list[tuple[int, int, int]] = []
                    for i, word in enumerate(part.column(0).to_pylist()):
                        out += [(i, length, cell) for length, cell in cells_of_word(word)]
                    row, length, cell = zip(*out)
                    taken = [part.column(k).take(pa.array(row)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(length, pa.int32()), pa.array(cell, pa.int32()), *taken], ["length", "cell", "word", "n"]
                    )

        return known.select("word", "n").mapInArrow(route, "length int, cell int, word string, n long")

    def place(word: str):
        return [(len(word), cells_met(trees[len(word)], word, 0)[0])]

    def balls(word: str):
        size = len(word)
        more = [(size + 1, c) for c in cells_met(trees[size + 1], word, 1)] if size + 1 in trees else []
        return [(size, c) for c in cells_met(trees[size], word, 2)] + more

    points, searches = dealt_to(place), dealt_to(balls)
    cell = ["length", "cell"]
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block_words)).cast("int").alias("blocks")
    sizes = points.groupBy(*cell).agg(blocks)
    hashed = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = points.join(sizes, cell).withColumn("block", hashed).drop("blocks")
    asked = searches.join(sizes, cell).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(points: pa.Table, searches: pa.Table) -> pa.Table:
        mine, n_mine = points["word"].to_pylist(), points["n"].to_numpy()
        found: list[pa.Table] = []
        lengths = np.array([len(w) for w in searches["word"].to_pylist()], np.int64)
        size = len(mine[0]) if mine else 0
        for radius, length in ((2, size), (1, size - 1)):
            at = np.flatnonzero(lengths == length)
            if not mine or not len(at):
                continue
            asked = searches.take(pa.array(at))
            words, n_asked = asked["word"].to_pylist(), asked["n"].to_numpy()
            j, i = pairs_near(mine, words, radius)
            found.append(_best(words, i, mine, j, n_mine))
            if radius == 1:
                # Equal lengths meet from both sides, others only from the shorter word.
                found.append(_best(mine, j, words, i, n_asked))
        return pa.concat_tables(found) if found else _best([], np.zeros(0, int), [], np.zeros(0, int), np.zeros(0, int))

    partial = dealt.groupBy(*cell, "block").cogroup(asked.groupBy(*cell, "block")).applyInArrow(search, _NEAR)
    order = F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))
    return (
        partial.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(order).alias("o"))
        .select("word", "n_near", (-F.col("o.m")).alias("best_n"), F.col("o.best").alias("best"))
    )


def _best(words: list[str], at: np.ndarray, near: list[str], near_at: np.ndarray, near_n: np.ndarray) -> pa.Table:
    """Per word of the pairs (*at*, *near_at*): how many near words, and the best of them."""
    if len(at):
        ranks = np.empty(len(near), np.int64)
        ranks[np.array(sorted(range(len(near)), key=near.__getitem__), np.int64)] = np.arange(len(near))
        order = np.lexsort((ranks[near_at], -near_n[near_at], at))
        at, near_at = at[order], near_at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([first, [len(at)]]))
    else:
        first = count = np.zeros(0, np.int64)
    best = near_at[first] if len(first) else first
    return pa.table(
        {
            "word": pa.array([words[i] for i in (at[first] if len(first) else first)], pa.string()),
            "n_near": pa.array(count, pa.int64()),
            "best_n": pa.array(near_n[best] if len(first) else count, pa.int64()),
            "best": pa.array([near[i] for i in best], pa.string()),
        }
    )


def forms(known: DataFrame, near: DataFrame, times: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root``."""
    more = F.col("best_n") >= times * F.col("n")
    joined = known.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(more, F.col("best")).alias("form"),
        F.when(more, F.col("best_n")).alias("form_n"),
    )
    table = cut_lineage(joined)
    # A step multiplies the count by *times* at least, so a chain has few steps.
    most = table.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, times))) if times > 1 else 1
    at = cut_lineage(table.select("word", F.col("form").alias("to")).filter("to IS NOT NULL"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        onward = at.select(F.col("word").alias("to"), F.col("to").alias("then"))
        at = cut_lineage(at.join(onward, "to", "left").select("word", F.coalesce("then", "to").alias("to")))
    return table.join(at, "word", "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    least: int = 7,
    noise: int = 31,
    least_n: int = 2,
    times: int = 10,
    cell_words: int = 20_000,
    block_words: int = 100_000,
    sample_words: int = 100_000,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of *docs*."""
    known = cut_lineage(words(docs, key, text, least=least, noise=noise, least_n=least_n))
    near = near_words(known, cell_words=cell_words, block_words=block_words, sample_words=sample_words)
    return forms(known, near, times)
