"""Align two tokenizers over a corpus, and count which ids of one stand where which of the other do.

Both libraries cut the same bytes.  Places where tokens of both end cut a text into groups;
a link is a pair of token occurrences whose byte ranges overlap; the count of an id pair is
the number of documents that hold it linked.

1. First pass: every document's distinct pairs, summed inside a task, leave it as
   ``(part, pair, n)``.
2. The distinct pairs are dealt to shards by a hash; each shard gets a minimal perfect hash
   (``perfect_hash``: levels of bits, a pair's place is the rank of its bit), at three or four
   bits a pair, and its keys in this order.
3. Counts become dense vectors indexed by the hash, one per shard and ``FAN`` parts, which are
   summed up a tree, ``FAN`` at a time; no group holds more than ``FAN`` vectors of a shard.
4. Second pass: documents are aligned again and look their pairs up.  A look-up compares the
   key at its place with the pair and fails if they differ.  The table goes to the workers while
   it has at most *table_pairs* pairs, a bound on its bytes; beyond, documents are written with
   their pairs, which meet the counts in a shuffled join.

A text that is null or empty, or whose tokens of either side do not join to the bytes of
blank and text, has no tokens: counts are 0 and the digest is ''.  Very long texts are
aligned whole, one at a time.  Repeated rows are documents of
their own; ties of a best count are all best; an empty table gives no rows.  Columns not
named are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.llm.common import cut_lineage, id_field
from discframe.llm.vocabularies import Pieces, byte_level

#: Bytes of text aligned at once, pairs that a task sums before it hands them on.
BATCH_BYTES, FLUSH = 1 << 20, 2_000_000
#: Pairs of a shard; parts that meet in one vector, and vectors that meet in one sum.
SHARD_PAIRS, FAN = 1 << 14, 256


@dataclass
class Aligned:
    """The links of some texts, in order.

    ``row`` are the texts that have tokens; per text ``n_a``, ``n_b`` and ``n_groups``, and where
    its links end; per link its ``pairs`` (A's id above B's); ``groups`` are written ids.
    """

    row: list[int]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    ends: np.ndarray
    pairs: np.ndarray
    groups: list[str]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's links."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return np.diff(sums[np.concatenate([[0], self.ends])])


class Aligner:
    """Aligns texts by a byte-level file A and a ``sentencepiece`` model B."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        self.a, self.b = byte_level(path_a, pattern), Pieces(path_b)
        if not self.a.lossless:
            raise ValueError(f"{path_a}: only byte-level files without a normalizer are known")
        self.size_a = np.zeros(1 + max(self.a.bytes), np.int64)
        for i, t in self.a.bytes.items():
            self.size_a[i] = len(t)
        self.size_b = self.b.sizes
        # Every id with the sign behind it: next of the side, other side, next group.
        self.signed = [f"{i}{sign}" for sign in ",|" for i in range(len(self.size_a))]
        self.at_b = len(self.signed)
        self.signed += [f"{i}{sign}" for sign in ",;" for i in range(len(self.size_b))]

    def align(self, texts: list[str], write_groups: bool) -> Aligned:
        """The texts behind a blank; those that are empty or whose bytes differ are left out."""
        row: list[int] = []
        all_a: list[list[int]] = []
        all_b: list[np.ndarray] = []
        raw_size: list[int] = []
        some = [i for i, t in enumerate(texts) if t]
        for i, (ids_b, equal) in zip(some, self.b.checked([texts[i] for i in some])):
            if equal:
                row.append(i)
                all_a.append(self.a.plain_ids(" " + texts[i]))
                all_b.append(ids_b)
                raw_size.append(1 + len(texts[i].encode()))
        n_a, n_b = [np.array([len(x) for x in ids], np.int64) for ids in (all_a, all_b)]
        a = np.fromiter(chain.from_iterable(all_a), np.int64, int(n_a.sum()))
        b = np.concatenate([np.zeros(0, np.int64), *all_b])
        # The bytes of all texts in a row, and where tokens of either side end.
        total = sum(raw_size)
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[np.cumsum(self.size_a[a])], is_b[np.cumsum(self.size_b[b])] = True, True
        # Between two ends of any side lie one token of A and one of B: a link.
        cuts = np.flatnonzero(is_a | is_b)
        at_a, at_b = is_a[cuts], is_b[cuts]
        both = at_a & at_b
        i_a, i_b = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b
        ends = np.searchsorted(cuts, np.cumsum(np.array(raw_size, np.int64)), side="right")
        out = Aligned(row, n_a, n_b, np.zeros(0, np.int64), ends, a[i_a] << 32 | b[i_b], [])
        out.n_groups = out.per_text(both.astype(np.int64))
        if write_groups and row:
            last_a, last_b = i_a[both], i_b[both]
            code_a, code_b = a.copy(), b + self.at_b
            code_a[last_a] += len(self.size_a)
            code_b[last_b] += len(self.size_b)
            in_group = []
            for last, n in ((last_a, len(a)), (last_b, len(b))):
                first = np.zeros(n + 1, np.int64)
                first[last + 1] = 1
                in_group.append(np.cumsum(first[:n]))
            order = np.argsort(np.concatenate([2 * in_group[0], 2 * in_group[1] + 1]), kind="stable")
            written = list(map(self.signed.__getitem__, np.concatenate([code_a, code_b])[order].tolist()))
            stops = np.cumsum(n_a + n_b).tolist()
            out.groups = ["".join(written[x:y])[:-1] for x, y in zip([0, *stops], stops)]
        return out


@cache
def aligner_of(path_a: str, path_b: str, pattern: str) -> Aligner:
    """One per worker process, with the words it remembers."""
    return Aligner(path_a, path_b, pattern)


# -- minimal perfect hash ------------------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits per key, another function for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def perfect_hash(keys: np.ndarray, room: float = 1.5) -> list[np.ndarray]:
    """Bit levels of a minimal perfect hash of distinct *keys*.

    On each level a key that has a bit for itself keeps it; the others go to the next level.
    """
    levels, left = [], keys
    while len(left):
        size = max(8, int(len(left) * room))
        at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


class PerfectHash:
    """Places of keys by *levels*; with *keys*, look-ups are verified."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        before = 0
        for bits in levels:
            ranks = np.cumsum(bits) - 1 + before
            self.ranks.append(ranks.astype(np.int64))
            before += int(bits.sum())
        self.size = before

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key of the set; of others any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def _packed(levels: list[np.ndarray]) -> bytes:
    head = np.array([len(levels), *map(len, levels)], np.int64).tobytes()
    return head + b"".join(np.packbits(bits).tobytes() for bits in levels)


def _unpacked(data: bytes) -> PerfectHash:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    at, levels = 8 * (n + 1), []
    for size in sizes:
        width = -(-int(size) // 8)
        levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=int(size)).astype(bool))
        at += width
    return PerfectHash(levels)


class PairTable:
    """Counts of pairs over all shards, by verified look-ups."""

    def __init__(self, shards: list[tuple[bytes, bytes, bytes]], best: np.ndarray):
        self.shards = [
            (_unpacked(h), np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)) for h, keys, counts in shards
        ]
        self.best = best

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        shard = shard_of(pairs, len(self.shards))
        order = np.argsort(shard, kind="stable")
        stops = np.searchsorted(shard[order], np.arange(len(self.shards)), side="right")
        for (places, keys, counts), mine in zip(self.shards, np.split(order, stops[:-1])):
            at = places.places(pairs[mine])
            if len(mine) and ((at < 0) | (keys[np.maximum(at, 0)] != pairs[mine])).any():
                raise KeyError("a pair of the second pass was not counted in the first")
            out[mine] = counts[at]
        return out


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(pairs, 1 << 20) % np.uint64(shards)).astype(np.int64)


# -- the passes ----------------------------------------------------------------------------------


def _stream(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (column *at*), of about ``BATCH_BYTES`` or one text."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > BATCH_BYTES:
                part = whole.slice(start, i - start)
                yield part, [v or "" for v in part.column(at).to_pylist()]
                start, total = i, 0
            total += size
        if whole.num_rows:
            part = whole.slice(start)
            yield part, [v or "" for v in part.column(at).to_pylist()]


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]]))
    return pairs[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def pair_counts(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", *, shard_pairs: int = SHARD_PAIRS):
    """``shard, hash, keys, counts`` (a row per shard, vectors as bytes), and how many pairs there are."""

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b, pattern)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, texts in _stream(batches, 0):
            found = aligner.align(texts, False)
            # Once per document that holds a pair.
            document = np.repeat(np.arange(len(found.row)), np.diff(found.ends, prepend=0))
            order = np.lexsort((document, found.pairs))
            pairs, document = found.pairs[order], document[order]
            first = np.concatenate([np.ones(min(1, len(pairs)), bool), (pairs[1:] != pairs[:-1]) | (document[1:] != document[:-1])])
            held.append(_summed(pairs[first], np.ones(int(first.sum()), np.int64)))
            size += len(held[-1][0])
            if size > FLUSH:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(*map(np.concatenate, zip(*held)))], ["pair", "n"])

    part = cut_lineage(docs.select(text).mapInArrow(first_pass, "pair long, n long").withColumn("part", F.spark_partition_id()))
    distinct = cut_lineage(part.select("pair").distinct())
    total = distinct.count()
    shards = max(1, -(-total // shard_pairs))

    def with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard_of(pairs, shards), pa.int64())], [*batch.schema.names, "shard"]
            )

    def build(table: pa.Table) -> pa.Table:
        keys = table["pair"].to_numpy()
        made = perfect_hash(keys)
        ordered = np.empty(len(keys), np.int64)
        ordered[PerfectHash(made).places(keys)] = keys
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int64()),
                "hash": pa.array([_packed(made)], pa.binary()),
                "keys": pa.array([ordered.tobytes()], pa.binary()),
            }
        )

    hashes = cut_lineage(
        distinct.mapInArrow(with_shard, "pair long, shard long")
        .groupBy("shard")
        .applyInArrow(build, "shard long, hash binary, keys binary")
    )

    branches = 1 + (part.agg(F.max("part")).first()[0] or 0) // FAN
    branch = F.floor(F.col("part") / F.lit(FAN)).alias("branch")
    dealt = part.select("pair", "n", branch).mapInArrow(with_shard, "pair long, n long, branch long, shard long")
    below = hashes.select("shard", "hash", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))).alias("branch"))

    def dense(rows: pa.Table, hashed: pa.Table) -> pa.Table:
        place = _unpacked(hashed["hash"][0].as_py())
        vector = np.zeros(place.size, np.int64)
        if rows.num_rows:
            np.add.at(vector, place.places(rows["pair"].to_numpy()), rows["n"].to_numpy())
        return pa.table({"shard": hashed["shard"], "branch": hashed["branch"], "counts": pa.array([vector.tobytes()], pa.binary())})

    kinds = "shard long, branch long, counts binary"
    vectors = dealt.groupBy("shard", "branch").cogroup(below.groupBy("shard", "branch")).applyInArrow(dense, kinds)

    def add(table: pa.Table) -> pa.Table:
        summed = np.sum([np.frombuffer(v.as_py(), np.int64) for v in table["counts"]], axis=0)
        first = table.slice(0, 1)
        return pa.table({"shard": first["shard"], "branch": first["branch"], "counts": pa.array([summed.tobytes()], pa.binary())})

    while branches > 1:
        branches = -(-branches // FAN)
        up = F.floor(F.col("branch") / F.lit(FAN)).alias("branch")
        vectors = vectors.select("shard", up, "counts").groupBy("shard", "branch").applyInArrow(add, kinds)
    return cut_lineage(hashes.join(vectors.drop("branch"), "shard")), total


def _listed(table: DataFrame) -> DataFrame:
    """``pair, count`` of every pair of a table of shards."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(v.as_py(), np.int64)) for v in (keys, counts)], ["pair", "count"]
                )

    return table.select("keys", "counts").mapInArrow(rows, "pair long, count long")


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    *,
    table_pairs: int = 4_000_000,
    shard_pairs: int = SHARD_PAIRS,
    carry_groups: bool = False,
) -> DataFrame:
    """*key*, ``n_a n_b n_groups n_links n_best count_sum`` and ``groups_sha256`` of every row of *docs*.

    *path_a* is a byte-level file of ``tokenizers`` (with its pre-token *pattern*), *path_b* a
    ``sentencepiece`` model; workers read both.  With *carry_groups*, ``groups`` has the aligned
    groups themselves.
    """
    table, total = pair_counts(docs, path_a, path_b, pattern, text, shard_pairs=shard_pairs)
    listed = _listed(table)
    of_a = F.shiftright("pair", 32)
    # At most an entry per id of A.
    best = listed.groupBy(of_a.alias("a")).agg(F.max("count").alias("best"))
    fields = [id_field(docs, key), *[T.StructField(c, T.LongType()) for c in COUNTS]]
    fields += [T.StructField("groups_sha256", T.StringType())]
    if carry_groups:
        fields.append(T.StructField("groups", T.StringType()))
    links = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    by_table = total <= table_pairs
    if not by_table:
        fields.append(T.StructField("links", links))
    schema = T.StructType(fields)
    shared = None
    if by_table:
        held = table.orderBy("shard").select("hash", "keys", "counts").toArrow()
        top = best.toArrow()
        best_of = np.zeros(int(max(top["a"].to_pylist(), default=0)) + 1, np.int64)
        best_of[top["a"].to_numpy()] = top["best"].to_numpy()
        rows = list(zip(*[held[c].to_pylist() for c in ("hash", "keys", "counts")]))
        shared = docs.sparkSession.sparkContext.broadcast((rows, best_of))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b, pattern)
        counted = PairTable(*shared.value) if shared is not None else None
        for batch, texts in _stream(batches, 1):
            found = aligner.align(texts, True)
            rows = np.array(found.row, np.int64)
            numbers = np.zeros((len(COUNTS), len(texts)), np.int64)
            numbers[:4, rows] = found.n_a, found.n_b, found.n_groups, np.diff(found.ends, prepend=0)
            if counted is not None:
                pairs, back = np.unique(found.pairs, return_inverse=True)
                count = counted.counts(pairs)
                hit = (count == counted.best[pairs >> 32]).astype(np.int64)
                numbers[4:, rows] = found.per_text(hit[back]), found.per_text(count[back])
            groups = [""] * len(texts)
            for i, written in zip(found.row, found.groups):
                groups[i] = written
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            columns = [batch.column(0), *map(pa.array, numbers), pa.array(digests, pa.string())]
            if carry_groups:
                columns.append(pa.array(groups, pa.string()))
            if counted is None:
                times: list[list[dict]] = [[] for _ in texts]
                for i, part in zip(found.row, np.split(found.pairs, found.ends[:-1])):
                    times[i] = [{"pair": p, "times": n} for p, n in zip(*(x.tolist() for x in np.unique(part, return_counts=True)))]
                columns.append(pa.array(times, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    second = docs.select(key, text).mapInArrow(second_pass, schema)
    if by_table:
        return second
    # Names of rows are drawn once and written with the pairs.
    written = cut_lineage(second.withColumn("__row", F.expr("uuid()")))
    counts = cut_lineage(listed.join(best, of_a == F.col("a")).select("pair", "count", (F.col("count") == F.col("best")).alias("top")))
    times = F.col("l.times")
    met = (
        written.select("__row", F.explode("links").alias("l"))
        .join(counts, F.col("l.pair") == F.col("pair"))
        .groupBy("__row")
        .agg(F.sum(times * F.col("count")).alias("__sum"), F.sum(F.when(F.col("top"), times).otherwise(0)).alias("__best"))
    )
    return (
        written.join(met, "__row", "left")
        .withColumn("count_sum", F.coalesce("__sum", F.lit(0)).cast("long"))
        .withColumn("n_best", F.coalesce("__best", F.lit(0)).cast("long"))
        .select(*[f.name for f in fields if f.name != "links"])
    )
