"""Jaccard join on word n-grams: size-banded tiles, bitmap bounds, exact intersections.

Two texts link when the Jaccard similarity of their sets of *n*-word shingles reaches
``num / den`` (75 / 100).  Only the components of these links are exact: no link that joins two
components is lost, but links between texts that are joined already are not looked for, so links
are neither returned nor counted.  No group is expanded into all its pairs.

1. **Sets.**  Equal texts are one text.  Texts are dealt to batches by a hash; a batch turns
   each text into a sorted array of 64-bit shingle hashes.  Equal sets are one node.
2. **Frequencies.**  A batch asks, bucket by bucket, how often its distinct shingles occur in
   the corpus; the answer is one byte per shingle.  A shingle that every text has is asked
   for once per batch, so no bucket grows with it.
3. **Prefixes.**  With shingles in order of (frequency, hash), linked sets share one of the
   first ``size - ceil(t * size) + 1``.  Shingles of one text only cannot be shared: a text
   with that many of them has no partner and stops here.
4. **Tiles.**  The other nodes stand in tiles (prefix shingle, size band); a band spans a
   factor above ``1 / t``, so partners are in the same or the next one.
5. **Stars.**  In every tile all nodes are compared with two of them, picked by a hash: at most
   two pairs per tile row.  A pair is first bounded from above by its parity bitmaps
   (``overlap <= (|a| + |b| - differing bits) / 2``), then intersected exactly.
6. **Rest.**  Tiles that still hold several components compare their nodes across
   components, under the same bound, in blocks of a fixed number of rows.

Nulls and texts without words have no shingles and link with nothing.  Keys may repeat or be
null; a component is named by its least key that is not null.  Repeated rows are one node and
give a row each.  An empty table gives an empty result.  Very long texts are read whole.
Columns other than key and text are not read, whatever they are called; the key itself may
not be called ``name``, ``root`` or ``n_shingles``.  Shingles are compared by 64-bit hashes: in
a corpus of n distinct ones a false match of two has odds of n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discframe.llm.common import cut_lineage, one_or_more_words, text_of, upper_ascii
from discframe.llm.components import components

LOWER = bytes.maketrans(upper_ascii.encode(), upper_ascii.lower().encode())
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes per batch and shingles per bucket: what one task holds at a time.
BATCH_BYTES = 8 << 20
BUCKET_SHINGLES = 3_000_000
BLOCK_ROWS = 2000
BAND = 1.34


def shingle_set(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of all *n*-word shingles; shorter texts are one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(n, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - k + 1
    out = np.full(count, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * MIX + hashes[i : i + count]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def prefix_length(size, num: int, den: int):
    return size - -(-num * size // den) + 1


def _width(size: int) -> int:
    """Bits of a bitmap: eight or more per shingle, so that few differences cancel out."""
    return min(8192, max(256, 8 << (int(size) - 1).bit_length()))


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of hashes that fall on it."""
    width = _width(len(tokens))
    odd = np.bincount((tokens % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The same bitmap at a smaller width."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _enough(overlap, a, b, num: int, den: int):
    """overlap / (a + b - overlap) >= num / den, in integers."""
    return overlap * (den + num) >= num * (a + b)


class _Batch:
    """The sets of the texts of one batch, and their distinct shingles in order."""

    def __init__(self, names: list[bytes], texts: list[str], n: int):
        self.names, self.sets, self.owner = names, {}, []
        for text in texts:
            tokens = shingle_set(text, n)
            digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
            self.owner.append((digest, len(tokens)))
            if digest is not None:
                self.sets[digest] = tokens
        every = np.concatenate(list(self.sets.values())) if self.sets else np.zeros(0, np.uint64)
        self.distinct, self.counts = np.unique(every, return_counts=True)

    def edges(self, buckets: int) -> np.ndarray:
        """Where each bucket (an equal part of the hash range) ends among the distinct ones."""
        tops = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.distinct, tops), [len(self.distinct)]])


def _pack(values: np.ndarray, low: int, shift: int) -> bytes:
    """40 bits of each value's place in its bucket, byte plane by byte plane."""
    inside = (values - np.uint64(low)) >> np.uint64(shift)
    return inside.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return out.reshape(-1).view(np.uint64)


def _batches(docs: DataFrame, text: str, count: int) -> DataFrame:
    """(batch, name, text) of the different texts; copies within a map task go once."""

    def distinct(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = part.column(0).to_pylist()
            first = {name: i for i, name in enumerate(names)}
            yield part.take(pa.array(sorted(first.values()), pa.int64()))

    named = docs.select(_name(text).alias("name"), text_of(text).alias("text"))
    return named.mapInArrow(distinct, named.schema).withColumn("batch", F.pmod(F.xxhash64("name"), F.lit(count)))


def _name(text: str) -> Column:
    return F.unhex(F.md5(text_of(text).cast("binary")))


def _frequencies(batches: DataFrame, n: int, buckets: int) -> DataFrame:
    """Per batch and bucket one byte per distinct shingle: 0 if only one set has it."""
    shift = max(0, 64 - 40 - (buckets - 1).bit_length() + 1)

    def ask(group: pa.Table) -> pa.Table:
        made = _Batch(group["name"].to_pylist(), group["text"].to_pylist(), n)
        ends = made.edges(buckets)
        rows = [i for i in range(buckets) if ends[i + 1] > ends[i]]
        counts = np.minimum(made.counts, 255).astype(np.uint8)
        return pa.table(
            {
                "batch": pa.array([group["batch"][0].as_py()] * len(rows), pa.int64()),
                "bucket": pa.array(rows, pa.int32()),
                "shingles": [
                    _pack(made.distinct[ends[i] : ends[i + 1]], (i << 64) // buckets, shift) for i in rows
                ],
                "counts": [counts[ends[i] : ends[i + 1]].tobytes() for i in rows],
            },
            schema=pa.schema(
                [("batch", pa.int64()), ("bucket", pa.int32()), ("shingles", pa.binary()), ("counts", pa.binary())]
            ),
        )

    def answer(group: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in group["shingles"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in group["counts"].to_pylist()])
        _, where = np.unique(np.concatenate(parts), return_inverse=True)
        found = np.bincount(where, weights=counts)[where]
        level = np.where(found > 1, np.minimum(255, np.ceil(8 * np.log2(found))), 0).astype(np.uint8)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table(
            {
                "batch": group["batch"],
                "bucket": group["bucket"],
                "levels": pa.array([x.tobytes() for x in np.split(level, cuts)], pa.binary()),
            }
        )

    asked = batches.groupBy("batch").applyInArrow(ask, "batch long, bucket int, shingles binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket int, levels binary")


def _signatures(batches: DataFrame, levels: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One row per text: its set's digest and size, and, if it can have a partner, the
    prefix, the bitmap and the whole set."""
    schema = pa.schema(
        [
            ("name", pa.binary()),
            ("node", pa.binary()),
            ("size", pa.int64()),
            ("prefix", pa.list_(pa.int64())),
            ("bits", pa.binary()),
            ("tokens", pa.binary()),
        ]
    )

    def sign(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        made = _Batch(texts["name"].to_pylist(), texts["text"].to_pylist(), n)
        ordered = answers.sort_by("bucket")["levels"].to_pylist()
        level = np.frombuffer(b"".join(ordered), np.uint8)
        rows, done = [], set()
        for name, (node, size) in zip(made.names, made.owner):
            row = [name, node, size, None, None, None]
            if node is not None and node not in done:
                done.add(node)
                tokens = made.sets[node]
                own = level[np.searchsorted(made.distinct, tokens)]
                open_ = prefix_length(size, num, den) - int((own == 0).sum())
                if open_ > 0:
                    shared = np.nonzero(own)[0]
                    first = shared[np.argsort(own[shared], kind="stable")[:open_]]
                    row[3:] = tokens[first].view(np.int64), parity_bits(tokens).tobytes(), tokens.tobytes()
            rows.append(row)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "name binary, node binary, size long, prefix array<long>, bits binary, tokens binary"
    return batches.groupBy("batch").cogroup(levels.groupBy("batch")).applyInArrow(sign, kinds)


def _attach(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for end in ("u", "v"):
        own = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        pairs = pairs.join(own, end)
    return pairs


def _verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that link: bitmaps first, whole sets only for what they let through."""

    def bounded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.to_pydict()
            keep = []
            for a, b, x, y in zip(rows["u_size"], rows["v_size"], rows["u_bits"], rows["v_bits"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum())
                keep.append(_enough((a + b - differ) // 2, a, b, num, den))
            yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for x, y in zip(part.column("u_tokens"), part.column("v_tokens")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(_enough(both, len(x), len(y), num, den))
            yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    near = _attach(pairs, nodes, "size", "bits").filter(
        (F.col("u_size") * den >= F.col("v_size") * num) & (F.col("v_size") * den >= F.col("u_size") * num)
    )
    passed = near.select("u", "v", "u_size", "v_size", "u_bits", "v_bits").mapInArrow(bounded, "u binary, v binary")
    return _attach(passed, nodes, "tokens").select("u", "v", "u_tokens", "v_tokens").mapInArrow(exact, "u binary, v binary")


def _tiles(nodes: DataFrame) -> DataFrame:
    """A row per node, prefix shingle and band: its own band, and the next one as a guest."""
    band = F.floor(F.log("size") / F.log(F.lit(BAND))).cast("int")
    rows = nodes.select("node", band.alias("band"), F.explode("prefix").alias("shingle"))
    return rows.select(
        "node", "shingle", F.posexplode(F.array(F.col("band"), F.col("band") + 1)).alias("guest", "tile")
    )


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _stars(tiles: DataFrame) -> DataFrame:
    """Every node of a tile with two of its nodes: those of the least and the greatest hash."""
    spot = F.struct(F.xxhash64("shingle", "node").alias("h"), F.col("node").alias("n"))
    centre = tiles.groupBy("shingle", "tile").agg(
        F.array_distinct(F.array(F.min(spot), F.max(spot))).alias("c"), F.min("guest").alias("g")
    )
    # Guests alone meet in their own band's tile.
    centre = centre.filter((F.size("c") > 1) & (F.col("g") == 0)).select("shingle", "tile", F.explode("c.n").alias("centre"))
    met = tiles.join(centre, ["shingle", "tile"]).filter(F.col("node") != F.col("centre"))
    return met.select(*_ordered(F.col("node"), F.col("centre"))).distinct()


def _across(tiles: DataFrame, nodes: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share a tile and pass the bound."""
    placed = tiles.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("shingle", "tile").agg(
        F.count(F.lit(1)).alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("guest").alias("g")
    )
    mixed = mixed.filter((F.col("lo") != F.col("hi")) & (F.col("g") == 0)).select("shingle", "tile", "k")
    rows = placed.join(mixed, ["shingle", "tile"]).join(nodes.select("node", "size", "bits"), "node")
    # A tile of many rows is cut into blocks; every two blocks meet in a task of their own.
    blocks = F.ceil(F.col("k") / F.lit(BLOCK_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})

    key = ["shingle", "tile", "x", "y"]

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for part in parts:
                yield from zip(*[column.to_pylist() for column in part.columns])

        seen: set[tuple[bytes, bytes]] = set()
        fresh: list[tuple[bytes, bytes]] = []
        for at, rows_ in groupby(each(), key=lambda r: r[:4]):
            for pair in _near_pairs([_Row(*r[4:]) for r in rows_], at[2] != at[3], num, den):
                if pair not in seen:
                    seen.add(pair)
                    fresh.append(pair)
            if len(fresh) > 5000:
                yield _pair_batch(fresh)
                fresh = []
            if len(seen) > 500_000:
                # Only spares repeats within a task; what comes again is dropped below.
                seen.clear()
        yield _pair_batch(fresh)

    sorted_rows = rows.select(*key, "node", "root", "size", "guest", "own", "bits").repartition(*key)
    return sorted_rows.sortWithinPartitions(*key).mapInArrow(compare, "u binary, v binary").distinct()


class _Row(NamedTuple):
    node: bytes
    root: bytes
    size: int
    guest: int
    own: int
    bits: bytes


def _pair_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["u", "v"])


def _near_pairs(rows: list[_Row], two_blocks: bool, num: int, den: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of a tile in different components that the sizes and the bitmaps allow."""
    size = np.array([r.size for r in rows], np.int64)
    raw = [np.frombuffer(r.bits, np.uint64) for r in rows]
    words = min(map(len, raw))
    bits = np.stack([r if len(r) == words else _fold(r, words) for r in raw])
    names: dict[bytes, int] = {}
    root = np.array([names.setdefault(r.root, len(names)) for r in rows])
    home = np.array([r.guest == 0 for r in rows])
    own = np.array([r.own for r in rows])
    for i in range(len(rows) - 1):
        after = slice(i + 1, None)
        ok = (root[after] != root[i]) & (home[after] | home[i])
        ok &= (size[after] * den >= size[i] * num) & (size[i] * den >= size[after] * num)
        if two_blocks:
            ok &= own[after] != own[i]
        at = np.nonzero(ok)[0] + i + 1
        if len(at):
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1).astype(np.int64)
            for j in at[_enough((size[at] + size[i] - differ) // 2, size[at], size[i], num, den)]:
                a, b = rows[i].node, rows[j].node
                yield (a, b) if a < b else (b, a)


def linked(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, n: int = 5, num: int = 75, den: int = 100
) -> DataFrame:
    """*key*, ``name`` (of the text), ``n_shingles`` and ``root`` (of its component, null
    without shingles), one row per row of *docs*."""
    size = docs.agg(F.sum(F.octet_length(text_of(text))).alias("b")).first()["b"] or 0
    batches = _batches(docs, text, 1 + size // BATCH_BYTES)
    levels = _frequencies(batches, n, 1 + size // (6 * BUCKET_SHINGLES))
    signed = cut_lineage(_signatures(batches, levels, n, num, den))
    nodes = cut_lineage(
        signed.filter(F.col("prefix").isNotNull()).select("node", "size", "prefix", "bits", "tokens").dropDuplicates(["node"])
    )
    tiles = cut_lineage(_tiles(nodes))
    stars = cut_lineage(_verified(_stars(tiles), nodes, num, den))
    roots = components(stars)
    rest = cut_lineage(_verified(_across(tiles, nodes, roots, num, den), nodes, num, den))
    roots = components(stars.union(rest))

    texts = signed.select("name", "node", "size").dropDuplicates(["name"]).join(
        roots.select(F.col("u").alias("node"), F.col("v").alias("__root")), "node", "left"
    )
    texts = texts.select("name", F.col("size").alias("n_shingles"), F.coalesce("__root", "node").alias("root"))
    return docs.select(key, _name(text).alias("name")).join(texts, "name")


def with_component(rows: DataFrame, key: str) -> DataFrame:
    """*key*, ``n_shingles`` and ``component_id``: the least key of the component."""
    alone = rows.filter(F.col("root").isNull()).select(key, "n_shingles", F.col(key).alias("component_id"))
    grouped = rows.filter(F.col("root").isNotNull()).select(key, "n_shingles", "root")
    least = grouped.groupBy("root").agg(F.min(key).alias("component_id"))
    return grouped.join(least, "root").select(key, "n_shingles", "component_id").unionByName(alone)


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of *docs* without near duplicates: of each component the row with the least
    key; rows whose text has no words stay."""
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.hex("name")).cast("binary"))
    rows = linked(docs, key, text, **settings)
    first = rows.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(key, "name")).alias("r"))
    first = cut_lineage(first.select("r.*").select(mark.alias("__mark")))
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col(key), _name(text).alias("name"))
    named = named.select("__row", mark.alias("__mark"))
    # Equal rows share their mark; the first of them stays.
    order = Window.partitionBy("__mark").orderBy("__mark")
    chosen = named.join(first, "__mark", "left_semi").withColumn("__at", F.row_number().over(order))
    wordless = docs.filter(~F.coalesce(F.col(text).rlike(one_or_more_words), F.lit(False)))
    return chosen.filter(F.col("__at") == 1).select("__row.*").unionByName(wordless)
