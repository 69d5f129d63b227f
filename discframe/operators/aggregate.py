"""Grouped summaries: signatures, digests, modes, medians, best-of and guards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.operators import ordered as o
from discframe.operators.project import stream_counts


def _text(column: str | Column) -> Column:
    """A value as text with NULL kept apart from every string."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("~"))


def layout_signature(
    df: DataFrame, key: str | list[str], order: list[str], columns: list[str | Column]
) -> DataFrame:
    """Identity of an ordered list of rows as ``(n, sig_a, sig_b)`` per key.

    Each row hashes its position together with its values; XOR of two independent
    64-bit hashes combines them in any order, so the list is never collected and
    partial aggregation shrinks hot groups before the shuffle.  Equal lists always
    get equal signatures; unequal ones collide with odds of 2**-128.
    """
    key = [key] if isinstance(key, str) else list(key)
    values = [_text(c) for c in [*order, *columns]]
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(*values)).alias("sig_a"),
        F.bit_xor(F.xxhash64(F.lit("b"), *reversed(values))).alias("sig_b"),
    )


def set_signature(df: DataFrame, key: list[str], item: str) -> DataFrame:
    """Like ``layout_signature`` for a set: distinct items, no order."""
    return layout_signature(df.select(*key, item).distinct(), key, [], [item])


def same_as(signatures: DataFrame, ident: str, scope: list[str] | None = None) -> DataFrame:
    """Add ``same_as``: the smallest *ident* carrying the same signature in *scope*."""
    group = [*(scope or []), "n", "sig_a", "sig_b"]
    return o.with_group(signatures, group, same_as=F.min(ident))


def stream_summary(streams: DataFrame) -> DataFrame:
    """``V:n A:n S:n`` text and which title first had this track layout.

    The layout is the audio and subtitle counts and the audio languages in order.
    """
    counts = stream_counts(streams)
    audio = streams.filter(F.col("type") == "audio")
    placed = o.ordered(audio, "title_id", ["pos"], _rn=o.row_number())
    languages = layout_signature(placed, "title_id", ["_rn"], ["lang"])
    joined = counts.join(languages, "title_id", "left").fillna({"n": 0, "sig_a": 0, "sig_b": 0})
    text = F.format_string("V:%d A:%d S:%d", "n_video", "n_audio", "n_sub").alias("summary")
    return same_as(joined, "title_id", ["n_sub"]).select("title_id", text, "same_as")


def track_layout(streams: DataFrame) -> DataFrame:
    """One ``layout`` hash pair per title for comparing layouts inside other operators."""
    counts = stream_counts(streams)
    audio = streams.filter(F.col("type") == "audio")
    placed = o.ordered(audio, "title_id", ["pos"], _rn=o.row_number())
    languages = layout_signature(placed, "title_id", ["_rn"], ["lang"])
    return (
        counts.join(languages, "title_id", "left")
        .fillna({"n": 0, "sig_a": 0, "sig_b": 0})
        .select("title_id", F.struct("n_audio", "n_sub", "sig_a", "sig_b").alias("layout"))
    )


# --- digests ---------------------------------------------------------------------


def stream_digest(
    df: DataFrame, key: str, order: list[str], chunk: Column, algorithm: str, upper: bool = False
) -> DataFrame:
    """Digest of the concatenated binary *chunk* of a key's rows in *order*.

    The digest is defined over one byte sequence per key, so a key is read in order by
    one task; it streams (sorted with spill, batch by batch) and only the digest state
    is held.  The bytes themselves are produced in parallel before the sort.
    """
    kept = df.select(key, *order, chunk.alias("_chunk"))
    placed = kept.repartition(key).sortWithinPartitions(key, *order)

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        ids, texts, sizes = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
            names=[key, "digest", "n_files"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = [None, None, 0]
        for batch in batches:
            done: list[tuple] = []
            for group, data in zip(batch.column(key).to_pylist(), batch.column("_chunk").to_pylist()):
                if state[1] is None or group != state[0]:
                    if state[1] is not None:
                        done.append((state[0], _hex(state[1], upper), state[2]))
                    state = [group, hashlib.new(algorithm), 0]
                state[1].update(data)
                state[2] += 1
            if done:
                yield rows_of(done)
        if state[1] is not None:
            yield rows_of([(state[0], _hex(state[1], upper), state[2])])

    schema = T.StructType(
        [df.schema[key], T.StructField("digest", T.StringType()), T.StructField("n_files", T.LongType())]
    )
    return placed.mapInArrow(run, schema)


def _hex(digest, upper: bool) -> str:
    text = digest.hexdigest()
    return text.upper() if upper else text


def nfc(df: DataFrame, column: str) -> DataFrame:
    """*column* in Unicode NFC; only non-ASCII texts visit Python, in the same pass."""

    @F.pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    plain = F.length(column) == F.octet_length(column)
    return df.withColumn(column, F.coalesce(normalise(F.when(~plain, F.col(column))), column))


def manifest_fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 over ``path NUL size LF`` entries sorted by the path's UTF-8 bytes."""
    entry = F.concat(
        F.encode("path", "UTF-8"), F.unhex(F.lit("00")), F.encode(F.col("size").cast("string"), "UTF-8"), F.unhex(F.lit("0A"))
    )
    return stream_digest(nfc(files, "path"), "group_id", ["path", "size"], entry, "sha256")


def size_hash(files: DataFrame) -> DataFrame:
    """Upper-case MD5 over the sizes as little-endian 64-bit integers in path order."""
    big_endian = F.lpad(F.hex("size"), 16, "0")
    pairs = [F.substring(big_endian, 15 - 2 * i, 2) for i in range(8)]
    return stream_digest(files, "group_id", ["path", "size"], F.unhex(F.concat(*pairs)), "md5", upper=True)


def content_hash(files: DataFrame, key: str, order: str, content: str, algorithm: str = "md5") -> DataFrame:
    """Digest of whole contents in numeric order; absent files are skipped."""
    present = files.filter(F.col(content).isNotNull())
    return stream_digest(present, key, [order], F.encode(content, "UTF-8"), algorithm)


# --- modes, medians, best-of -------------------------------------------------------


def mode_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value per key; the one seen first wins a tie."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return counted.groupBy(key).agg(
        F.min_by(value, F.struct(-F.col("n"), "_first")).alias(value), F.max("n").alias("n")
    )


def exact_median(values: DataFrame, key: list[str], value: str, interpolate: bool) -> DataFrame:
    """Median per key from value counts: the upper one, or the mean of the middle two.

    Works on one row per distinct value with running counts, so a hot key neither
    collects nor sorts its rows in one place.
    """
    counted = values.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    running = o.ordered(counted, key, [value], _upto=o.sum_to("_n"))
    sized = o.with_group(running, key, _total=F.sum("_n"))

    def pick(index: Column) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col(value)))

    upper = pick(F.floor(F.col("_total") / 2))
    lower = pick(F.floor((F.col("_total") - 1) / 2))
    median = (upper + lower) / 2 if interpolate else upper
    return sized.groupBy(*key).agg(median.alias("median"), F.max("_total").alias("n"))


def median_step(ticks: DataFrame, key: str = "stream_id", value: str = "pts") -> DataFrame:
    """Upper median of the steps between a key's distinct sorted ticks (0 without steps)."""
    distinct = ticks.select(key, value).distinct()
    steps = o.ordered(distinct, key, [value], _next=o.lead(value)).withColumn(
        "step", F.col("_next") - F.col(value)
    )
    medians = exact_median(steps.filter(F.col("step").isNotNull()), [key], "step", interpolate=False)
    return (
        distinct.select(key)
        .distinct()
        .join(medians, key, "left")
        .select(key, F.coalesce("median", F.lit(0)).alias("median_step"))
    )


def argmax(df: DataFrame, key: str, by: list[Column], tie: str, keep: list[str]) -> DataFrame:
    """The row with the largest *by*, the lowest *tie* among equals."""
    best = F.min_by(F.struct(tie, *keep), F.struct(*[-c for c in by], F.col(tie)))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def choose_chain(
    chains: DataFrame, key: str, explicit: Column, designated: Column, order: str
) -> DataFrame:
    """Per key the asked-for chain, else the designated one with cells, else the longest.

    Where a number is asked for (*explicit* not NULL) nothing else will do.
    """
    level = (
        F.when(explicit.isNotNull(), F.when(explicit == F.col(order), 0))
        .when(designated & (F.col("n_cells") > 0), 1)
        .when((F.col("duration") > 0) | (F.col("n_cells") > 0), 2)
    )
    ranked = chains.withColumn("_level", level).filter(F.col("_level").isNotNull())
    rank = F.struct(
        "_level",
        F.when(F.col("_level") == 2, -F.col("duration")).alias("d"),
        F.when(F.col("_level") == 2, -F.col("n_cells")).alias("c"),
        order,
    )
    best = F.min_by(F.struct(order, "duration", "n_cells", F.col("_level").alias("level")), rank)
    return ranked.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def sum_by(df: DataFrame, key: list[str], measure: str) -> DataFrame:
    """Total per composite key; repeats add up."""
    return df.groupBy(*key).agg(F.sum(measure).alias(measure))


def shared_fraction(
    base: DataFrame, others: DataFrame, group: str, ident: str, item: str, measure: str
) -> DataFrame:
    """Share of each group's *base* measure whose items each of *others* also has.

    *base* is one list per group (rows ``group, item, measure``), so the join is linear
    in *others* however many members a group has.
    """
    per_item = base.groupBy(group, item).agg(F.sum(measure).alias("_m"))
    total = per_item.groupBy(group).agg(F.sum("_m").alias("_total"))
    members = others.select(group, ident, item).distinct()
    shared = members.join(per_item, [group, item]).groupBy(group, ident).agg(F.sum("_m").alias("_shared"))
    everyone = others.select(group, ident).distinct().join(total, group)
    fraction = F.coalesce(F.col("_shared"), F.lit(0.0)) / F.col("_total")
    return everyone.join(shared, [group, ident], "left").select(
        group, ident, F.when(F.col("_total") > 0, fraction).otherwise(0.0).alias("share")
    )


# --- verdicts -----------------------------------------------------------------------


def scan_vote(
    frames: DataFrame, key: str = "stream_id", min_frames: int = 24, min_share: float = 0.95
) -> DataFrame:
    """One scan type per stream, NULL while undecided.

    Frames: ``interlaced`` boolean, ``top_field_first`` nullable boolean.
    """
    counted = frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("interlaced").alias("n_interlaced"),
        F.count_if(F.col("interlaced") & F.col("top_field_first")).alias("_top"),
        F.count_if(F.col("interlaced") & ~F.col("top_field_first")).alias("_bottom"),
    )
    return counted.withColumn("scan", vote_verdict(min_frames, min_share)).drop("_top", "_bottom")


def vote_verdict(min_frames: int = 24, min_share: float = 0.95) -> Column:
    top, bottom = F.col("_top"), F.col("_bottom")
    return (
        F.when(F.col("n") < min_frames, F.lit(None).cast("string"))
        .when(F.col("n_interlaced") == 0, "progressive")
        .when(F.col("n_interlaced") < F.lit(min_share) * F.col("n"), F.lit(None).cast("string"))
        .when((top > 0) & (bottom == 0), "tff")
        .when((bottom > 0) & (top == 0), "bff")
    )


def find_sum_member(
    df: DataFrame, key: str, member: Column, measure: str, order: str, share: float = 0.05, minimum: float = 0.0
) -> DataFrame:
    """Per key the first outsider whose measure is within *share* of the members' sum."""
    flagged = df.withColumn("_in", member)
    totals = flagged.filter("_in").groupBy(key).agg(F.sum(measure).alias("total"))
    near = (F.col("total") > 0) & (
        F.abs(F.col(measure) - F.col("total")) <= F.lit(share) * F.col("total")
    )
    outside = flagged.filter(~F.col("_in") & (F.col(measure) >= minimum)).join(totals, key)
    best = F.min_by(F.struct(order, measure, "total"), order)
    return outside.filter(near).groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def dwarfed(
    df: DataFrame, key: str, member: Column, measure: str, exempt: Column | None = None, ratio: float = 3.0
) -> DataFrame:
    """Per key: does an outsider run *ratio* times the longest member?"""
    suspect = ~member if exempt is None else ~member & ~exempt
    per_key = df.groupBy(key).agg(
        F.max(F.when(member, F.col(measure))).alias("longest"),
        F.max(F.when(suspect, F.col(measure))).alias("rival"),
    )
    verdict = F.coalesce(F.col("rival") >= F.col("longest") * ratio, F.lit(False))
    return per_key.withColumn("dwarfed", verdict)


def group_counts(titles: DataFrame, key: list[str], listed: Column) -> DataFrame:
    return titles.filter(listed).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def outcomes(df: DataFrame, key: str, ok: Column) -> DataFrame:
    return df.groupBy(key).agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed")
    )


def credits(df: DataFrame, cast: str, crew: str, releases: str, region: str, top: int = 15) -> DataFrame:
    """People and rating out of nested credit lists, in list order.

    ``cast``: array of struct(name); ``crew``: array of struct(name, department, job);
    ``releases``: array of struct(country, certifications array of string).
    """
    writers = F.filter(crew, lambda p: p["department"] == "Writing")
    directors = F.filter(crew, lambda p: (p["department"] == "Directing") & (p["job"] == "Director"))
    here = F.get(F.filter(releases, lambda r: r["country"] == region), F.lit(0))
    return df.withColumns(
        {
            "cast_names": F.transform(F.slice(cast, 1, top), lambda p: p["name"]),
            "writers": F.transform(
                F.slice(writers, 1, top), lambda p: F.concat(p["name"], F.lit(" ("), p["job"], F.lit(")"))
            ),
            "directors": F.transform(F.slice(directors, 1, top), lambda p: p["name"]),
            "rating": F.get(F.filter(here["certifications"], lambda c: F.length(c) > 0), F.lit(0)),
        }
    )


def any_after_first(items: DataFrame, key: str, flag: Column) -> DataFrame:
    return items.groupBy(key).agg(F.bool_or(flag & (F.col("pos") > 0)).alias("seamless"))


def is_disc_audio_pid(pid: Column) -> Column:
    return pid.between(0x1100, 0x111F) | pid.between(0x1A00, 0x1A1F)


def unambiguous_ids(streams: DataFrame, key: str, ident: str, valid: Column) -> DataFrame:
    """The id set of each title, NULL when an id is unknown, invalid or repeated.

    Valid ids come from a small fixed range, so the set is bounded.
    """
    ok = F.coalesce(valid, F.lit(False))
    known = F.when(ok, F.col(ident))
    per_title = streams.groupBy(key).agg(
        F.bool_and(ok).alias("_valid"),
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_set(known)).alias("_ids"),
    )
    fine = F.col("_valid") & (F.size("_ids") == F.col("_n"))
    return per_title.select(key, F.when(fine, F.array_join(F.col("_ids").cast("array<string>"), ",")).alias("ids"))


def envelope(
    cells: DataFrame, boundaries: DataFrame, total_bytes: Column, span: int = 150_000, sector: int = 2048
) -> DataFrame:
    """Sector and byte range of each chain's cells with the end's fallbacks.

    *boundaries* holds sorted unit starts per chain (``chain_id, sector``).  Without an
    end the unit after the first boundary at or past the last start ends the range,
    then ``last start + span`` clamped to the data.
    """
    zero = (F.col("first_sector") == 0) & (F.col("last_sector") == 0)
    per_chain = cells.groupBy("chain_id").agg(
        F.min(F.when(~zero, F.col("first_sector"))).alias("_start"),
        F.bool_or(zero).alias("_zero"),
        F.min_by(zero, "pos").alias("_zero_first"),
        F.max(F.when(~zero & (F.col("last_sector") > 0), F.col("last_sector"))).alias("_end"),
        F.max_by(F.col("first_sector"), F.when(~zero & (F.col("first_sector") > 0), F.col("pos"))).alias("_last"),
    )
    start = F.when(F.col("_zero_first"), F.least(F.lit(0), "_start")).otherwise(F.col("_start"))
    per_chain = per_chain.withColumn("start_sector", F.coalesce(start, F.when(F.col("_zero"), 0)))
    stops = o.ordered(boundaries, "chain_id", ["sector"], _next=o.lead("sector"))
    after = (
        per_chain.filter(F.col("_end").isNull())
        .join(stops, "chain_id")
        .filter((F.col("sector") >= F.col("_last")) & F.col("_next").isNotNull())
        .groupBy("chain_id")
        .agg((F.min("_next") - 1).alias("_unit_end"))
    )
    limit = F.floor(total_bytes / sector)
    guess = F.when(F.col("_last").isNotNull(), F.least(F.col("_last") + span, limit))
    joined = per_chain.join(after, "chain_id", "left").withColumn(
        "end_sector", F.coalesce("_end", "_unit_end", guess)
    )
    good = joined.filter(F.col("end_sector") > F.col("start_sector"))
    end_byte = F.least((F.col("end_sector").cast("long") + 1) * sector, total_bytes)
    return good.select(
        "chain_id",
        "start_sector",
        "end_sector",
        (F.col("start_sector").cast("long") * sector).alias("start_byte"),
        end_byte.alias("end_byte"),
    ).filter(F.col("end_byte") > F.col("start_byte"))


def rebaseline(ticks: DataFrame, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """Ticks relative to the first sample of their stream."""
    based = o.with_group(ticks, key, _base=F.min_by("pts", order))
    return based.withColumn("rel", F.col("pts") - F.col("_base")).drop("_base")
