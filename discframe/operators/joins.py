"""Joins: as-of, interval overlap, overlays, matches and similarity pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discframe.operators import ordered as o
from discframe.operators.aggregate import set_signature
from discframe.session import cut_lineage


def map_tracks(streams: DataFrame, tracks: DataFrame) -> DataFrame:
    """Container track of every stream: by source id, else by position, else -1.

    Streams: ``title_id, pos, type, type_index, pid, sub_id, muxable``; tracks:
    ``title_id, track_id, type, number``.  Audio without a pid may also carry the
    private-stream number ``(sub_id << 32) | 0xBD``.  Lookup sides are reduced to one
    row per key first, so a stream never multiplies.
    """
    first = tracks.groupBy("title_id", "number").agg(F.min("track_id").alias("_by_id"))
    indexed = o.ordered(tracks, ["title_id", "type"], ["track_id"], _rn=o.row_number())
    placed = indexed.select(
        "title_id", F.col("type").alias("_t"), (F.col("_rn") - 1).alias("_i"), F.col("track_id").alias("_by_pos")
    )
    source = F.coalesce("pid", "sub_id")
    alias = F.when(
        F.col("pid").isNull() & (F.col("type") == "audio"),
        F.shiftleft(F.col("sub_id").cast("long"), 32).bitwiseOR(F.lit(0xBD)),
    )
    ids = (
        streams.select("title_id", "pos", F.explode(F.array_compact(F.array(source.cast("long"), alias))).alias("number"))
        .join(first, ["title_id", "number"])
        .groupBy("title_id", "pos")
        .agg(F.min("_by_id").alias("_by_id"))
    )
    kind = F.when(F.col("type") == "subtitle", "subtitles").otherwise(F.col("type"))
    joined = (
        streams.withColumns({"_t": kind, "_i": F.col("type_index")})
        .join(ids, ["title_id", "pos"], "left")
        .join(placed, ["title_id", "_t", "_i"], "left")
    )
    track = F.when(F.col("muxable"), F.coalesce("_by_id", "_by_pos"))
    how = F.when(~F.col("muxable"), "none").when(F.col("_by_id").isNotNull(), "id").when(
        F.col("_by_pos").isNotNull(), "position"
    ).otherwise("none")
    return joined.withColumns({"track": F.coalesce(track, F.lit(-1)), "how": how}).drop("_t", "_i", "_by_id", "_by_pos")


def overlay(left: DataFrame, right: DataFrame, on: list[str], override: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """Columns of *right* laid over *left*: *override* wins when known, *fill* only fills NULLs."""
    renamed = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in [*override, *fill]])
    joined = left.join(renamed, on, "left")
    values = {c: F.coalesce(F.col(f"_r_{c}"), F.col(c)) for c in override}
    values |= {c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in fill}
    return joined.withColumns(values).select(*left.columns)


def overlay_languages(streams: DataFrame, declared: DataFrame) -> DataFrame:
    """Languages and flags of declared tracks laid over probed streams.

    Declared rows: ``title_id, kind, ordinal, sub_id, lang, is_forced, is_commentary,
    is_hearing_impaired, description``, kinds video/audio/subtitle and the
    picture-in-picture kinds subvideo/subaudio.  A probed stream matches by sub-stream,
    else by position within its type.  A later video, or audio whose known sub-stream no
    (fully known) primary audio has, is picture-in-picture and takes the declared
    secondary tracks in order.
    """
    primary = declared.filter(F.col("kind").isin("video", "audio", "subtitle"))
    flags = ["lang", "is_forced", "is_commentary", "is_hearing_impaired"]
    by_sub = primary.filter(F.col("sub_id").isNotNull()).groupBy("title_id", "kind", "sub_id").agg(
        F.min_by(F.struct(*flags), "ordinal").alias("_sub")
    )
    by_pos = primary.select("title_id", "kind", F.col("ordinal").alias("type_index"), F.struct(*flags).alias("_pos"))
    audio = primary.filter(F.col("kind") == "audio").groupBy("title_id").agg(
        F.bool_and(F.col("sub_id").isNotNull()).alias("_all_known")
    )
    number = F.col("sub_id")
    sub = F.when(number.bitwiseAND(F.lit(0xFFFFFFFF)) == 0xBD, F.shiftright(number, 32))
    probed = (
        streams.withColumns({"kind": F.col("type"), "_number": number})
        .withColumn("sub_id", sub)
        .join(by_sub, ["title_id", "kind", "sub_id"], "left")
        .join(by_pos, ["title_id", "kind", "type_index"], "left")
        .join(audio, "title_id", "left")
    )
    secondary = F.when(F.col("type") == "video", F.col("type_index") > 0).otherwise(
        (F.col("type") == "audio")
        & F.col("sub_id").isNotNull()
        & F.coalesce("_all_known", F.lit(False))
        & F.col("_sub").isNull()
    )
    flagged = probed.withColumn("secondary", secondary)
    ranked = o.ordered(flagged, ["title_id", "type", "secondary"], ["pos"], _rn=o.row_number())
    pip_kind = F.when(F.col("kind") == "subvideo", "video").otherwise("audio")
    pip = declared.filter(F.col("kind").isin("subvideo", "subaudio")).select(
        "title_id", pip_kind.alias("type"), (F.col("ordinal") + 1).alias("_rn"), F.lit(True).alias("secondary"),
        F.struct("lang", "description").alias("_pip"),
    )
    joined = ranked.join(pip, ["title_id", "type", "_rn", "secondary"], "left")
    hit = F.coalesce("_sub", "_pos")
    plain = ~F.col("secondary")

    def joined_flag(name: str) -> Column:
        return F.col(name) | (plain & F.coalesce(hit[name], F.lit(False)))

    language = F.when(plain, hit["lang"]).otherwise(F.col("_pip.lang"))
    label = F.when(F.length(F.col("_pip.description")) > 0, F.col("_pip.description")).otherwise("Picture-in-picture")
    return joined.withColumns(
        {
            "lang": F.coalesce(language, F.col("lang")),
            "is_default": F.col("is_default") & plain,
            "is_forced": joined_flag("is_forced"),
            "is_commentary": joined_flag("is_commentary"),
            "is_hearing_impaired": joined_flag("is_hearing_impaired"),
            "label": F.when(~plain, label),
            "sub_id": F.col("_number"),
        }
    ).drop("kind", "_number", "_sub", "_pos", "_all_known", "_rn", "_pip")


# --- disc and title matching ---------------------------------------------------------

STRONG_KINDS = ("hash", "fingerprint", "global")


def match_discs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Catalog entry of each local disc.

    Local: ``disc_id, kind, value`` rows (kinds hash, fingerprint, global, upc); remote:
    ``remote_id, ordinal, signature, kind, value``.  Strong hits decide when all share
    one signature (the lowest ordinal stands for them); without any strong hit a UPC
    carried by exactly one entry does.  The remote side is reduced to one row per
    identifier first, so copies of one release cost nothing per local disc.
    """
    value = F.when(F.col("kind") == "fingerprint", F.col("value")).otherwise(F.upper("value"))
    usable = F.col("value").isNotNull() & (F.col("value") != "")
    per_value = (
        remote.filter(usable)
        .withColumn("value", value)
        .groupBy("kind", "value")
        .agg(
            F.min("signature").alias("_sig_lo"),
            F.max("signature").alias("_sig_hi"),
            F.min(F.struct("ordinal", "remote_id")).alias("_first"),
            F.min("remote_id").alias("_id_lo"),
            F.max("remote_id").alias("_id_hi"),
        )
    )
    hits = local.filter(usable).withColumn("value", value).join(per_value, ["kind", "value"])
    strong = F.col("kind").isin(*STRONG_KINDS)
    per_disc = hits.groupBy("disc_id").agg(
        F.min(F.when(strong, F.col("_sig_lo"))).alias("_lo"),
        F.max(F.when(strong, F.col("_sig_hi"))).alias("_hi"),
        F.min(F.when(strong, F.col("_first"))).alias("_strong"),
        F.min(F.when(~strong & (F.col("_id_lo") == F.col("_id_hi")), F.col("_id_lo"))).alias("_upc"),
    )
    has_strong = F.col("_strong").isNotNull()
    agreed = F.col("_lo") == F.col("_hi")
    matched = per_disc.select(
        "disc_id",
        F.when(has_strong, F.when(agreed, F.col("_strong.remote_id"))).otherwise(F.col("_upc")).alias("remote_id"),
        (has_strong & ~agreed).alias("ambiguous"),
    )
    return (
        local.select("disc_id")
        .distinct()
        .join(matched, "disc_id", "left")
        .withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    )


def correlate_titles(titles: DataFrame, keys: DataFrame, remote_titles: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Title-to-catalog-title pairs of matched discs.

    Titles: ``disc_id, title_id, duration``; keys: ``title_id, source_key``; remote:
    ``disc_id, remote_title, source_key, duration``.  A title needs exactly one
    candidate within *tolerance*, and a disc keeps its pairs only when no catalog title
    is hit twice.  The join runs on key and duration bucket, so one popular key spreads.
    """
    bucket = F.floor(F.col("duration") / tolerance)
    near = F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b")
    wanted = titles.join(keys.distinct(), "title_id").select(
        "disc_id", "title_id", "source_key", F.col("duration").alias("_d"), near
    )
    offered = remote_titles.select("disc_id", "remote_title", "source_key", "duration", bucket.alias("_b"))
    pairs = wanted.join(offered, ["disc_id", "source_key", "_b"]).filter(
        F.abs(F.col("duration") - F.col("_d")) <= tolerance
    )
    single = (
        pairs.groupBy("disc_id", "title_id")
        .agg(F.min("remote_title").alias("remote_title"), F.max("remote_title").alias("_other"))
        .filter(F.col("remote_title") == F.col("_other"))
        .drop("_other")
    )
    repeated = (
        single.groupBy("disc_id", "remote_title").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    )
    return single.join(repeated.select("disc_id").distinct(), "disc_id", "left_anti")


def undeclared(found: DataFrame, declared: DataFrame, on: list[str], ident: str) -> DataFrame:
    """Ids present in the data, absent from the declaration and not 0."""
    seen = found.select(*on, ident).distinct().filter(F.col(ident) != 0)
    return seen.join(declared.select(*on, ident).distinct(), [*on, ident], "left_anti")


# --- similarity pairs -------------------------------------------------------------------


def shared_items(df: DataFrame, group: str, ident: str, item: str, k: int = 3) -> DataFrame:
    """Members of a group sharing at least *k* distinct items.

    Members with the same item set collapse into one representative (``members_a``,
    ``members_b`` count them; a row with ``a = b`` says its members share all items).
    Representatives meet through a prefix filter: ordered from rare to common items,
    two sets sharing *k* items must share one of their first ``size - k + 1``, so common
    items generate no candidates.  Every candidate is verified exactly.
    """
    pairs, reps = _similar_pairs(df, group, ident, item, k)
    twins = reps.filter((F.col("members") > 1) & (F.col("n") >= k)).select(
        group,
        F.col("rep").alias("a"),
        F.col("rep").alias("b"),
        F.col("n").alias("shared"),
        F.col("members").alias("members_a"),
        F.col("members").alias("members_b"),
    )
    return pairs.select(group, "a", "b", "shared", "members_a", "members_b").unionByName(twins)


def representatives(df: DataFrame, group: str, ident: str, item: str) -> tuple[DataFrame, DataFrame]:
    """``(members, reps)``: every member with its representative, and one row per set."""
    signed = set_signature(df, [group, ident], item)
    members = cut_lineage(o.with_group(signed, [group, "n", "sig_a", "sig_b"], rep=F.min(ident)))
    reps = members.groupBy(group, "rep", "n").agg(F.count(F.lit(1)).alias("members"))
    return members.select(group, ident, "rep", "n"), reps


def _similar_pairs(df: DataFrame, group: str, ident: str, item: str, k: int) -> tuple[DataFrame, DataFrame]:
    df = cut_lineage(df.select(group, ident, item).distinct())
    members, reps = representatives(df, group, ident, item)
    big = reps.filter(F.col("n") >= k).select(group, F.col("rep").alias("_id"), "n", "members")
    sets = df.select(group, F.col(ident).alias("_id"), item).join(big, [group, "_id"])
    common = sets.groupBy(group, item).agg(F.count(F.lit(1)).alias("_freq"))
    useful = sets.join(common.filter(F.col("_freq") > 1), [group, item])
    ranked = o.ordered(useful, [group, "_id"], ["_freq", item], _rank=o.row_number())
    # Items nobody else has are first in the order and use up prefix places for free.
    alone = F.col("n") - F.col("_useful")
    sized = cut_lineage(o.with_group(ranked, [group, "_id"], _useful=F.count(F.lit(1))))
    prefix = sized.filter(F.col("_rank") + alone <= F.col("n") - k + 1).select(group, "_id", item)
    left = prefix.select(group, item, F.col("_id").alias("a"))
    right = prefix.select(group, item, F.col("_id").alias("b"))
    candidates = left.join(right, [group, item]).filter(F.col("a") < F.col("b")).select(group, "a", "b").distinct()
    items_a = sized.select(group, F.col("_id").alias("a"), item)
    items_b = sized.select(group, F.col("_id").alias("b"), item)
    shared = (
        candidates.join(items_a, [group, "a"])
        .join(items_b, [group, "b", item])
        .groupBy(group, "a", "b")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") >= k)
    )
    count_a = big.select(group, F.col("_id").alias("a"), F.col("members").alias("members_a"))
    count_b = big.select(group, F.col("_id").alias("b"), F.col("members").alias("members_b"))
    return shared.join(count_a, [group, "a"]).join(count_b, [group, "b"]), reps


MICROS = 1_000_000


def micros(value: str | Column) -> Column:
    """A number of seconds as whole millionths, in which comparisons are exact."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * MICROS).cast("long")


def near_ranges(df: DataFrame, group: str, value: str, share: tuple[int, int] = (15, 100), unit: int = 1) -> DataFrame:
    """Neighbourhood of every distinct value: rows within a relative tolerance.

    Two values are near when ``|a - b| / max(a, b, unit) <= share`` (share as a
    fraction).  Values are taken in whole millionths (``v``, ``lo`` and ``hi`` are), so
    the test is exact for fractions too.  Instead of listing pairs, each distinct value gets the range it covers: ``near`` = number of rows in it, and
    ``rank_lo``/``rank_hi`` = rows of the group below it and up to its end, which
    identify the neighbourhood.  One running count over values and range ends answers
    all of them.
    """
    num, den = share
    unit *= MICROS
    counted = df.groupBy(group, micros(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    v = F.col("v")
    low = v - F.expr(f"greatest(v, {unit}) * {num} div {den}")
    far = F.expr(f"v * {den} div {den - num}")
    close = F.least(v + F.lit(unit * num // den), F.lit(unit))
    high = F.when(far >= unit, far).otherwise(F.greatest(v, close))
    ranged = counted.select(group, "v", "n", low.cast("long").alias("lo"), high.cast("long").alias("hi"))
    # At equal positions: range starts before values, range ends after them.
    marks = F.array(
        F.struct(F.col("lo").alias("at"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("w")),
        F.struct(F.col("v").alias("at"), F.lit(1).alias("side"), F.col("n").alias("w")),
        F.struct(F.col("hi").alias("at"), F.lit(2).alias("side"), F.lit(0).cast("long").alias("w")),
    )
    exploded = ranged.select(group, "v", "n", "lo", "hi", F.explode(marks).alias("m")).select(
        group, "v", "n", "lo", "hi", "m.*"
    )
    run = o.ordered(exploded, group, ["at", "side", "v"], _upto=o.sum_to("w"))
    return (
        run.groupBy(group, "v", "n", "lo", "hi")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("_upto"))).alias("rank_lo"),
            F.max(F.when(F.col("side") == 2, F.col("_upto"))).alias("rank_hi"),
        )
        .withColumn("near", F.col("rank_hi") - F.col("rank_lo"))
    )


# --- intervals -----------------------------------------------------------------------------


def asof_interval(
    points: DataFrame, intervals: DataFrame, key: str | list[str], at: str, start: str, payload: list[str], epsilon: float = 0.0
) -> DataFrame:
    """The interval with the rightmost start at or before each point (plus *epsilon*).

    Union, one ordered pass, last start carried forward: no range join.
    """
    key = [key] if isinstance(key, str) else list(key)
    carried = F.struct(F.col(start).alias("start"), *payload)
    # The key travels once.
    point = F.struct(*[c for c in points.columns if c not in key])
    left = intervals.select(
        *key, F.col(start).cast("double").alias("_at"), F.lit(0).alias("_side"), carried.alias("_iv"),
        F.lit(None).cast(points.select(point).schema[0].dataType).alias("_pt"),
    )
    right = points.select(
        *key, (F.col(at) + epsilon).cast("double").alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(left.schema["_iv"].dataType).alias("_iv"), point.alias("_pt"),
    )
    filled = o.ordered(left.unionByName(right), key, ["_at", "_side"], _in=o.last_to("_iv"))
    names = ["start", *payload]
    return filled.filter(F.col("_side") == 1).select(
        *[c if c in key else F.col(f"_pt.{c}") for c in points.columns],
        *[F.col(f"_in.{n}").alias(f"{n}" if n != "start" else "iv_start") for n in names]
    )


def beside(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """*rows* joined with the one row that *known* has per *key*.

    Union and one ordered pass, as in ``asof_interval``: where both are dealt by a part of
    the key already, nothing is shuffled.  Not for keys that may be hot.
    """
    payload, own = ([c for c in t.columns if c not in key] for t in (known, rows))
    kinds = {n: t.select(F.struct(*columns)).schema[0].dataType for n, t, columns in (("_known", known, payload), ("_row", rows, own))}
    left = known.select(*key, F.lit(0).alias("_side"), F.struct(*payload).alias("_known"), F.lit(None).cast(kinds["_row"]).alias("_row"))
    right = rows.select(*key, F.lit(1).alias("_side"), F.lit(None).cast(kinds["_known"]).alias("_known"), F.struct(*own).alias("_row"))
    filled = o.ordered(left.unionByName(right), key, ["_side"], _in=o.last_to("_known"))
    met = filled.filter((F.col("_side") == 1) & F.col("_in").isNotNull())
    return met.dropna(subset=key).select(*key, *[F.col(f"_row.{c}") for c in own], *[F.col(f"_in.{c}") for c in payload])


def overlap_join(
    left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, epsilon: float = 0.0
) -> DataFrame:
    """Overlaps of two lists of disjoint ``[start, end)`` intervals per key.

    A sweep over all boundaries: between two neighbouring boundaries the current
    interval of each side is known, so the work is linear where a range join would
    compare every pair of a key.  Pieces at most *epsilon* long are dropped.
    """

    def edges(df: DataFrame, ident: str, name: str) -> DataFrame:
        real = df.filter(F.col("end") > F.col("start"))
        opened = F.struct(F.col(ident).alias("id"), "start", "end")
        kind = real.select(opened.alias("x")).schema[0].dataType
        ends = F.array(
            F.struct(F.col("start").cast("double").alias("at"), F.lit(1).alias("side"), F.struct(opened.alias("x")).alias("e")),
            F.struct(F.col("end").cast("double").alias("at"), F.lit(0).alias("side"), F.struct(F.lit(None).cast(kind).alias("x")).alias("e")),
        )
        return real.select(key, F.explode(ends).alias("m")).select(
            key, "m.at", "m.side", F.col("m.e").alias(name)
        )

    a = edges(left, left_id, "_a")
    b = edges(right, right_id, "_b")
    both = a.withColumn("_b", F.lit(None).cast(b.schema["_b"].dataType)).unionByName(
        b.withColumn("_a", F.lit(None).cast(a.schema["_a"].dataType))
    )
    swept = o.ordered(
        both, key, ["at", "side"], _la=o.last_to("_a"), _lb=o.last_to("_b"), _next=o.lead("at")
    )
    pieces = swept.filter(
        F.col("_la.x").isNotNull() & F.col("_lb.x").isNotNull() & (F.col("_next") - F.col("at") > epsilon)
    )
    return pieces.select(
        key,
        F.col("_la.x.id").alias(left_id),
        F.col("_lb.x.id").alias(right_id),
        F.col("at").alias("start"),
        F.col("_next").alias("end"),
        F.col("_la.x.start").alias("left_start"),
        F.col("_lb.x.start").alias("right_start"),
    )


def assign_owner(units: DataFrame, cells: DataFrame, on: list[str], low: Column, high: Column) -> DataFrame:
    """Owning cell of each unit inside ``[low, high]``; the first cell of an id owns it."""
    owner = cells.groupBy(*on).agg(F.min("pos").alias("owner"))
    return units.filter(F.col("sector").between(low, high)).join(owner, on)


def require_all(keys: DataFrame, required: list, actual: DataFrame, key: str, item: str) -> DataFrame:
    """The required items (a short literal list) each key lacks."""
    wanted = keys.select(key).distinct().withColumn(item, F.explode(F.array(*[F.lit(x) for x in required])))
    return wanted.join(actual.select(key, item).distinct(), [key, item], "left_anti")


def drop_incompatible(tracks: DataFrame, key: str = "title_id") -> DataFrame:
    """Items kept for appending: audio channels equal the first item's where both known.

    Tracks: ``title_id, item, track_id, channels`` with one row per audio track.
    """
    first = tracks.filter(F.col("item") == 0).groupBy(key, "track_id").agg(F.max("channels").alias("_want"))
    compared = tracks.join(first, [key, "track_id"], "left")
    clash = (F.col("channels") != F.col("_want")) & (F.col("item") > 0)
    per_item = compared.groupBy(key, "item").agg(F.bool_or(F.coalesce(clash, F.lit(False))).alias("dropped"))
    return per_item


def best_movie(queries: DataFrame, movies: DataFrame) -> DataFrame:
    """Best search hit per query: same-year hits if there are any, then popularity order.

    Queries: ``query_id, name, year``; movies: ``name, movie_id, year, rank``.  Movies
    reduce to one per (name, year) and one per name before the joins, so a query meets two.
    """
    per_year = movies.groupBy("name", "year").agg(F.min(F.struct("rank", "movie_id")).alias("_m"))
    per_name = per_year.groupBy("name").agg(F.min("_m").alias("_any"))
    found = queries.join(per_name, "name").join(per_year, ["name", "year"], "left")
    order = F.struct(F.col("_m").isNull().alias("other"), F.coalesce("_m", "_any").alias("_m"))
    return found.groupBy("query_id").agg(F.min(order).alias("_b")).select(
        "query_id", "_b._m.movie_id", (~F.col("_b.other")).alias("same_year")
    )


def redistribute(orphans: DataFrame, missing: DataFrame, group: str, order: list[str], ident: str) -> DataFrame:
    """Hand ordered orphan rows round-robin to the group's sorted missing ids."""
    ranked = o.ordered(orphans, group, order, _rn=o.row_number())
    targets = o.ordered(missing.select(group, ident).distinct(), group, [ident], _slot=o.row_number())
    sized = targets.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    slots = ranked.join(sized, group).withColumn("_slot", ((F.col("_rn") - 1) % F.col("_n") + 1).cast("int"))
    return slots.join(targets, [group, "_slot"]).drop("_rn", "_n", "_slot")


def streams_from_ids(ids: DataFrame, attributes: DataFrame, languages: DataFrame, key: str = "title_id") -> DataFrame:
    """Stream rows from enabled ids with attribute and language defaults, by attribute key.

    Ids: ``title_id, stream_id, attr``; attributes: ``title_id, attr, codec, channels``;
    languages: ``title_id, attr, lang``.
    """
    joined = ids.join(attributes, [key, "attr"], "left").join(languages, [key, "attr"], "left")
    filled = joined.withColumns(
        {
            "codec": F.coalesce(F.lower("codec"), F.lit("ac3")),
            "channels": F.coalesce("channels", F.lit(2)),
            "lang": F.coalesce("lang", F.lit("und")),
        }
    )
    ranked = o.ordered(filled, key, ["attr", "stream_id"], _rn=o.row_number())
    return ranked.withColumn("type_index", F.col("_rn") - 1).drop("_rn")


def inherited_ids(cells: DataFrame, ids: DataFrame, group: str, ident: str, cell: str) -> DataFrame:
    """Ids a title enables itself plus those of titles sharing a cell with it.

    Ids: ``group, ident, stream_id, attr``.  Its own entry wins, then the lowest title's.
    Ids gather per cell first, so titles meet their cells' id lists, not each other.
    """
    distinct = cells.select(group, ident, cell).distinct()
    per_cell = (
        distinct.join(ids, [group, ident])
        .groupBy(group, cell, "stream_id")
        .agg(F.min(F.struct(ident, "attr")).alias("_other"))
    )
    reached = (
        distinct.join(per_cell, [group, cell])
        .groupBy(group, ident, "stream_id")
        .agg(F.min("_other").alias("_other"))
    )
    own = ids.select(group, ident, "stream_id", F.col("attr").alias("_own"))
    both = own.join(reached, [group, ident, "stream_id"], "full")
    return both.select(
        group, ident, "stream_id", F.coalesce("_own", "_other.attr").alias("attr"), F.col("_own").isNotNull().alias("own")
    )


def lookup_relaxed(rows: DataFrame, entries: DataFrame, exact: list[str], relaxed: str, order: str, payload: str) -> DataFrame:
    """Entry by the full key, else the first entry with the *relaxed* part alone."""
    full = entries.groupBy(*exact).agg(F.max_by(payload, order).alias("_full"))
    part = entries.groupBy(relaxed).agg(F.min_by(payload, order).alias("_part"))
    joined = rows.join(full, exact, "left").join(part, relaxed, "left")
    return joined.withColumn(payload, F.coalesce("_full", "_part")).withColumn(
        "exact", F.col("_full").isNotNull()
    ).drop("_full", "_part")


def first_title(titles: DataFrame, group: str, ordinal: str, value: str) -> DataFrame:
    return titles.groupBy(group).agg(F.min_by(value, ordinal).alias(value))
