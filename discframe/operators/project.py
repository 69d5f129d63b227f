"""Filters, labels and per-row decisions over titles, streams and cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discframe.operators import ordered as o
from discframe.session import cut_lineage

MIN_LISTED_SECONDS = 120
PLAIN_SECONDS = 300
SHORT_CLIP_SECONDS = 30
EMPTY_BYTES = 200_000
LOOP_MIN_ITEMS = 5
LOOP_SHARE = 0.9
# 10.08 Mbit/s in 2048-byte sectors per second.
MAX_SECTORS_PER_SECOND = 10_080_000 / 8 / 2048
PADDED_FACTOR = 1.5
INTERLEAVED_FLAG = 4


def stream_counts(streams: DataFrame, key: str = "title_id") -> DataFrame:
    """Track counts per title: video, audio, subtitle, audio with a known language."""
    kind = F.col("type")
    return streams.groupBy(key).agg(
        F.count_if(kind == "video").alias("n_video"),
        F.count_if(kind == "audio").alias("n_audio"),
        F.count_if(kind == "subtitle").alias("n_sub"),
        F.count_if((kind == "audio") & (F.col("lang") != "und")).alias("n_known_audio"),
    )


def item_stats(
    items: DataFrame,
    key: str = "title_id",
    min_items: int = LOOP_MIN_ITEMS,
    share: float = LOOP_SHARE,
) -> DataFrame:
    """Items, runtime, bytes and the loop verdict per title.

    Counting per (title, clip) first keeps the shuffle to one row per distinct clip,
    also for a menu that repeats one clip millions of times.
    """
    per_clip = items.groupBy(key, "clip_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("duration").alias("_d"),
        F.sum("size").alias("_s"),
    )
    return per_clip.groupBy(key).agg(
        F.sum("_n").alias("n_items"),
        F.sum("_d").alias("runtime"),
        F.sum("_s").alias("bytes"),
        ((F.sum("_n") >= min_items) & (F.max("_n") >= F.lit(share) * F.sum("_n"))).alias("looped"),
    )


def is_loop(items: DataFrame, min_items: int = LOOP_MIN_ITEMS, share: float = LOOP_SHARE) -> DataFrame:
    return item_stats(items, min_items=min_items, share=share).select("title_id", "n_items", "looped")


def title_facts(
    titles: DataFrame, streams: DataFrame, items: DataFrame, share: float = LOOP_SHARE, write: bool = False
) -> DataFrame:
    """Titles with their track counts and item statistics.

    *write* makes tables of both first, for less to be shuffled at a time.
    """
    counts = ["n_video", "n_audio", "n_sub", "n_known_audio", "n_items", "bytes"]
    tracks, stats = stream_counts(streams), item_stats(items, share=share)
    if write:
        stats, tracks = cut_lineage(stats), cut_lineage(tracks)
    facts = titles.join(tracks, "title_id", "left").join(stats, "title_id", "left")
    return facts.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts},
            "looped": F.coalesce(F.col("looped"), F.lit(False)),
        }
    )


def notable_flag(
    hidden: Column | None = None, minimum: float = MIN_LISTED_SECONDS, plain: float = PLAIN_SECONDS
) -> Column:
    """Whether a title of ``title_facts`` is content worth listing.

    *hidden* marks decoys, duplicates and secondary experiences.
    """
    duration, audio = F.col("duration"), F.col("n_audio")
    rich = (audio >= 2) | (F.col("n_sub") >= 1) | ((audio == 1) & (F.col("n_known_audio") == 1))
    by_length = (
        F.when(duration < minimum, F.lit(False)).when(duration < plain, rich).otherwise(audio > 0)
    )
    flag = (F.col("n_video") > 0) & ~F.col("looped") & by_length
    return flag if hidden is None else flag & ~hidden


def short_label(
    short: float = SHORT_CLIP_SECONDS, empty_bytes: int = EMPTY_BYTES
) -> Column:
    empty = (F.col("duration") <= 0) | ((F.col("bytes") > 0) & (F.col("bytes") < empty_bytes))
    return (
        F.when(F.col("looped"), "Menu loop")
        .when(empty, "Empty")
        .when(F.col("duration") < short, "Short clip")
    )


def type_index(streams: DataFrame) -> DataFrame:
    """0-based ordinal of a stream among those of its type, in list order."""
    ranked = o.ordered(streams, ["title_id", "type"], ["pos"], _rn=o.row_number())
    return ranked.withColumn("type_index", F.col("_rn") - 1).drop("_rn")


@dataclass(frozen=True)
class Selection:
    """Default track selection settings."""

    languages: tuple[str, ...] = ("eng",)
    all_audio: bool = False
    subtitles: bool = True
    all_subtitle_languages: bool = False
    forced: bool = True


def track_plan(streams: DataFrame, choice: Selection) -> DataFrame:
    """Every stream with ``keep``: first video, wanted audio, wanted subtitles."""
    first = o.with_group(
        streams, "title_id", _first_video=F.min(F.when(F.col("type") == "video", F.col("pos")))
    )
    liked = F.col("lang").isin(list(choice.languages))
    audio = F.col("muxable") & (F.lit(choice.all_audio) | liked)
    subtitle = (
        F.col("muxable")
        & F.lit(choice.subtitles)
        & (F.lit(choice.all_subtitle_languages) | liked)
        & (F.lit(choice.forced) | ~F.col("is_forced"))
    )
    keep = (
        F.when(F.col("type") == "video", F.col("pos") == F.col("_first_video"))
        .when(F.col("type") == "audio", audio)
        .when(F.col("type") == "subtitle", subtitle)
        .otherwise(F.lit(False))
    )
    return first.withColumn("keep", keep).drop("_first_video")


def select_streams(streams: DataFrame, choice: Selection) -> DataFrame:
    return track_plan(streams, choice).filter("keep").drop("keep")


_SELECTOR_TYPES = {"v": "video", "a": "audio", "s": "subtitle"}


def _selector_match(selector: str) -> Column | None:
    prefix, colon, value = selector.partition(":")
    kind = _SELECTOR_TYPES.get(prefix)
    if not colon or kind is None:
        return None
    of_type = F.col("type") == kind
    if value == "all":
        return of_type
    if value.isalpha() and len(value) == 3:
        return of_type & (F.col("lang") == value)
    try:
        return of_type & (F.col("type_index") == int(value))
    except ValueError:
        return None


def select_explicit(streams: DataFrame, selectors: list[str]) -> DataFrame:
    """Streams hit by selectors such as ``v:all``, ``a:eng``, ``s:2``.

    A stream counts for its first selector; ``out_idx`` numbers the union in selector
    order, then list order.
    """
    hits = [
        F.when(match, F.lit(i))
        for i, selector in enumerate(selectors)
        if (match := _selector_match(selector)) is not None
    ]
    if not hits:
        return streams.filter(F.lit(False)).withColumn("out_idx", F.lit(0))
    indexed = type_index(streams) if "type_index" not in streams.columns else streams
    hit = F.array_min(F.array(*hits)) if len(hits) > 1 else hits[0]
    chosen = indexed.withColumn("selector", hit).filter(F.col("selector").isNotNull())
    numbered = o.ordered(
        chosen,
        "title_id",
        ["selector", "pos"],
        block_on=["selector", "pos"],
        _rn=o.row_number(),
    )
    return numbered.withColumn("out_idx", F.col("_rn") - 1).drop("_rn")


def default_audio(streams: DataFrame, languages: list[str]) -> DataFrame:
    """One audio stream per title to flag as default; none where one is flagged already.

    Plain tracks go before commentary, then language priority, then list order.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    rank = F.when(rank > 0, rank).otherwise(F.lit(len(languages) + 1))
    best = (
        streams.filter(F.col("type") == "audio")
        .groupBy("title_id")
        .agg(
            F.bool_or("is_default").alias("_flagged"),
            F.min(F.struct("is_commentary", rank.alias("rank"), "pos", "lang")).alias("_best"),
        )
    )
    return best.filter(~F.col("_flagged")).select("title_id", "_best.pos", "_best.lang")


def token_flag(column: str | Column, tokens: list[str]) -> Column:
    """Whether a lower-cased text has one of *tokens* as a whole word."""
    text = F.col(column) if isinstance(column, str) else column
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    return F.arrays_overlap(words, F.array(*[F.lit(t) for t in tokens]))


# Words naming a secondary viewing experience, and names an author
# gives the main feature (letters only).
SECONDARY_TOKENS = ["hud", "pip"]
MAIN_FEATURE_NAMES = ["mainmovie", "mainfeature", "featurefilm"]


def authorial_main(column: str | Column) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", "")
    return letters.isin(MAIN_FEATURE_NAMES)


def is_hash_path(column: str | Column) -> Column:
    path = F.col(column) if isinstance(column, str) else column
    upper = F.upper(F.translate(path, "\\", "/"))
    stream = upper.startswith("BDMV/STREAM/") & upper.endswith(".M2TS")
    return upper.startswith("VIDEO_TS/") | stream


def is_scrambled(
    packets: DataFrame, flag: Column, key: str = "stream_id", minimum: int = 3, factor: int = 10
) -> DataFrame:
    """Per key: at least *minimum* scrambled packets and one in *factor* overall."""
    counted = packets.groupBy(key).agg(
        F.count_if(flag).alias("scrambled"), F.count(F.lit(1)).alias("total")
    )
    verdict = (F.col("scrambled") >= minimum) & (F.col("scrambled") * factor >= F.col("total"))
    return counted.withColumn("is_scrambled", verdict)


def angle_blocks(cells: DataFrame) -> DataFrame:
    """Cells of angle blocks with a ``block`` number.

    A block opens at mode 1 or after a cell that closed or left one; mode 3 closes it.
    """
    in_block = (F.col("block_mode") != 0) & F.col("is_angle")
    marked = o.ordered(
        cells.withColumn("_in", in_block),
        "chain_id",
        ["pos"],
        _mode=o.lag("block_mode"),
        _was=o.lag("_in"),
    )
    opens = (
        ~F.col("_in")
        | (F.col("block_mode") == 1)
        | (F.col("_mode") == 3)
        | ~F.coalesce(F.col("_was"), F.lit(False))
    )
    numbered = o.ordered(
        marked.withColumn("_open", opens.cast("long")), "chain_id", ["pos"], block=o.sum_to("_open")
    )
    return numbered.filter("_in").drop("_in", "_mode", "_was", "_open")


def angle_mismatch(cells: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Chains with a closed angle block whose angles differ in length."""
    per_block = angle_blocks(cells).groupBy("chain_id", "block").agg(
        F.bool_or(F.col("block_mode") == 3).alias("closed"),
        (F.max("duration") - F.min("duration")).alias("spread"),
    )
    bad = F.col("closed") & (F.col("spread") > tolerance)
    return per_block.groupBy("chain_id").agg(F.bool_or(bad).alias("mismatch"), F.count_if(bad).alias("bad_blocks"))


def is_padded(rate: float = MAX_SECTORS_PER_SECOND, factor: float = PADDED_FACTOR) -> Column:
    plain = (F.col("block_mode") == 0) & (F.col("flags").bitwiseAND(F.lit(INTERLEAVED_FLAG)) == 0)
    sectors = F.col("last_sector") - F.col("first_sector") + 1
    return plain & (sectors > (F.col("duration") + 1.0) * rate * factor)


def trim_tail(df: DataFrame, key: str, order: str, measure: str, minimum: float) -> DataFrame:
    """Drop the longest suffix of rows under *minimum*; the first row always stays."""
    big = df.withColumn("_big", (F.col(measure) >= minimum).cast("int"))
    seen = o.ordered(big, key, [order], _later=o.max_from("_big"), _rn=o.row_number())
    keep = (F.col("_later") == 1) | (F.col("_rn") == 1)
    return seen.filter(keep).drop("_big", "_later", "_rn")


def fold_layers(streams: DataFrame) -> DataFrame:
    """Drop enhancement-layer video after the first video, which is flagged instead.

    ``width`` follows from HD heights unless the picture is 4:3.
    """
    video = F.col("type") == "video"
    known = o.with_group(
        streams,
        "title_id",
        _base=F.min(F.when(video, F.col("pos"))),
        _layer=F.max(F.when(video & F.col("layer"), F.col("pos"))),
    )
    is_base = video & (F.col("pos") == F.col("_base"))
    aspect = F.col("aspect") if "aspect" in streams.columns else F.lit(None).cast("string")
    wide = video & F.col("height").isin(720, 1080, 2160) & (F.coalesce(aspect, F.lit("")) != "4:3")
    return (
        known.filter(~(video & F.col("layer")) | is_base)
        .withColumn("enhanced", is_base & F.coalesce(F.col("_layer") > F.col("_base"), F.lit(False)))
        .withColumn("width", F.when(wide, F.floor(F.col("height") * 16 / 9)).cast("int"))
        .drop("_base", "_layer")
    )


def has_codec(streams: DataFrame, codec: str) -> DataFrame:
    return streams.groupBy("title_id").agg(F.bool_or(F.col("codec") == codec).alias("has_codec"))


def drop_codec(streams: DataFrame, codec: str) -> DataFrame:
    return streams.filter(F.col("codec") != codec)


def format_class(streams: DataFrame, key: str, bluray: Column, uhd_width: int = 3000) -> DataFrame:
    """DVD, Blu-ray or 4K per *key* (4K when any video is at least *uhd_width* wide)."""
    uhd = F.bool_or((F.col("type") == "video") & (F.col("width") >= uhd_width))
    return streams.groupBy(key).agg(
        F.when(~F.bool_or(bluray), "DVD").when(uhd, "4K").otherwise("Blu-ray").alias("format")
    )


def eligible_source(ids: list[str], bluray: Column, has_title_number: Column) -> Column:
    """Blu-ray always; else any identifier or a numbered title."""
    known = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ids]
    result = bluray | has_title_number
    for flag in known:
        result = result | flag
    return result


def flag_original(streams: DataFrame, original: Column, two_letter: Column) -> DataFrame:
    """Audio in the film's language, not commentary and not described video."""
    described = F.col("is_described") if "is_described" in streams.columns else F.lit(False)
    hit = (
        (F.col("type") == "audio")
        & ~F.col("is_commentary")
        & ~described
        & (two_letter == F.lower(original))
    )
    return streams.withColumn("is_original", F.coalesce(hit, F.lit(False)))
