"""XML playlists, disc metadata, catalog JSON and probe JSON as relational rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discframe.functions import clock, lang, text
from discframe.operators import ordered as o

_TRACK = "array<struct<_track:string,_streamNumber:string,_mediaAttr:string,_description:string>>"
_NAV = "array<struct<_track:string,_langcode:string,_forced:string,_description:string>>"
_ATTR = "array<struct<_index:string,_codec:string>>"
PLAYLIST_SCHEMA = f"""
  MediaAttributeList struct<VideoAttributeItem:{_ATTR},AudioAttributeItem:{_ATTR},SubpictureAttributeItem:{_ATTR}>,
  TitleSet struct<_timeBase:string,_defaultLanguage:string,Title:array<struct<
    _titleNumber:string,_titleDuration:string,_id:string,_displayName:string,_description:string,
    PrimaryAudioVideoClip:array<struct<_titleTimeBegin:string,_titleTimeEnd:string,_src:string,_seamless:string,
      Video:{_TRACK},Audio:{_TRACK},Subtitle:{_TRACK},SubVideo:{_TRACK},SubAudio:{_TRACK}>>,
    TrackNavigationList:struct<AudioTrack:{_NAV},SubtitleTrack:{_NAV}>,
    ChapterList:struct<Chapter:array<struct<_titleTimeBegin:string>>>>>>
"""
# Code extensions marking commentary, captions and forced subtitles, and
# the first sub-stream of an audio codec.
AUDIO_COMMENTARY = (3, 4)
SUBTITLE_CAPTIONS = (5, 6, 7)
SUBTITLE_FORCED = (9,)
SUBTITLE_COMMENTARY = (13, 14, 15)
SUB_STREAM_BASE = {"DD+": 0xC0, "MLP": 0xB0, "DTS-HD": 0x88}


def read_playlist_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``titles``, ``clips``, ``marks`` and ``streams`` of XML playlists (one file each).

    Missing attributes take their defaults; a file that is no playlist has no rows.
    """
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("playlist"), F.col("value").alias("xml")
    )
    return parse_playlists(texts, "xml", "playlist")


def parse_playlists(df: DataFrame, xml: str, ident: str) -> dict[str, DataFrame]:
    parsed = df.select(ident, F.from_xml(xml, PLAYLIST_SCHEMA, {"mode": "PERMISSIVE"}).alias("x"))
    base = F.regexp_extract(F.trim("x.TitleSet._timeBase"), r"^(\d+(?:\.\d+)?)\s*fps$", 1).try_cast("double")
    rate = F.when(base.isNull() | (base == 60), F.lit(60_000 / 1001)).otherwise(base)
    default = lang.three_letter(F.coalesce("x.TitleSet._defaultLanguage", F.lit("")))
    rows = parsed.select(
        ident,
        rate.alias("fps"),
        default.alias("default_lang"),
        F.col("x.MediaAttributeList").alias("media"),
        F.explode("x.TitleSet.Title").alias("t"),
    )
    number = F.coalesce(F.col("t._titleNumber"), F.lit("0")).try_cast("int")
    rows = rows.withColumn("title_number", number).filter(F.col("title_number").isNotNull())

    def seconds(column: Column) -> Column:
        part = [F.regexp_extract(column, r"^\s*(\d+):(\d+):(\d+):(\d+)\s*$", i).try_cast("long") for i in range(1, 5)]
        frames = (part[0] * 3600 + part[1] * 60 + part[2]) * F.bround("fps") + part[3]
        return F.coalesce(frames / F.col("fps"), F.lit(0.0))

    titles = rows.select(
        ident,
        "title_number",
        text.display_name(F.col("t._displayName"), F.col("t._description"), F.col("t._id"), F.col("title_number")).alias("name"),
        F.coalesce(F.col("t._id"), F.lit("")).alias("title_key"),
        seconds(F.col("t._titleDuration")).alias("duration"),
    )
    spread = rows.select(
        ident, "fps", "title_number", "default_lang", "media",
        F.col("t.TrackNavigationList").alias("nav"),
        F.posexplode("t.PrimaryAudioVideoClip").alias("pos", "c"),
    )
    source = F.regexp_extract(F.col("c._src"), r"[^/]*$", 0)
    stem = F.regexp_replace(source, r"(?i)\.(map|evo)$", "")
    clips = spread.filter(F.coalesce(F.col("c._src"), F.lit("")) != "").select(
        ident,
        "title_number",
        "pos",
        F.when(source.rlike(r"(?i)\.evo$"), source).otherwise(F.concat(stem, F.lit(".evo"))).alias("clip"),
        seconds(F.col("c._titleTimeBegin")).alias("begin"),
        seconds(F.col("c._titleTimeEnd")).alias("end"),
        (F.lower(F.coalesce("c._seamless", F.lit(""))) == "true").alias("seamless"),
    )
    chapters = rows.select(
        ident, "fps", "title_number", F.explode("t.ChapterList.Chapter").alias("ch")
    ).select(ident, "title_number", seconds(F.col("ch._titleTimeBegin")).alias("t"))
    # The key is named column by column, so that a peak of *ident* counts: no document is parsed while a plan is built.
    marks = o.ordered(chapters, [ident, "title_number"], ["t"], _rn=o.row_number()).select(
        ident, "title_number", (F.col("_rn") - 1).alias("mark_idx"), "t"
    )
    return {"titles": titles, "clips": clips, "marks": marks, "streams": _tracks(spread, ident)}


def _tracks(spread: DataFrame, ident: str) -> DataFrame:
    """Track rows of every clip with codec, language and flags from the lists around."""
    kinds = {"video": "Video", "audio": "Audio", "subtitle": "Subtitle", "subvideo": "SubVideo", "subaudio": "SubAudio"}

    def of_kind(kind: str, tag: str) -> Column:
        tracks = F.coalesce(F.col(f"c.{tag}"), F.array().cast(_TRACK))
        return F.transform(tracks, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("ordinal"), t.alias("t")))

    listed = spread.select(
        ident, "title_number", "pos", "default_lang", "media", "nav",
        F.explode(F.flatten(F.array(*[of_kind(k, v) for k, v in kinds.items()]))).alias("s"),
    ).select("*", "s.*").drop("s")
    track = F.coalesce(F.col("t._track").try_cast("int"), F.lit(1))
    number = F.coalesce(F.col("t._streamNumber").try_cast("int"), track)
    listed = listed.withColumns({"track": track, "stream_number": number})
    # Lists inside one document are a handful of entries; they are looked up in place.
    empty_nav = F.array().cast(_NAV)
    nav_list = (
        F.when(F.col("kind") == "audio", F.coalesce("nav.AudioTrack", empty_nav))
        .when(F.col("kind") == "subtitle", F.coalesce("nav.SubtitleTrack", empty_nav))
        .otherwise(empty_nav)
    )
    mine = F.filter(nav_list, lambda n: F.coalesce(n["_track"], F.lit("0")).try_cast("int") == F.col("track"))
    empty_attr = F.array().cast(_ATTR)
    attr_list = (
        F.when(F.col("kind").isin("audio", "subaudio"), F.coalesce("media.AudioAttributeItem", empty_attr))
        .when(F.col("kind").isin("video", "subvideo"), F.coalesce("media.VideoAttributeItem", empty_attr))
        .otherwise(F.coalesce("media.SubpictureAttributeItem", empty_attr))
    )
    attr = F.filter(attr_list, lambda a: a["_index"].try_cast("int") == F.col("t._mediaAttr").try_cast("int"))
    listed = listed.withColumns(
        {"n": F.get(F.reverse(mine), F.lit(0)), "codec": F.coalesce(F.get(F.reverse(attr), F.lit(0))["_codec"], F.lit(""))}
    )
    described = F.coalesce(F.nullif("t._description", F.lit("")), F.col("n._description"), F.lit(""))
    listed = listed.withColumn("d", lang.describe_track(described)).withColumn("description", described)
    code = F.split(F.coalesce("n._langcode", F.lit("")), ":")
    extension = F.get(code, F.lit(1)).try_cast("int")
    from_nav = lang.lookup(lang.TWO_TO_THREE, F.lower(F.get(code, F.lit(0))), F.lit(None).cast("string"))
    language = F.coalesce(from_nav, F.col("d.lang"))
    audio, subtitle = F.col("kind") == "audio", F.col("kind") == "subtitle"

    def has(values: tuple[int, ...]) -> Column:
        return F.coalesce(extension.isin(*values), F.lit(False))

    first = lang.lookup(SUB_STREAM_BASE, F.col("codec"), F.lit(None).cast("int"))
    nav_forced = F.lower(F.coalesce("n._forced", F.lit(""))) == "true"
    return listed.select(
        ident,
        "title_number",
        "pos",
        "kind",
        "ordinal",
        "track",
        "stream_number",
        "codec",
        "description",
        F.when((language == "und") & (F.col("kind") == "video"), F.col("default_lang")).otherwise(language).alias("lang"),
        (F.col("d.forced") | nav_forced | (subtitle & has(SUBTITLE_FORCED))).alias("is_forced"),
        (F.col("d.commentary") | (audio & has(AUDIO_COMMENTARY)) | (subtitle & has(SUBTITLE_COMMENTARY))).alias("is_commentary"),
        (F.col("d.sdh") | (subtitle & has(SUBTITLE_CAPTIONS))).alias("is_hearing_impaired"),
        F.when(audio, first + F.col("stream_number") - 1).alias("sub_id"),
    )


def is_playlist_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0).rlike(r"(?i)^VPLST\d{3}\.XPL$")


def choose_playlist(titles: DataFrame, group: Column, ident: str) -> DataFrame:
    """Per group the playlist with the longest title; the lowest name wins a tie."""
    longest = titles.groupBy(group.alias("group_id"), ident).agg(F.max("duration").alias("longest"))
    return longest.groupBy("group_id").agg(
        F.min_by(ident, F.struct(-F.col("longest"), F.upper(ident))).alias(ident), F.max("longest").alias("longest")
    )


def read_disc_xml(df: DataFrame, xml: str, group: str, order: str) -> DataFrame:
    """Disc name and catalog number from metadata documents, in file order per disc.

    Placeholder names are skipped, line breaks become `` - ``; a catalog number keeps its
    12 or 13 digits, or its raw text otherwise.
    """
    broken = F.regexp_replace(F.col(xml), r"^(?s)\s*<\?xml[^>]*\?>", "")
    names = F.xpath(broken, F.lit("//*[substring(local-name(), string-length(local-name()) - 3) = 'name']/text()"))
    tags = F.xpath(broken, F.lit("//*[local-name() = 'catalogNumber']/text()"))
    blank = F.array().cast("array<string>")
    rows = df.select(
        group,
        order,
        F.transform(F.coalesce(names, blank), lambda n: F.regexp_replace(n, r"^\s+|\s+$", "")).alias("n"),
        F.transform(F.coalesce(tags, blank), lambda n: F.regexp_replace(n, r"^\s+|\s+$", "")).alias("c"),
    )
    good = F.filter("n", lambda n: (n != "") & ~text.is_generic_disc_name(n))
    first = F.regexp_replace(F.get(good, F.lit(0)), r"\r\n|\r|\n", " - ")
    number = F.get(F.filter("c", lambda n: n != ""), F.lit(0))
    found = rows.select(group, order, first.alias("name"), text.ean(number).alias("catalog_number"))
    return found.groupBy(group).agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col(order))).alias("disc_name"),
        F.min_by("catalog_number", F.when(F.col("catalog_number").isNotNull(), F.col(order))).alias("catalog_number"),
    )


CATALOG_SCHEMA = """array<struct<title:string,year:int,slug:string,type:string,externalids:struct<tmdb:string,imdb:string>,
  releases:array<struct<slug:string,title:string,year:int,locale:string,regionCode:string,upc:string,
    discs:array<struct<index:int,name:string,format:string,slug:string,contentHash:string,globalDiscId:string,fingerprint:string,
      titles:array<struct<index:int,duration:string,sourceFile:string,filename:string,
        item:struct<title:string,season:string,episode:string,type:string>>>>>>>>>"""


def flatten_catalog(df: DataFrame, json: str, ident: str) -> DataFrame:
    """One row per catalog title: item, release and disc repeated, NULLs where absent."""
    items = df.select(ident, F.posexplode_outer(F.from_json(json, CATALOG_SCHEMA)).alias("item_no", "i"))
    releases = items.select(ident, "item_no", "i", F.posexplode_outer("i.releases").alias("release_no", "r"))
    discs = releases.select(ident, "item_no", "release_no", "i", "r", F.posexplode_outer("r.discs").alias("disc_no", "d"))
    titles = discs.select(
        ident, "item_no", "release_no", "disc_no", "i", "r", "d", F.posexplode_outer("d.titles").alias("title_no", "t")
    )
    return titles.select(
        ident, "item_no", "release_no", "disc_no", "title_no",
        F.col("i.title").alias("item_title"), F.col("i.year").alias("year"), F.col("i.type").alias("media_type"),
        F.col("r.slug").alias("release"), F.col("r.upc").alias("upc"),
        F.col("d.contentHash").alias("content_hash"), F.col("d.globalDiscId").alias("global_id"),
        F.col("d.fingerprint").alias("fingerprint"),
        F.lower("t.sourceFile").alias("source_key"), clock.parse_duration(F.col("t.duration")).alias("duration"),
        F.col("t.filename").alias("filename"), F.col("t.item.type").alias("item_type"),
        F.col("t.item.season").alias("season"), F.col("t.item.episode").alias("episode"),
    )


PROBE_SCHEMA = """struct<tracks:array<struct<id:bigint,type:string,codec:string,properties:struct<number:bigint,
  language:string,track_name:string,default_track:boolean,forced_track:boolean,pixel_dimensions:string,
  audio_channels:int,audio_sampling_frequency:bigint>>>,container:struct<duration:bigint,properties:struct<duration:bigint>>>"""
_PROBE_TYPES = {"video": "video", "audio": "audio", "subtitles": "subtitle"}


def streams_from_probe(df: DataFrame, json: str, ident: str, codecs: dict[str, str] | None = None) -> DataFrame:
    """Typed stream rows from a probe tool's JSON, with an ordinal per type."""
    rows = df.select(ident, F.posexplode(F.from_json(json, PROBE_SCHEMA)["tracks"]).alias("pos", "t"))
    typed = rows.withColumn("type", lang.lookup(_PROBE_TYPES, F.col("t.type"), F.lit(None).cast("string")))
    kept = typed.filter(F.col("type").isNotNull())
    codec = F.coalesce("t.codec", F.lit(""))
    codec = lang.lookup(codecs, codec, codec) if codecs else codec
    size = F.regexp_extract(F.coalesce("t.properties.pixel_dimensions", F.lit("")), r"^(\d+)x(\d+)$", 1)
    high = F.regexp_extract(F.coalesce("t.properties.pixel_dimensions", F.lit("")), r"^(\d+)x(\d+)$", 2)
    named = kept.select(
        ident,
        "pos",
        "type",
        F.coalesce("t.id", F.lit(0)).alias("track_id"),
        F.when(codec != "", codec).otherwise("unknown").alias("codec"),
        F.coalesce("t.properties.language", F.lit("und")).alias("lang"),
        F.coalesce("t.properties.track_name", F.lit("")).alias("label"),
        F.coalesce("t.properties.default_track", F.lit(False)).alias("is_default"),
        F.coalesce("t.properties.forced_track", F.lit(False)).alias("is_forced"),
        F.col("t.properties.number").alias("source_number"),
        F.when(F.col("type") == "video", size.try_cast("int")).alias("width"),
        F.when(F.col("type") == "video", high.try_cast("int")).alias("height"),
        F.when(F.col("type") == "audio", F.col("t.properties.audio_channels")).alias("channels"),
        F.when(F.col("type") == "audio", F.col("t.properties.audio_sampling_frequency")).alias("sample_rate"),
    )
    ranked = o.ordered(named, [ident, "type"], ["pos"], _rn=o.row_number())
    return ranked.withColumn("type_index", F.col("_rn") - 1).drop("_rn")
