"""Names: release-name cleaning, series parsing, labels, quoting and safe file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that end a release name's title part.
RELEASE_TAGS = (
    "ntsc pal dvd dvd5 dvd9 bd bd25 bd50 bluray blu-ray remux web webrip webdl hdtv pdtv dsr "
    "divx xvid x264 h264 h265 hevc avc dd ac3 dts 5.1 2.0 7.1 mono usa uk eu jpn ger fre ita "
    "spa kor cn multi retail internal proper repack limited extended unrated remastered 1080p "
    "1080i 720p 480p 576p 4k uhd hdr hdr10 dovi ws fs cust custom dtsonly thd"
).split()

# Words kept in lower case inside a title.
SMALL_WORDS = "a an the of and or but for to at in on by de du la le el il und der das".split()

# Fixed pattern: scene words dropped before a movie search.
SCENE_WORDS = (
    r"(?i)\b(?:\d{3,4}p|\d{3,4}i|4k|8k|uhd|hdr(?:10)?|sdr|web-?dl|web-?rip|webcap|webhd|"
    r"blu-?ray|br-?rip|bd-?rip|dvdrip|hdrip|hdtv|pdtv|x264|x265|h264|h265|hevc|avc|xvid|divx|"
    r"ac3|dts|truehd|atmos|flac|aac|mp3|"
    r"repack|proper|extended|unrated|remastered|internal|readnfo)\b"
)

# Fixed patterns: season and disc tokens in normalised names.
SEASON = r"(?<![a-z0-9])s(?:eason)?\s*0*(\d{1,2})(?=d\d|[^a-z0-9]|$)"
DISC = r"(?<![a-z])(?:dis[ck]|d)\s*0*([1-9]\d?)(?![a-z0-9])"

# Placeholder disc names (letters and digits only).
GENERIC_DISC_NAMES = ["bluray", "bluraydisc", "bd", "bdrom", "bdmv", "disc", "untitled", "noname"]

EPISODE_TAG = r"^s\d{1,2}e\d{1,3}$"


def clean_release_name(name: Column) -> Column:
    """A human title from a release-style name; empty when nothing is left.

    The title ends before the first metadata word, and right after a year or an episode
    tag.
    """
    base = F.regexp_replace(name, r"(?i)\.(mkv|mp4|avi|iso|m2ts|vob|ts|m4v)$", "")
    spaced = F.regexp_replace(F.trim(F.regexp_replace(base, r"[._\-]+", " ")), r"[\[\]()]", " ")
    tokens = F.filter(F.split(spaced, r"\s+"), lambda t: t != "")

    def bare(token: Column) -> Column:
        return F.btrim(F.lower(token), F.lit(":,;!?"))

    def is_year(word: Column) -> Column:
        return word.rlike(r"^(19|20)\d{2}$")

    def is_tag(word: Column) -> Column:
        return word.isin(RELEASE_TAGS) | word.rlike(r"^\d{3,4}p$") | word.rlike(r"^\d{3,4}x\d{3,4}$")

    # 0: keep going, 1: keep this one and stop, 2: stop before this one.
    kinds = F.transform(
        tokens,
        lambda t: F.when(is_year(bare(t)) | bare(t).rlike(EPISODE_TAG), 1).when(is_tag(bare(t)), 2).otherwise(0),
    )
    stops = F.filter(
        F.transform(kinds, lambda k, i: F.when(k > 0, i + F.when(k == 1, 1).otherwise(0))), lambda i: i.isNotNull()
    )
    length = F.coalesce(F.array_min(stops), F.size(tokens))
    kept = F.transform(
        F.slice(tokens, F.lit(1), length),
        lambda t: F.when(is_year(bare(t)), bare(t)).when(bare(t).rlike(EPISODE_TAG), F.upper(t)).otherwise(t),
    )
    title = F.btrim(F.array_join(kept, " "), F.lit(" -,.;:!?"))
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")

    def cased(word: Column, i: Column) -> Column:
        lowered = F.lower(word)
        return (
            F.when(lowered.rlike(EPISODE_TAG), F.upper(word))
            .when((i > 0) & lowered.isin(SMALL_WORDS), lowered)
            .when(word.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2)))))
            .otherwise(word)
        )

    return F.array_join(F.transform(words, cased), " ")


def sanitize_title(filename: Column) -> Column:
    """Struct of search title and year from a file name."""
    stem = F.regexp_replace(F.regexp_extract(filename, r"[^/]*$", 0), r"(?<=.)\.[^.]+$", "")
    tagged = stem.rlike(r"(?i)\b(?:19|20)\d{2}\b|\d{3,4}[pi]")
    base = F.when(tagged, F.regexp_replace(stem, r"-\s*[A-Za-z0-9]+$", "")).otherwise(stem)
    cleaned = F.regexp_replace(F.regexp_replace(base, r"[._]", " "), SCENE_WORDS, " ")
    year = F.nullif(F.regexp_extract(cleaned, r"\b(19\d{2}|20\d{2})\b", 1), F.lit(""))
    # Only the first year goes.
    without = F.regexp_replace(cleaned, r"^(?s)(.*?)\b(?:19\d{2}|20\d{2})\b", "$1 ")
    title = F.btrim(F.regexp_replace(without, r"\s+", " "), F.lit(" -"))
    fallback = F.trim(F.regexp_replace(stem, r"[._]", " "))
    return F.struct(F.when(title != "", title).otherwise(fallback).alias("title"), year.cast("int").alias("year"))


def parse_series(names: Column) -> Column:
    """Struct of show, season, disc from names in order of authority; NULL without either.

    Season and disc each come from the first name carrying them, the show from the first
    name carrying any, cut at its first token.
    """

    def normal(name: Column) -> Column:
        return F.lower(F.regexp_replace(name, r"[._]", " "))

    def number(name: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(normal(name), pattern, 1), F.lit("")).cast("int")

    def head(name: Column) -> Column:
        cut = F.regexp_replace(normal(name), rf"(?s)(?:{SEASON}|{DISC}).*$", "")
        text = F.substr(name, F.lit(1), F.length(cut))
        spaced = F.when(~F.contains(name, F.lit(" ")), F.regexp_replace(text, r"[._]", " ")).otherwise(text)
        return F.btrim(F.regexp_replace(spaced, r"\s+", " "), F.lit(" -,:;._"))

    known = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    seasons = F.array_compact(F.transform(known, lambda n: number(n, SEASON)))
    discs = F.array_compact(F.transform(known, lambda n: number(n, DISC)))
    shows = F.filter(
        F.transform(
            F.filter(known, lambda n: number(n, SEASON).isNotNull() | number(n, DISC).isNotNull()), head
        ),
        lambda s: s != "",
    )
    season, disc = F.get(seasons, F.lit(0)), F.get(discs, F.lit(0))
    show = F.coalesce(F.get(shows, F.lit(0)), F.lit(""))
    return F.when(
        season.isNotNull() | disc.isNotNull(),
        F.struct(show.alias("show"), season.alias("season"), disc.alias("disc")),
    )


def series_name(show: Column, season: Column, disc: Column, fallback: Column) -> Column:
    code = F.concat_ws("", F.format_string("S%02d", season), F.format_string("D%02d", disc))
    code = (
        F.when(season.isNotNull() & disc.isNotNull(), code)
        .when(season.isNotNull(), F.format_string("S%02d", season))
        .when(disc.isNotNull(), F.format_string("D%02d", disc))
    )
    return F.when(F.coalesce(show, F.lit("")) != "", F.concat_ws(" - ", show, code)).otherwise(fallback)


def episode_title(base: Column, number: Column, width: Column, part: Column | None = None) -> Column:
    """``<base> - Episode NN<part>``; a number wider than *width* stays whole."""
    text = number.cast("string")
    padded = F.lpad(text, F.greatest(width, F.length(text)), "0")
    return F.concat(base, F.lit(" - Episode "), padded, part if part is not None else F.lit(""))


def play_all_title(base: Column) -> Column:
    return F.concat(base, F.lit(" - Play All"))


def source_ref(playlist: Column, title_number: Column, file_name: Column) -> Column:
    """Playlist file, two-digit title number or plain file name, whichever applies first."""
    return (
        F.when(playlist.isNotNull(), F.concat(playlist, F.lit(".mpls")))
        .when(title_number.isNotNull(), F.format_string("%02d", title_number))
        .otherwise(file_name)
    )


def short_name(name: Column, base: Column) -> Column:
    """A title's name without the shared base and a trailing medium suffix."""
    prefix = F.concat(base, F.lit(" - "))
    rest = F.when(name.startswith(prefix), F.substr(name, F.length(prefix) + 1)).otherwise(name)
    cut = F.regexp_replace(rest, r"(?i)\s+-\s+Blu-ray(?:\s*3D)?(?:\s*[™℠])?\s*$", "")
    return F.when(cut != "", cut).otherwise(rest)


def quote_log(value: Column) -> Column:
    text = F.translate(value.cast("string"), "\"\r\n", "'  ")
    return F.concat(F.lit('"'), text, F.lit('"'))


def slugify(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(value), "&", "and"), r"\s+", "-")
    return F.btrim(F.regexp_replace(text, "[^a-z0-9-]", ""), F.lit("-"))


def ean(raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits).isin(12, 13), digits).otherwise(raw)


def first_known(*values: Column) -> Column:
    return F.coalesce(*values)


def safe_name(name: Column, index: Column) -> Column:
    """Output file name: no medium suffix, no reserved characters or symbols, ``_tNN``."""
    suffix = F.concat(F.lit(" - Title "), (index + 1).cast("string"))
    text = F.when(name.endswith(suffix), F.substr(name, F.lit(1), F.length(name) - F.length(suffix))).otherwise(name)
    text = F.regexp_replace(text, r"(?i)\s+-\s+Blu-ray(?:\s*[™℠])?\s*$", "")
    text = F.regexp_replace(F.when(text != "", text).otherwise(name), r'[<>:"/\\|?*]', "_")
    text = F.regexp_replace(text, r"(?U)[^\w\s\-.]", "")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.concat(text, F.format_string("_t%02d.mkv", index))


def source_id(kind: Column, stream: Column, pid: Column, sub_id: Column, vts: Column, type_index: Column, video_id: Column) -> Column:
    """Source-medium id text of a track; NULL when it cannot be known.

    *kind* is ``hddvd`` or anything else; *stream* the track type.
    """
    video = stream == "video"
    private = F.when(sub_id.bitwiseAND(F.lit(0xFFFFFFFF)) == 0xBD, F.shiftright(sub_id, 32))
    audio_sub = F.coalesce(private, type_index + 0xC0)
    text_sub = F.when(sub_id.between(0x20, 0x3F), sub_id).otherwise(type_index + 0x20)
    hd = F.when(video, F.format_string("0100%02X", video_id)).otherwise(
        F.format_string("01%02XBD", F.when(stream == "audio", audio_sub).otherwise(text_sub))
    )
    hd = F.when(~video | video_id.isNotNull(), hd)
    sub = F.when(video, 0).otherwise(F.coalesce(sub_id, F.lit(0)))
    mpeg = (stream == "audio") & sub.between(0xC0, 0xC7)
    pack = F.when(mpeg, sub).when(video, 0xE0).otherwise(0xBD)
    dvd = F.format_string("%02d%02X%02X", vts, F.when(mpeg, 0).otherwise(sub), pack)
    return (
        F.when(kind == "hddvd", hd)
        .when(pid.isNotNull(), F.format_string("00%04X", pid))
        .when(vts.isNotNull(), dvd)
    )


def display_name(name: Column, description: Column, ident: Column, number: Column) -> Column:
    """First non-empty of three attributes, else ``Title N``; trailers say so."""
    chosen = F.coalesce(
        F.nullif(name, F.lit("")),
        F.nullif(description, F.lit("")),
        F.nullif(ident, F.lit("")),
        F.concat(F.lit("Title "), number.cast("string")),
    )
    is_trailer = F.contains(F.lower(F.coalesce(ident, F.lit(""))), F.lit("trailer"))
    marked = F.contains(F.lower(chosen), F.lit("trailer"))
    return F.when(is_trailer & ~marked, F.concat(chosen, F.lit(" (Trailer)"))).otherwise(chosen)


def version_gt(a: Column, b: Column) -> Column:
    """Dotted-number versions: is *a* past *b*?  False unless both are numeric."""

    def key(text: Column) -> Column:
        parts = F.transform(F.split(F.trim(text), r"\.", -1), lambda p: F.trim(p).try_cast("int"))
        return F.when(F.forall(parts, lambda n: n.isNotNull()), parts)

    return F.coalesce(key(a) > key(b), F.lit(False))


def is_generic_disc_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "").isin(GENERIC_DISC_NAMES)
