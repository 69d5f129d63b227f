"""Registered scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.registry import query
from discframe.functions import clock, lang
from discframe.functions import text as x

_TAGS = ", ".join(f"'{t}'" for t in x.RELEASE_TAGS)
_SMALL = ", ".join(f"'{w}'" for w in x.SMALL_WORDS)
_YEAR = "regexp_matches(w, '^(19|20)[0-9][0-9]$')"
_EPISODE = "regexp_matches(w, '^s[0-9]{1,2}e[0-9]{1,3}$')"


def _clean_sql(source: str) -> str:
    """The release-name rules as DuckDB list functions over ``source(id, name)``.

    The upper case of ß is SS, which DuckDB leaves as it is.
    """
    return f"""src AS ({source}),
tk AS (SELECT id, name, list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(regexp_replace(name,
    '\\.(mkv|mp4|avi|iso|m2ts|vob|ts|m4v)$', '', 'i'), '[._\\-]+', ' ', 'g')), '[\\[\\]()]', ' ', 'g'), '\\s+'), lambda t: t <> '') AS tokens FROM src),
wd AS (SELECT *, list_transform(tokens, lambda t: trim(lower(t), ':,;!?')) AS words FROM tk),
kd AS (SELECT *, list_transform(words, lambda w: CASE WHEN {_YEAR} OR {_EPISODE} THEN 1
    WHEN w IN ({_TAGS}) OR regexp_matches(w, '^[0-9]{{3,4}}p$') OR regexp_matches(w, '^[0-9]{{3,4}}x[0-9]{{3,4}}$') THEN 2 ELSE 0 END) AS kinds FROM wd),
st AS (SELECT *, coalesce(list_min(list_filter(list_transform(kinds, lambda k, i: CASE WHEN k = 1 THEN i WHEN k = 2 THEN i - 1 END), lambda v: v IS NOT NULL)), len(tokens)) AS n FROM kd),
kp AS (SELECT *, trim(array_to_string(list_transform(tokens[1:n], lambda t, i: CASE WHEN regexp_matches(words[i], '^(19|20)[0-9][0-9]$') THEN words[i]
    WHEN regexp_matches(words[i], '^s[0-9]{{1,2}}e[0-9]{{1,3}}$') THEN upper(t) ELSE t END), ' '), ' -,.;:!?') AS title FROM st),
wk AS (SELECT *, list_filter(regexp_split_to_array(title, '\\s+'), lambda t: t <> '') AS parts FROM kp)
SELECT id, name, coalesce(array_to_string(list_transform(parts, lambda t, i: CASE WHEN regexp_matches(lower(t), '^s[0-9]{{1,2}}e[0-9]{{1,3}}$') THEN upper(t)
    WHEN i > 1 AND lower(t) IN ({_SMALL}) THEN lower(t) WHEN regexp_matches(t, '^\\p{{L}}') THEN CASE t[1:1] WHEN 'ß' THEN 'SS' ELSE upper(t[1:1]) END || lower(t[2:]) ELSE t END), ' '), '') AS clean FROM wk"""


_RELEASES = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'The.' ELSE '[' END || replace(p_name, ' ', '.of.') || '].' ||
  CASE p_partkey % 7 WHEN 0 THEN (1950 + p_partkey % 90) || '.' WHEN 1 THEN 's01e' || p_partkey % 100 || '.' WHEN 2 THEN '1920x1080.' ELSE '' END ||
  CASE p_partkey % 3 WHEN 0 THEN 'NTSC.DVD9' WHEN 1 THEN 'EXTRAS' ELSE 'x264-grp' END || '.mkv' AS name FROM part"""


def releases(spark, sf_dir):
    key = F.col("p_partkey")
    head = F.when(key % 5 == 0, "The.").otherwise("[")
    middle = (
        F.when(key % 7 == 0, F.concat((1950 + key % 90).cast("string"), F.lit(".")))
        .when(key % 7 == 1, F.concat(F.lit("s01e"), (key % 100).cast("string"), F.lit(".")))
        .when(key % 7 == 2, "1920x1080.")
        .otherwise("")
    )
    tail = F.when(key % 3 == 0, "NTSC.DVD9").when(key % 3 == 1, "EXTRAS").otherwise("x264-grp")
    name = F.concat(head, F.replace("p_name", F.lit(" "), F.lit(".of.")), F.lit("]."), middle, tail, F.lit(".mkv"))
    return b.table(spark, sf_dir, "part").select(key.alias("id"), name.alias("name"), "p_name", "p_size")


@query("f1_clean_release_name", "WITH " + _clean_sql(_RELEASES))
def _(spark, sf_dir):
    return releases(spark, sf_dir).select("id", "name", x.clean_release_name(F.col("name")).alias("clean"))


@query("f1_clean_first_lines", "WITH " + _clean_sql("SELECT doc_id AS id, split_part(text, chr(10), 1) AS name FROM documents"))
def _(spark, sf_dir):
    first = F.substring_index("text", "\n", 1).alias("name")
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), first)
    return docs.select("id", "name", x.clean_release_name(F.col("name")).alias("clean"))


_SCENE = x.SCENE_WORDS.removeprefix("(?i)")


@query("f2_sanitize_title", f"""WITH r AS ({_RELEASES}), s AS (SELECT id, name, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM r),
d AS (SELECT *, CASE WHEN regexp_matches(stem, '(?i)\\b(?:19|20)\\d\\d\\b|\\d{{3,4}}[pi]') THEN regexp_replace(stem, '-\\s*[A-Za-z0-9]+$', '') ELSE stem END AS base FROM s),
c AS (SELECT *, regexp_replace(regexp_replace(base, '[._]', ' ', 'g'), '{_SCENE}', ' ', 'gi') AS cleaned FROM d),
y AS (SELECT *, nullif(regexp_extract(cleaned, '\\b(19\\d\\d|20\\d\\d)\\b', 1), '') AS yr FROM c),
t AS (SELECT *, trim(regexp_replace(CASE WHEN yr IS NULL THEN cleaned ELSE regexp_replace(cleaned, '\\b(?:19\\d\\d|20\\d\\d)\\b', ' ') END, '\\s+', ' ', 'g'), ' -') AS title FROM y)
SELECT id, CASE WHEN title <> '' THEN title ELSE trim(regexp_replace(stem, '[._]', ' ', 'g')) END AS title, CAST(yr AS INTEGER) AS year FROM t""")
def _(spark, sf_dir):
    done = releases(spark, sf_dir).withColumn("s", x.sanitize_title(F.col("name")))
    return done.select("id", "s.title", "s.year")


# Names with known season and disc numbers around a part name (no lookbehind in RE2, so
# the oracle knows the numbers instead of parsing them).
@query("f3_parse_series", """WITH n AS (SELECT p_partkey AS id, p_name, p_partkey % 20 AS s, 1 + p_partkey % 9 AS d, p_partkey % 4 AS kind FROM part)
SELECT id, CASE kind WHEN 3 THEN NULL WHEN 1 THEN p_name ELSE upper(p_name) END AS show, CASE WHEN kind IN (0, 1) THEN s END AS season,
  CASE WHEN kind IN (0, 2) THEN d END AS disc FROM n""")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    season = F.format_string("S%02d", key % 20)
    disc = (1 + key % 9).cast("string")
    name, loud = F.col("p_name"), F.upper("p_name")
    none = F.lit(None).cast("string")
    names = (
        F.when(key % 4 == 0, F.array(none, F.concat(loud, F.lit(" - "), season, F.lit("D"), disc), F.concat(name, F.lit(" Season 44"))))
        .when(key % 4 == 1, F.array(F.lit(""), F.concat(F.replace(name, F.lit(" "), F.lit(".")), F.lit(".Season."), (key % 20).cast("string"), F.lit(".1080p"))))
        .when(key % 4 == 2, F.array(F.concat(loud, F.lit(" Disc "), disc), F.lit("folder_disc_0")))
        .otherwise(F.array(F.concat(name, F.lit(" DVD9 BD25"))))
    )
    done = b.table(spark, sf_dir, "part").select(key.alias("id"), x.parse_series(names).alias("s"))
    return done.select("id", "s.show", "s.season", "s.disc")


@query("f4_episode_names", """WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'Show ' || o_custkey END AS shw,
  CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 12 END AS s, CASE WHEN o_custkey % 4 > 1 THEN o_custkey % 7 END AS d, o_orderkey % 130 AS n FROM orders),
q AS (SELECT *, CASE WHEN shw = '' THEN 'Disc' ELSE shw || CASE WHEN s IS NOT NULL AND d IS NOT NULL THEN printf(' - S%02dD%02d', s, d)
  WHEN s IS NOT NULL THEN printf(' - S%02d', s) WHEN d IS NOT NULL THEN printf(' - D%02d', d) ELSE '' END END AS base FROM o)
SELECT o_orderkey, base, base || ' - Episode ' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || CASE WHEN n % 2 = 0 THEN 'a' ELSE '' END AS episode, base || ' - Play All' AS play_all FROM q""")
def _(spark, sf_dir):
    cust, number = F.col("o_custkey"), F.col("o_orderkey") % 130
    show = F.when(cust % 5 == 0, "").otherwise(F.concat(F.lit("Show "), cust.cast("string")))
    base = x.series_name(
        show, F.when(cust % 3 > 0, cust % 12), F.when(cust % 4 > 1, cust % 7), F.lit("Disc")
    )
    part = F.when(number % 2 == 0, "a").otherwise("")
    named = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", base.alias("base"))
    return named.select(
        "o_orderkey",
        "base",
        x.episode_title(F.col("base"), number, F.lit(2), part).alias("episode"),
        x.play_all_title(F.col("base")).alias("play_all"),
    )


@query("f5_durations", """WITH d AS (SELECT o_orderkey, o_totalprice / 50 AS s, o_orderkey % 6 AS k FROM orders),
w AS (SELECT *, CAST(greatest(round_even(s, 0), 0) AS BIGINT) AS n FROM d)
SELECT o_orderkey, (n // 3600) || printf(':%02d:%02d', n % 3600 // 60, n % 60) AS display,
  CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN CAST(n AS DOUBLE) WHEN 3 THEN CAST(n // 60 * 60 + n % 60 AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS parsed FROM w""")
def _(spark, sf_dir):
    seconds, kind = F.col("o_totalprice") / 50, F.col("o_orderkey") % 6
    shown = clock.fmt_duration(seconds)
    whole = F.bround(seconds).cast("long")
    text = (
        F.when(kind == 0, F.concat(shown, F.lit(":")))
        .when(kind == 1, F.lit("1:xx:03"))
        .when(kind == 2, whole.cast("string"))
        .when(kind == 3, F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), (whole % 60).cast("string"), F.lit(".0")))
        .otherwise(shown)
    )
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey", shown.alias("display"), clock.parse_duration(text).alias("parsed")
    )


_CLOCK = """c AS (SELECT *, hour(ts) AS h, minute(ts) AS m, second(ts) AS s, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS pts FROM events)"""


def _clocked(spark, sf_dir):
    """Events with the parts of their time, their counter and their ticks."""
    stamp = F.col("ts").cast("timestamp")
    return b.table(spark, sf_dir, "events").withColumns(
        {
            "h": F.hour(stamp).cast("long"),
            "m": F.minute(stamp).cast("long"),
            "s": F.second(stamp).cast("long"),
            "k": F.get_json_object("props", "$.k").cast("long"),
            "pts": F.round(F.col("value") * 100).cast("long"),
        }
    )


@query("f6_timecode_seconds", f"""WITH {_CLOCK}
SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE ((h * 3600 + m * 60 + s) * 60 + k % 60) * 1001 / 60000.0 END AS seconds FROM c""")
def _(spark, sf_dir):
    # The time of an event with its counter as the frame; errors have no time.
    code = F.format_string("%02d:%02d:%02d:%02d", "h", "m", "s", F.col("k") % 60)
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(code)
    return _clocked(spark, sf_dir).select("event_id", clock.timecode_seconds(text).alias("seconds"))


@query("f7_bcd_seconds", f"""WITH {_CLOCK}, e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN h + 20 ELSE h END AS h, m, s, k % 25 AS f, pts % 4 AS r FROM c)
SELECT event_id, CASE WHEN h > 23 THEN 0.0 WHEN r = 3 THEN ((h * 3600 + m * 60 + s) * 30 + f) * 1001 / 30000.0
  WHEN r = 1 THEN ((h * 3600 + m * 60 + s) * 25 + f) / 25.0 ELSE CAST(h * 3600 + m * 60 + s AS DOUBLE) END AS seconds FROM e""")
def _(spark, sf_dir):
    def bcd(v):
        return F.floor(v / 10) * 16 + v % 10

    hour = F.when(F.col("event_type") == "error", F.col("h") + 20).otherwise(F.col("h"))
    last = F.pmod(F.col("pts"), F.lit(4)) * 64 + bcd(F.col("k") % 25)
    packed = ((bcd(hour) * 256 + bcd(F.col("m"))) * 256 + bcd(F.col("s"))) * 256 + last
    return _clocked(spark, sf_dir).select("event_id", clock.bcd_seconds(packed).alias("seconds"))


@query("f8_timestamps", """WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) * 977 AS t FROM events),
m AS (SELECT *, CAST(round_even(greatest(t, 0) * 1000 / 90000.0, 0) AS BIGINT) AS ms, CAST(round_even(t / 900.0, 0) AS BIGINT) AS cs FROM e)
SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS srt,
  printf('%02d:%02d:%02d:%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS idx,
  printf('%d:%02d:%02d.%02d', cs // 360000, cs % 360000 // 6000, cs % 6000 // 100, cs % 100) AS ass,
  printf('%02d:%02d:%02d.%09d', ms // 1000 // 3600, ms // 1000 % 3600 // 60, ms // 1000 % 60, (ms % 1000) * 1000000) AS ns FROM m""")
def _(spark, sf_dir):
    ticks = F.round(F.col("value") * 100).cast("long") * 977
    ms = F.bround(F.greatest(ticks, F.lit(0)) * 1000 / 90_000).cast("long")
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        clock.fmt_srt(ticks).alias("srt"),
        clock.fmt_idx(ticks).alias("idx"),
        clock.fmt_ass(ticks).alias("ass"),
        clock.fmt_ns(ms / 1000).alias("ns"),
    )


@query("f9_parse_timestamp", f"""WITH {_CLOCK}
SELECT event_id, CAST(h * 3600 + m * 60 + s AS DOUBLE) + (k % 4) / 4.0 AS seconds FROM c""")
def _(spark, sf_dir):
    text = F.format_string(" %02d:%02d:%02d.%02d0000000 ", "h", "m", "s", F.col("k") % 4 * 25)
    return _clocked(spark, sf_dir).select("event_id", clock.parse_ts(text).alias("seconds"))


_CURRENT = ", ".join(f"'{c}'" for c in lang.CURRENT)


@query("f10_norm_lang", f"""WITH c AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN upper(lang) WHEN 2 THEN 'iw' ELSE 'x' || lang END AS code FROM documents),
l AS (SELECT *, CASE lower(code) WHEN 'in' THEN 'id' WHEN 'iw' THEN 'he' WHEN 'ji' THEN 'yi' WHEN 'jw' THEN 'jv' WHEN 'mo' THEN 'ro' ELSE lower(code) END AS cur FROM c)
SELECT doc_id, CASE WHEN cur IN ({_CURRENT}) THEN cur ELSE 'und' END AS norm,
  CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' WHEN 'it' THEN 'ita' ELSE 'und' END AS three FROM l""")
def _(spark, sf_dir):
    key = F.col("doc_id") % 4
    code = (
        F.when(key == 0, F.col("lang"))
        .when(key == 1, F.upper("lang"))
        .when(key == 2, "iw")
        .otherwise(F.concat(F.lit("x"), F.col("lang")))
    )
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", lang.norm_lang(code).alias("norm"), lang.three_letter(F.col("lang")).alias("three")
    )


@query("f11_describe_track", """WITH d AS (SELECT doc_id, lower(text || CASE doc_id % 7 WHEN 0 THEN ' English Commentary' WHEN 1 THEN ' Brazilian Portuguese SDH'
  WHEN 2 THEN ' French forced' WHEN 3 THEN ' German hard of hearing' ELSE '' END) AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, 'portuguese') THEN 'por' WHEN contains(t, 'english') THEN 'eng' WHEN contains(t, 'french') THEN 'fra'
  WHEN contains(t, 'spanish') THEN 'spa' WHEN contains(t, 'german') THEN 'deu' WHEN contains(t, 'italian') THEN 'ita' WHEN contains(t, 'japanese') THEN 'jpn'
  WHEN contains(t, 'dutch') THEN 'nld' WHEN contains(t, 'russian') THEN 'rus' WHEN contains(t, 'chinese') THEN 'zho' WHEN contains(t, 'korean') THEN 'kor' ELSE 'und' END AS lang,
  contains(t, 'forced') AS forced, contains(t, 'commentary') AS commentary, contains(t, 'sdh') OR contains(t, 'hard of hearing') OR contains(t, 'hearing impaired') AS sdh FROM d""")
def _(spark, sf_dir):
    key = F.col("doc_id") % 7
    note = (
        F.when(key == 0, " English Commentary")
        .when(key == 1, " Brazilian Portuguese SDH")
        .when(key == 2, " French forced")
        .when(key == 3, " German hard of hearing")
        .otherwise("")
    )
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", note).alias("d"))
    return docs.select("doc_id", lang.describe_track(F.col("d")).alias("x")).select("doc_id", "x.*")


@query("f14_tick_diff", f"""WITH {_CLOCK}
SELECT event_id, ((pts * 1000003 - k * pts * 7919) % 8589934592 + 8589934592) % 8589934592 AS diff FROM c""")
def _(spark, sf_dir):
    first, second = F.col("pts") * 1_000_003, F.col("k") * F.col("pts") * 7919
    return _clocked(spark, sf_dir).select("event_id", clock.tick_diff(first, second).alias("diff"))


@query("f15_source_ref", """WITH p AS (SELECT page_id, length(html) AS n, regexp_extract(url, '[^/]*$') AS file FROM pages)
SELECT page_id, CASE WHEN n % 3 = 0 THEN printf('%05d', n % 100000) || '.mpls' WHEN n % 3 = 1 THEN printf('%02d', n % 100) ELSE file END AS source FROM p""")
def _(spark, sf_dir):
    # The length of a page says what kind of source it is; files are the last part of its address.
    size = F.length("html").cast("long")
    return b.table(spark, sf_dir, "pages").select(
        "page_id",
        x.source_ref(
            F.when(size % 3 == 0, F.format_string("%05d", size % 100_000)),
            F.when(size % 3 == 1, size % 100),
            F.regexp_extract("url", "[^/]*$", 0),
        ).alias("source"),
    )


@query("f16_short_name", """WITH n AS (SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' - ' ELSE '' END || CASE p_partkey % 5 WHEN 4 THEN '' ELSE p_name END ||
  CASE p_partkey % 4 WHEN 0 THEN ' - Blu-ray' WHEN 1 THEN ' - BLU-RAY 3D™ ' ELSE '' END AS name FROM part),
r AS (SELECT *, CASE WHEN starts_with(name, p_brand || ' - ') THEN substr(name, length(p_brand) + 4) ELSE name END AS rest FROM n),
c AS (SELECT *, regexp_replace(rest, '\\s+-\\s+Blu-ray(?:\\s*3D)?(?:\\s*[™℠])?\\s*$', '', 'i') AS cut FROM r)
SELECT p_partkey, CASE WHEN cut <> '' THEN cut ELSE rest END AS short FROM c""")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    head = F.when(key % 3 == 0, F.concat("p_brand", F.lit(" - "))).otherwise("")
    body = F.when(key % 5 == 4, "").otherwise(F.col("p_name"))
    tail = F.when(key % 4 == 0, " - Blu-ray").when(key % 4 == 1, " - BLU-RAY 3D™ ").otherwise("")
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", x.short_name(F.concat(head, body, tail), F.col("p_brand")).alias("short")
    )


@query("f17_quote_slug", """WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' "R&B" ' WHEN 1 THEN chr(10) || '#1!' ELSE ' - ' END AS v FROM part)
SELECT p_partkey, '"' || replace(replace(replace(v, '"', ''''), chr(13), ' '), chr(10), ' ') || '"' AS quoted,
  trim(regexp_replace(regexp_replace(replace(lower(v), '&', 'and'), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-') AS slug FROM n""")
def _(spark, sf_dir):
    key = F.col("p_partkey") % 3
    value = F.concat("p_name", F.when(key == 0, ' "R&B" ').when(key == 1, "\n#1!").otherwise(" - "))
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", x.quote_log(value).alias("quoted"), x.slugify(value).alias("slug")
    )


@query("f18_catalog_number", """WITH n AS (SELECT page_id, CASE length(html) % 3 WHEN 0 THEN '978-' || (1000000000 + length(html)) WHEN 1 THEN 'No. ' || (100000000000 + length(html)) ELSE url END AS raw FROM pages),
d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM n)
SELECT page_id, CASE WHEN length(digits) IN (12, 13) THEN digits ELSE raw END AS ean FROM d""")
def _(spark, sf_dir):
    size = F.length("html").cast("long")
    raw = (
        F.when(size % 3 == 0, F.concat(F.lit("978-"), (1_000_000_000 + size).cast("string")))
        .when(size % 3 == 1, F.concat(F.lit("No. "), (F.lit(100_000_000_000) + size).cast("string")))
        .otherwise(F.col("url"))
    )
    return b.table(spark, sf_dir, "pages").select("page_id", x.ean(raw).alias("ean"))


@query("f20_first_known", """SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'default') AS value FROM orders""")
def _(spark, sf_dir):
    flag = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority"))
    saved = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", x.first_known(flag, saved, F.lit("default")).alias("value"))


@query("f21_safe_name", """WITH n AS (SELECT p_partkey, p_partkey % 120 AS idx, p_name || CASE p_partkey % 5 WHEN 0 THEN ': a/b?' WHEN 1 THEN ' - Title ' || (p_partkey % 120 + 1)
  WHEN 2 THEN ' - blu-ray™' WHEN 3 THEN '  (é) ¡x!  ' ELSE '' END AS name FROM part),
s AS (SELECT *, CASE WHEN ends_with(name, ' - Title ' || (idx + 1)) THEN left(name, length(name) - length(' - Title ' || (idx + 1))) ELSE name END AS a FROM n),
c AS (SELECT *, regexp_replace(a, '\\s+-\\s+Blu-ray(?:\\s*[™℠])?\\s*$', '', 'i') AS b FROM s)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN b <> '' THEN b ELSE name END, '[<>:"/\\\\|?*]', '_', 'g'), '[^\\p{L}\\p{N}_\\s\\-.]', '', 'g'), '\\s+', ' ', 'g')) || printf('_t%02d.mkv', idx) AS file FROM c""")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    index = (key % 120).cast("int")
    tail = (
        F.when(key % 5 == 0, ": a/b?")
        .when(key % 5 == 1, F.concat(F.lit(" - Title "), (index + 1).cast("string")))
        .when(key % 5 == 2, " - blu-ray™")
        .when(key % 5 == 3, "  (é) ¡x!  ")
        .otherwise("")
    )
    return b.table(spark, sf_dir, "part").select("p_partkey", x.safe_name(F.concat("p_name", tail), index).alias("file"))


_HEX2 = "CASE WHEN {0} IS NULL THEN NULL ELSE lpad(hex({0}), 2, '0') END"


@query("f22_source_id", f"""WITH {b.STREAMS}, s AS (SELECT *, title_id % 3 AS medium, 192 + pos % 12 AS sub, pos % 5 AS ti FROM streams)
SELECT title_id, pos, CASE WHEN medium = 0 THEN CASE type WHEN 'video' THEN CASE WHEN title_id % 2 = 0 THEN '0100E2' END
    WHEN 'audio' THEN '01' || lpad(hex(192 + ti), 2, '0') || 'BD' ELSE '01' || lpad(hex(32 + ti), 2, '0') || 'BD' END
  WHEN pid IS NOT NULL THEN '00' || lpad(hex(pid), 4, '0')
  WHEN medium = 1 THEN '07' || CASE WHEN type = 'video' THEN '00E0' WHEN type = 'audio' AND sub BETWEEN 192 AND 199 THEN '00' || lpad(hex(sub), 2, '0')
    ELSE lpad(hex(sub), 2, '0') || 'BD' END END AS source_id FROM s""")
def _(spark, sf_dir):
    streams = b.streams(spark, sf_dir)
    medium = F.col("title_id") % 3
    done = x.source_id(
        F.when(medium == 0, "hddvd").otherwise("disc"),
        F.col("type"),
        F.col("pid"),
        (192 + F.col("pos") % 12).cast("long"),
        F.when(medium == 1, 7),
        F.col("pos") % 5,
        F.when(F.col("title_id") % 2 == 0, 0xE2),
    )
    return streams.select("title_id", "pos", done.alias("source_id"))


@query("f23_display_name", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN '' END AS n, CASE WHEN p_partkey % 4 = 2 THEN p_brand END AS d,
  CASE WHEN p_partkey % 3 = 0 THEN 'Trailer' || p_size WHEN p_partkey % 3 = 1 THEN '' END AS i FROM part),
c AS (SELECT *, coalesce(nullif(n, ''), nullif(d, ''), nullif(i, ''), 'Title ' || p_partkey) AS chosen FROM p)
SELECT p_partkey, CASE WHEN contains(lower(coalesce(i, '')), 'trailer') AND NOT contains(lower(chosen), 'trailer') THEN chosen || ' (Trailer)' ELSE chosen END AS name FROM c""")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, F.col("p_name")).when(key % 4 == 1, "")
    description = F.when(key % 4 == 2, F.col("p_brand"))
    ident = F.when(key % 3 == 0, F.concat(F.lit("Trailer"), F.col("p_size").cast("string"))).when(key % 3 == 1, "")
    return b.table(spark, sf_dir, "part").select("p_partkey", x.display_name(name, description, ident, key).alias("name"))
