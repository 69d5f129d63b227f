"""Registered projection, filter and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.registry import query
from discframe.functions import lang
from discframe.operators import project as p

_NOTABLE = b.NOTABLE_SQL.format(minimum=1200, plain=3000)


def _facts(spark, sf_dir):
    return p.title_facts(b.titles(spark, sf_dir), b.streams(spark, sf_dir), b.items(spark, sf_dir), share=0.5)


@query("s1_catalog_rows", """
SELECT o_orderpriority AS priority, count(*) AS n_titles, count(DISTINCT o_custkey) AS n_discs
FROM orders GROUP BY 1""")
def _(spark, sf_dir):
    from discframe.sources.catalog import load_catalog

    catalog = load_catalog(spark, sf_dir, {"orders": {"o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"}})
    return (
        catalog["orders"]
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.count(F.lit(1)).alias("n_titles"), F.count_distinct("o_custkey").alias("n_discs"))
    )


@query("p1_notable", f"""WITH {b.CATALOG}, {b.facts_sql(0.5)}
SELECT disc_id, title_id, {_NOTABLE} AS notable FROM facts""")
def _(spark, sf_dir):
    return _facts(spark, sf_dir).select("disc_id", "title_id", p.notable_flag(minimum=1200, plain=3000).alias("notable"))


@query("p1_hidden_per_disc", f"""WITH {b.CATALOG}, {b.facts_sql(0.5)}
SELECT disc_id, count(*) FILTER (WHERE NOT {_NOTABLE}) AS hidden, count(*) AS n_titles
FROM facts GROUP BY disc_id""")
def _(spark, sf_dir):
    facts = _facts(spark, sf_dir).withColumn("notable", p.notable_flag(minimum=1200, plain=3000))
    return facts.groupBy("disc_id").agg(
        F.count_if(~F.col("notable")).alias("hidden"), F.count(F.lit(1)).alias("n_titles")
    )


@query("p2_short_label", f"""WITH {b.CATALOG}, {b.facts_sql(0.5)}
SELECT title_id, CASE WHEN looped THEN 'Menu loop'
  WHEN duration <= 0 OR (bytes > 0 AND bytes < 4000000) THEN 'Empty'
  WHEN duration < 900 THEN 'Short clip' END AS label FROM facts""")
def _(spark, sf_dir):
    return _facts(spark, sf_dir).select("title_id", p.short_label(short=900, empty_bytes=4_000_000).alias("label"))


@query("p3_loop", f"""WITH {b.ITEMS}, c AS (SELECT title_id, clip_id, count(*) AS n FROM items GROUP BY 1, 2)
SELECT title_id, CAST(sum(n) AS BIGINT) AS n_items, sum(n) >= 5 AND max(n) >= 0.5 * sum(n) AS looped
FROM c GROUP BY title_id""")
def _(spark, sf_dir):
    return p.is_loop(b.items(spark, sf_dir), share=0.5)


_CHOICE = p.Selection(languages=("eng", "fre"), all_audio=False, subtitles=True, forced=False)
_KEEP = """CASE type WHEN 'video' THEN pos = min(CASE WHEN type = 'video' THEN pos END) OVER (PARTITION BY title_id)
  WHEN 'audio' THEN muxable AND lang IN ('eng', 'fre')
  ELSE muxable AND lang IN ('eng', 'fre') AND NOT is_forced END"""


@query("p4_select_streams", f"""WITH {b.STREAMS}, plan AS (SELECT *, {_KEEP} AS keep FROM streams)
SELECT title_id, pos, type, codec, lang FROM plan WHERE keep""")
def _(spark, sf_dir):
    return p.select_streams(b.streams(spark, sf_dir), _CHOICE).select("title_id", "pos", "type", "codec", "lang")


@query("p7_track_plan", f"""WITH {b.STREAMS}
SELECT title_id, pos, type, {_KEEP} AS keep FROM streams""")
def _(spark, sf_dir):
    return p.track_plan(b.streams(spark, sf_dir), _CHOICE).select("title_id", "pos", "type", "keep")


_TYPE_INDEX = "CAST(row_number() OVER (PARTITION BY title_id, type ORDER BY pos) - 1 AS INTEGER)"


@query("w4_type_index", f"""WITH {b.STREAMS}
SELECT title_id, pos, type, {_TYPE_INDEX} AS type_index FROM streams""")
def _(spark, sf_dir):
    return p.type_index(b.streams(spark, sf_dir)).select("title_id", "pos", "type", "type_index")


@query("p5_explicit_selectors", f"""WITH {b.STREAMS}, i AS (SELECT *, {_TYPE_INDEX} AS ti FROM streams),
m AS (SELECT *, CASE WHEN type = 'subtitle' AND ti = 1 THEN 0 WHEN type = 'audio' AND lang = 'eng' THEN 1
  WHEN type = 'video' THEN 2 WHEN type = 'audio' AND ti = 0 THEN 3 END AS selector FROM i)
SELECT title_id, pos, selector,
  CAST(row_number() OVER (PARTITION BY title_id ORDER BY selector, pos) - 1 AS INTEGER) AS out_idx
FROM m WHERE selector IS NOT NULL""")
def _(spark, sf_dir):
    chosen = p.select_explicit(b.streams(spark, sf_dir), ["s:1", "a:eng", "v:all", "a:0", "x:all"])
    return chosen.select("title_id", "pos", "selector", "out_idx")


@query("p6_default_audio", f"""WITH {b.STREAMS},
a AS (SELECT *, bool_or(is_default) OVER (PARTITION BY title_id) AS flagged,
   row_number() OVER (PARTITION BY title_id ORDER BY is_commentary,
     CASE lang WHEN 'ger' THEN 1 WHEN 'eng' THEN 2 ELSE 3 END, pos) AS r
 FROM streams WHERE type = 'audio')
SELECT title_id, pos, lang FROM a WHERE r = 1 AND NOT flagged""")
def _(spark, sf_dir):
    return p.default_audio(b.streams(spark, sf_dir), ["ger", "eng"])


@query("p8_token_flag", """
SELECT p_partkey, list_has_any(regexp_split_to_array(lower(p_name), '[^a-z]+'), ['red', 'bolt']) AS flagged,
  regexp_replace(lower(p_name), '[^a-z]', '', 'g') IN ('mainmovie', 'mainfeature', 'featurefilm') AS authorial
FROM part""")
def _(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(
        "p_partkey",
        p.token_flag("p_name", ["red", "bolt"]).alias("flagged"),
        p.authorial_main("p_name").alias("authorial"),
    )


@query("p9_hash_path", """
WITH m AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'video_ts/' WHEN 1 THEN 'BDMV/stream/' WHEN 2 THEN 'BDMV\\STREAM\\' ELSE '' END
  || regexp_extract(url, '[^/]*$') || CASE page_id % 3 WHEN 0 THEN '.m2ts' ELSE '.ifo' END AS path FROM pages),
u AS (SELECT *, upper(replace(path, '\\', '/')) AS up FROM m)
SELECT page_id, path, starts_with(up, 'VIDEO_TS/') OR (starts_with(up, 'BDMV/STREAM/') AND ends_with(up, '.M2TS')) AS hashed
FROM u""")
def _(spark, sf_dir):
    folder = (
        F.when(F.col("page_id") % 4 == 0, "video_ts/")
        .when(F.col("page_id") % 4 == 1, "BDMV/stream/")
        .when(F.col("page_id") % 4 == 2, "BDMV\\STREAM\\")
        .otherwise("")
    )
    name = F.regexp_extract("url", "[^/]*$", 0)
    suffix = F.when(F.col("page_id") % 3 == 0, ".m2ts").otherwise(".ifo")
    paths = b.table(spark, sf_dir, "pages").select("page_id", F.concat(folder, name, suffix).alias("path"))
    return paths.withColumn("hashed", p.is_hash_path("path"))


@query("p10_scrambled", f"""WITH {b.TICKS}, c AS (SELECT stream_id, count(*) FILTER (WHERE kind = 'error') AS scrambled, count(*) AS total
  FROM ticks GROUP BY 1)
SELECT *, scrambled >= 3 AND scrambled * 4 >= total AS is_scrambled FROM c""")
def _(spark, sf_dir):
    return p.is_scrambled(b.ticks(spark, sf_dir), F.col("kind") == "error", factor=4)


@query("p11_angle_mismatch", f"""WITH {b.CELLS},
f AS (SELECT *, block_mode <> 0 AND is_angle AS inb,
  lag(block_mode) OVER w AS pm, lag(block_mode <> 0 AND is_angle) OVER w AS pin
  FROM cells WINDOW w AS (PARTITION BY chain_id ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN NOT inb OR block_mode = 1 OR pm = 3 OR NOT coalesce(pin, false) THEN 1 ELSE 0 END)
  OVER (PARTITION BY chain_id ORDER BY pos) AS block FROM f),
h AS (SELECT chain_id, block, bool_or(block_mode = 3) AND max(duration) - min(duration) > 1.0 AS bad
  FROM g WHERE inb GROUP BY 1, 2)
SELECT chain_id, bool_or(bad) AS mismatch, count(*) FILTER (WHERE bad) AS bad_blocks FROM h GROUP BY 1""")
def _(spark, sf_dir):
    return p.angle_mismatch(b.cells(spark, sf_dir))


@query("p12_padded", f"""WITH {b.CELLS}
SELECT chain_id, pos, block_mode = 0 AND (flags & 4) = 0
  AND last_sector - first_sector + 1 > (duration + 1.0) * 615.234375 * 1.5 AS padded FROM cells""")
def _(spark, sf_dir):
    return b.cells(spark, sf_dir).select("chain_id", "pos", p.is_padded().alias("padded"))


@query("p13_trim_tail", f"""WITH {b.CELLS},
m AS (SELECT *, max(CASE WHEN duration >= 10 THEN 1 ELSE 0 END)
  OVER (PARTITION BY chain_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM cells)
SELECT chain_id, pos, duration FROM m WHERE later = 1 OR pos = 0""")
def _(spark, sf_dir):
    return p.trim_tail(b.cells(spark, sf_dir), "chain_id", "pos", "duration", 10).select("chain_id", "pos", "duration")


@query("p14_fold_layers", f"""WITH {b.STREAMS}, k AS (SELECT *,
  min(CASE WHEN type = 'video' THEN pos END) OVER (PARTITION BY title_id) AS base,
  max(CASE WHEN type = 'video' AND layer THEN pos END) OVER (PARTITION BY title_id) AS last_layer FROM streams)
SELECT title_id, pos, type, type = 'video' AND pos = base AND coalesce(last_layer > base, false) AS enhanced,
  CASE WHEN type = 'video' AND height IN (720, 1080, 2160) THEN height * 16 // 9 END AS width
FROM k WHERE NOT (type = 'video' AND layer) OR (type = 'video' AND pos = base)""")
def _(spark, sf_dir):
    return p.fold_layers(b.streams(spark, sf_dir)).select("title_id", "pos", "type", "enhanced", "width")


@query("p15_has_codec", f"""WITH {b.STREAMS}
SELECT title_id, bool_or(codec = 'c3') AS has_codec FROM streams GROUP BY 1""")
def _(spark, sf_dir):
    return p.has_codec(b.streams(spark, sf_dir), "c3")


@query("p15_drop_codec", f"""WITH {b.STREAMS}
SELECT title_id, pos, codec FROM streams WHERE codec <> 'c3'""")
def _(spark, sf_dir):
    return p.drop_codec(b.streams(spark, sf_dir), "c3").select("title_id", "pos", "codec")


@query("p16_format_class", f"""WITH {b.STREAMS}, {b.TITLES}
SELECT disc_id, CASE WHEN NOT bool_or(status = 'F') THEN 'DVD'
  WHEN bool_or(type = 'video' AND height * 16 // 9 >= 3000) THEN '4K' ELSE 'Blu-ray' END AS format,
  bool_or(status = 'F' OR priority = 1 OR lang <> 'und') AS eligible
FROM streams JOIN titles USING (title_id) GROUP BY 1""")
def _(spark, sf_dir):
    wide = b.streams(spark, sf_dir).withColumn("width", F.floor(F.col("height") * 16 / 9))
    discs = wide.join(b.titles(spark, sf_dir), "title_id").withColumn(
        "_id", F.when(F.col("lang") != "und", F.col("lang"))
    )
    bluray = F.col("status") == "F"
    discs = discs.withColumn("_ok", p.eligible_source(["_id"], bluray, F.col("priority") == 1))
    formats = p.format_class(discs, "disc_id", bluray)
    return formats.join(discs.groupBy("disc_id").agg(F.bool_or("_ok").alias("eligible")), "disc_id")


@query("p17_flag_original", f"""WITH {b.STREAMS}, {b.TITLES}
SELECT s.title_id, s.pos, type = 'audio' AND NOT is_commentary AND
  CASE lang WHEN 'eng' THEN 'en' WHEN 'fre' THEN 'fr' WHEN 'ger' THEN 'de' WHEN 'jpn' THEN 'ja' ELSE lang END
  = CASE WHEN t.priority = 1 THEN 'en' WHEN t.priority = 2 THEN 'fr' ELSE 'de' END AS is_original
FROM streams s JOIN titles t USING (title_id)""")
def _(spark, sf_dir):
    original = F.when(F.col("priority") == 1, "EN").when(F.col("priority") == 2, "fr").otherwise("de")
    joined = b.streams(spark, sf_dir).join(b.titles(spark, sf_dir).select("title_id", "priority"), "title_id")
    return p.flag_original(joined, original, lang.two_letter(F.lower("lang"))).select("title_id", "pos", "is_original")
