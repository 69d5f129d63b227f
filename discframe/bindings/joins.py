"""Registered join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.aggregate import disc_items
from discframe.bindings.registry import query
from discframe.bindings.sequence import item_marks
from discframe.functions import lang
from discframe.operators import joins as j
from discframe.operators import ordered as o
from discframe.operators import project as p
from discframe.operators import sequence as s
from discframe.session import cut_lineage

_TI = "CAST(row_number() OVER (PARTITION BY title_id, type ORDER BY pos) - 1 AS INTEGER)"


@query("j1_map_tracks", f"""WITH {b.STREAMS}, st AS (SELECT *, {_TI} AS ti, CASE WHEN pid % 3 = 0 THEN NULL ELSE pid END AS p2,
    CASE WHEN pid % 3 = 0 THEN pid % 40 END AS sub FROM streams),
tr AS (SELECT title_id, pos AS track_id, CASE type WHEN 'subtitle' THEN 'subtitles' ELSE type END AS t,
  CASE WHEN p2 IS NULL THEN (sub * 4294967296) | 189 WHEN channels = 2 THEN p2 ELSE p2 + 1 END AS number FROM st WHERE codec <> 'c4'),
pos AS (SELECT *, row_number() OVER (PARTITION BY title_id, t ORDER BY track_id) - 1 AS i FROM tr),
ids AS (SELECT s.title_id, s.pos, min(track_id) AS by_id FROM st s JOIN tr ON tr.title_id = s.title_id
  AND (tr.number = coalesce(p2, sub) OR (p2 IS NULL AND type = 'audio' AND tr.number = (sub * 4294967296) | 189)) GROUP BY 1, 2)
SELECT s.title_id, s.pos, CASE WHEN muxable THEN coalesce(by_id, pos.track_id, -1) ELSE -1 END AS track,
  CASE WHEN NOT muxable THEN 'none' WHEN by_id IS NOT NULL THEN 'id' WHEN pos.track_id IS NOT NULL THEN 'position' ELSE 'none' END AS how
FROM st s LEFT JOIN ids ON ids.title_id = s.title_id AND ids.pos = s.pos
LEFT JOIN pos ON pos.title_id = s.title_id AND pos.i = s.ti AND pos.t = CASE type WHEN 'subtitle' THEN 'subtitles' ELSE type END""")
def _(spark, sf_dir):
    pid = F.col("pid")
    read = b.streams(spark, sf_dir).select("title_id", "pos", "type", "codec", "channels", "pid", "muxable")
    # Streams and their tracks: written once.
    streams = cut_lineage(p.type_index(read)).withColumns(
        {"sub_id": F.when(pid % 3 == 0, pid % 40), "pid": F.when(pid % 3 != 0, pid)}
    )
    private = F.shiftleft(F.col("sub_id").cast("long"), 32).bitwiseOR(F.lit(0xBD))
    number = F.when(F.col("pid").isNull(), private).when(F.col("channels") == 2, F.col("pid")).otherwise(F.col("pid") + 1)
    tracks = streams.filter(F.col("codec") != "c4").select(
        "title_id",
        F.col("pos").alias("track_id"),
        F.when(F.col("type") == "subtitle", "subtitles").otherwise(F.col("type")).alias("type"),
        number.alias("number"),
    )
    return j.map_tracks(streams, tracks).select("title_id", "pos", "track", "how")


@query("j2_overlay", """SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, o_totalprice) AS amount,
  coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, c_mktsegment) AS label
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def _(spark, sf_dir):
    left = b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("k"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("label"),
    )
    right = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("amount"),
        F.col("c_mktsegment").alias("label"),
    )
    return j.overlay(left, right, ["k"], override=["amount"], fill=["label"]).drop("k")


@query("j3_overlay_languages", f"""WITH {b.STREAMS}, st AS (SELECT *, {_TI} AS ti FROM streams),
ls AS (SELECT *, CASE WHEN type = 'audio' AND pid IS NOT NULL THEN pid % 16 END AS sub FROM st),
dc AS (SELECT title_id, type AS kind, CAST(row_number() OVER (PARTITION BY title_id, type ORDER BY pos) - 1 AS INTEGER) AS ordinal,
  CASE WHEN type = 'audio' THEN sub END AS sub, 'x' || lang AS lang, is_forced FROM ls WHERE codec <> 'c1'),
bs AS (SELECT title_id, kind, sub, arg_min(struct_pack(l := lang, f := is_forced), ordinal) AS h FROM dc WHERE sub IS NOT NULL GROUP BY 1, 2, 3),
au AS (SELECT title_id, bool_and(sub IS NOT NULL) AS known FROM dc WHERE kind = 'audio' GROUP BY 1),
jn AS (SELECT ls.*, bs.h AS hs, dc.lang AS pl, dc.is_forced AS pf, dc.title_id IS NOT NULL AS has_pos,
  CASE WHEN type = 'video' THEN ti > 0 ELSE type = 'audio' AND ls.sub IS NOT NULL AND coalesce(known, false) AND bs.h IS NULL END AS secondary
  FROM ls LEFT JOIN bs ON bs.title_id = ls.title_id AND bs.kind = type AND bs.sub = ls.sub
  LEFT JOIN dc ON dc.title_id = ls.title_id AND dc.kind = type AND dc.ordinal = ti LEFT JOIN au ON au.title_id = ls.title_id)
SELECT title_id, pos, secondary, CASE WHEN secondary THEN lang ELSE coalesce(hs.l, pl, lang) END AS lang,
  is_forced OR (NOT secondary AND coalesce(CASE WHEN hs IS NOT NULL THEN hs.f ELSE pf END, false)) AS is_forced,
  is_default AND NOT secondary AS is_default FROM jn""")
def _(spark, sf_dir):
    streams = p.type_index(b.streams(spark, sf_dir)).withColumn("is_hearing_impaired", F.lit(False))
    sub = F.when((F.col("type") == "audio") & F.col("pid").isNotNull(), F.col("pid") % 16)
    declared = o.ordered(
        streams.withColumn("sub", sub).filter(F.col("codec") != "c1"), ["title_id", "type"], ["pos"], _rn=o.row_number()
    ).select(
        "title_id",
        F.col("type").alias("kind"),
        (F.col("_rn") - 1).alias("ordinal"),
        F.col("sub").alias("sub_id"),
        F.concat(F.lit("x"), F.col("lang")).alias("lang"),
        "is_forced",
        F.lit(False).alias("is_commentary"),
        F.lit(False).alias("is_hearing_impaired"),
        F.lit("").alias("description"),
    )
    probed = streams.withColumn("sub_id", F.shiftleft(sub.cast("long"), 32).bitwiseOR(F.lit(0xBD)))
    done = j.overlay_languages(probed, declared)
    return done.select("title_id", "pos", "secondary", "lang", "is_forced", "is_default")


# Local ids of a customer and catalog ids of the orders dimension, sharing a small space.
_LOCAL = """loc AS (SELECT c_custkey AS disc_id, 'hash' AS kind, 'h' || c_custkey % 700 AS value FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT c_custkey, 'global', 'g' || c_custkey % 400 FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 'upc', CAST(c_nationkey * 100 + c_custkey % 60 AS VARCHAR) FROM customer)"""
_REMOTE = """rem AS (SELECT o_orderkey AS remote_id, o_orderkey AS ordinal, CAST(o_orderkey % 3 AS VARCHAR) AS signature, 'hash' AS kind,
    'H' || o_orderkey % 1000 AS value FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, o_orderkey, CAST(o_orderkey % 3 AS VARCHAR), 'global', 'G' || o_orderkey % 2000 FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, o_orderkey, CAST(o_orderkey % 3 AS VARCHAR), 'upc', CAST(o_orderkey % 3000 AS VARCHAR) FROM orders)"""


@query("j4_match_discs", f"""WITH {_LOCAL}, {_REMOTE},
h AS (SELECT disc_id, l.kind, remote_id, ordinal, signature FROM loc l JOIN rem r ON l.kind = r.kind AND upper(l.value) = upper(r.value)),
s AS (SELECT disc_id, count(DISTINCT signature) AS n, arg_min(remote_id, ordinal) AS r FROM h WHERE kind <> 'upc' GROUP BY 1),
u AS (SELECT disc_id, count(*) AS n, min(remote_id) AS r FROM h WHERE kind = 'upc' GROUP BY 1)
SELECT d.disc_id, CASE WHEN s.n IS NOT NULL THEN CASE WHEN s.n = 1 THEN s.r END WHEN u.n = 1 THEN u.r END AS remote_id,
  coalesce(s.n > 1, false) AS ambiguous
FROM (SELECT DISTINCT disc_id FROM loc) d LEFT JOIN s USING (disc_id) LEFT JOIN u USING (disc_id)""")
def _(spark, sf_dir):
    key = F.col("c_custkey")
    customer = b.table(spark, sf_dir, "customer").select(key.alias("disc_id"), "c_custkey", "c_nationkey")

    def ids(df, kind, value):
        return df.select("disc_id", F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    local = (
        ids(customer.filter(key % 3 != 0), "hash", F.concat(F.lit("h"), key % 700))
        .unionByName(ids(customer.filter(key % 5 == 0), "global", F.concat(F.lit("g"), key % 400)))
        .unionByName(ids(customer, "upc", F.col("c_nationkey") * 100 + key % 60))
    )
    order = F.col("o_orderkey")
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey")

    def entries(df, kind, value):
        return df.select(
            order.alias("remote_id"),
            order.alias("ordinal"),
            (order % 3).cast("string").alias("signature"),
            F.lit(kind).alias("kind"),
            value.cast("string").alias("value"),
        )

    remote = (
        entries(orders.filter(order % 4 == 0), "hash", F.concat(F.lit("H"), order % 1000))
        .unionByName(entries(orders.filter(order % 5 == 0), "global", F.concat(F.lit("G"), order % 2000)))
        .unionByName(entries(orders, "upc", order % 3000))
    )
    return j.match_discs(local, remote)


@query("j5_correlate_titles", f"""WITH {b.TITLES},
k AS (SELECT title_id, CAST(title_idx % 4 AS VARCHAR) AS source_key FROM titles UNION SELECT title_id, 'p' || priority FROM titles),
r AS (SELECT disc_id, title_id + 1000000 AS remote_title, CAST(title_idx % 4 AS VARCHAR) AS source_key, duration + title_id % 5 AS duration FROM titles
  UNION ALL SELECT disc_id, title_id + 2000000, 'p' || priority, duration - 4 FROM titles),
c AS (SELECT t.disc_id, t.title_id, min(remote_title) AS remote_title, count(DISTINCT remote_title) AS n
  FROM titles t JOIN k USING (title_id) JOIN r ON r.disc_id = t.disc_id AND r.source_key = k.source_key AND abs(r.duration - t.duration) <= 3 GROUP BY 1, 2),
s AS (SELECT * FROM c WHERE n = 1),
bad AS (SELECT DISTINCT disc_id FROM (SELECT disc_id, remote_title FROM s GROUP BY 1, 2 HAVING count(*) > 1))
SELECT disc_id, title_id, remote_title FROM s WHERE disc_id NOT IN (SELECT disc_id FROM bad)""")
def _(spark, sf_dir):
    titles = b.titles(spark, sf_dir)
    by_index, by_rank = (F.col("title_idx") % 4).cast("string"), F.concat(F.lit("p"), F.col("priority"))
    keys = titles.select("title_id", F.explode(F.array(by_index, by_rank)).alias("source_key"))
    remote = titles.select(
        "disc_id", (F.col("title_id") + 1_000_000).alias("remote_title"), by_index.alias("source_key"),
        (F.col("duration") + F.col("title_id") % 5).alias("duration"),
    ).unionByName(
        titles.select(
            "disc_id", (F.col("title_id") + 2_000_000).alias("remote_title"), by_rank.alias("source_key"),
            (F.col("duration") - 4).alias("duration"),
        )
    )
    return j.correlate_titles(titles.select("disc_id", "title_id", "duration"), keys, remote)


@query("j6_undeclared", f"""WITH {b.STREAMS}
SELECT DISTINCT title_id, pid FROM streams s WHERE pid <> 0 AND NOT EXISTS
  (SELECT 1 FROM streams d WHERE d.title_id = s.title_id AND d.pid = s.pid AND d.codec <> 'c2')""")
def _(spark, sf_dir):
    streams = b.streams(spark, sf_dir)
    return j.undeclared(streams, streams.filter(F.col("codec") != "c2"), ["title_id"], "pid")


_DI = "di AS (SELECT disc_id, title_idx, i.* FROM items i JOIN titles USING (title_id))"


@query("j7_shared_items", f"""WITH {b.ITEMS}, {b.TITLES}, {_DI},
st AS (SELECT disc_id, title_id, list_sort(list(DISTINCT clip_id)) AS items FROM di GROUP BY 1, 2),
rp AS (SELECT disc_id, items, min(title_id) AS rep, count(*) AS members FROM st GROUP BY 1, 2),
pr AS (SELECT x.disc_id, x.rep AS a, y.rep AS b, len(list_intersect(x.items, y.items)) AS shared, x.members AS members_a, y.members AS members_b
  FROM rp x JOIN rp y ON x.disc_id = y.disc_id AND x.rep < y.rep)
SELECT * FROM pr WHERE shared >= 3
UNION ALL SELECT disc_id, rep, rep, len(items), members, members FROM rp WHERE members > 1 AND len(items) >= 3""")
def _(spark, sf_dir):
    return j.shared_items(disc_items(spark, sf_dir), "disc_id", "title_id", "clip_id", 3)


@query("j8_near_ranges", f"""WITH {b.TITLES}, v AS (SELECT disc_id, CAST(round(duration * 1000000) AS BIGINT) AS v, count(*) AS n FROM titles GROUP BY 1, 2)
SELECT a.disc_id, a.v, a.n, CAST(sum(b.n) AS BIGINT) AS near, min(b.v) AS first_v, max(b.v) AS last_v FROM v a JOIN v b ON a.disc_id = b.disc_id
  AND abs(a.v - b.v) * 100 <= 15 * greatest(a.v, b.v, 1000000) GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    ranges = j.near_ranges(b.titles(spark, sf_dir), "disc_id", "duration")
    # The extreme members of each range, from the same counts.
    values = ranges.select("disc_id", F.col("v").alias("m"), F.col("n").alias("_n"))
    upto = o.ordered(values, "disc_id", ["m"], _upto=o.sum_to("_n")).withColumn("_from", F.col("_upto") - F.col("_n"))
    low = upto.select("disc_id", F.col("_from").alias("rank_lo"), F.col("m").alias("first_v"))
    high = upto.select("disc_id", F.col("_upto").alias("rank_hi"), F.col("m").alias("last_v"))
    joined = ranges.join(low, ["disc_id", "rank_lo"]).join(high, ["disc_id", "rank_hi"])
    return joined.select("disc_id", "v", "n", "near", "first_v", "last_v")


@query("j9_asof_interval", """WITH p AS (SELECT event_id, user_id % 50 AS k, value FROM events),
i AS (SELECT o_custkey % 50 AS k, floor(o_totalprice / 100) / 10 AS start, max(o_orderkey) AS ord FROM orders GROUP BY 1, 2)
SELECT event_id, p.k, value, i.start AS iv_start, i.ord FROM p ASOF LEFT JOIN i ON p.k = i.k AND p.value + 0.000001 >= i.start""")
def _(spark, sf_dir):
    points = b.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("k"), "value")
    intervals = (
        b.table(spark, sf_dir, "orders")
        .groupBy((F.col("o_custkey") % 50).alias("k"), (F.floor(F.col("o_totalprice") / 100) / 10).alias("start"))
        .agg(F.max("o_orderkey").alias("ord"))
    )
    return j.asof_interval(points, intervals, "k", "value", "start", ["ord"], epsilon=1e-6)


@query("j10_overlap_join", f"""WITH {b.ITEMS},
pa AS (SELECT title_id, pos, coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  sum(duration) OVER (PARTITION BY title_id ORDER BY pos) AS e, sum(duration) OVER (PARTITION BY title_id) AS total FROM items),
wi AS (SELECT title_id, w, w * 35 AS s, least(w * 35 + 30, total) AS e FROM (SELECT DISTINCT title_id, total FROM pa), generate_series(0, 40) g(w) WHERE w * 35 < total)
SELECT pa.title_id, pos, w, greatest(pa.s, wi.s) AS "start", least(pa.e, wi.e) AS "end", greatest(pa.s, wi.s) - pa.s AS in_part
FROM pa JOIN wi ON wi.title_id = pa.title_id AND wi.s < pa.e AND pa.s < wi.e""")
def _(spark, sf_dir):
    parts = item_marks(spark, sf_dir).select(
        "title_id", F.col("mark_idx").alias("pos"), F.col("t").alias("start"), (F.col("t") + F.col("duration")).alias("end")
    )
    total = parts.groupBy("title_id").agg(F.max("end").alias("total"))
    windows = total.select(
        "title_id", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / 35).cast("int"))).alias("w")
    ).select(
        "title_id",
        F.col("w").cast("long").alias("w"),
        (F.col("w") * 35.0).alias("start"),
        F.least(F.col("w") * 35.0 + 30.0, "total").alias("end"),
    )
    cut = j.overlap_join(parts, windows, "title_id", "pos", "w")
    return cut.select("title_id", "pos", "w", "start", "end", (F.col("start") - F.col("left_start")).alias("in_part"))


@query("j11_assign_owner", f"""WITH {b.CELLS}, ow AS (SELECT chain_id, vob_id, cell_id, min(pos) AS owner FROM cells GROUP BY 1, 2, 3),
un AS (SELECT chain_id, pos AS unit, (vob_id + 1) % 3 AS vob_id, cell_id, first_sector AS sector FROM cells WHERE first_sector BETWEEN 3000 AND 90000)
SELECT chain_id, unit, vob_id, cell_id, sector, owner FROM un JOIN ow USING (chain_id, vob_id, cell_id)""")
def _(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    units = cells.select(
        "chain_id",
        F.col("pos").alias("unit"),
        ((F.col("vob_id") + 1) % 3).alias("vob_id"),
        "cell_id",
        F.col("first_sector").alias("sector"),
    )
    return j.assign_owner(units, cells, ["chain_id", "vob_id", "cell_id"], F.lit(3000), F.lit(90_000))


@query("j12_require_all", f"""WITH {b.STREAMS}
SELECT t.title_id, r.codec FROM (SELECT DISTINCT title_id FROM streams) t, (VALUES ('c0'), ('c1'), ('c2')) r(codec)
WHERE NOT EXISTS (SELECT 1 FROM streams s WHERE s.title_id = t.title_id AND s.codec = r.codec)""")
def _(spark, sf_dir):
    streams = b.streams(spark, sf_dir)
    return j.require_all(streams, ["c0", "c1", "c2"], streams, "title_id", "codec")


@query("j13_drop_incompatible", f"""WITH {b.STREAMS}, t AS (SELECT title_id, pos AS item, coalesce(pid, 0) % 2 AS track_id, channels FROM streams),
f AS (SELECT title_id, track_id, max(channels) AS want FROM t WHERE item = 0 GROUP BY 1, 2)
SELECT t.title_id, item, bool_or(coalesce(channels <> want AND item > 0, false)) AS dropped
FROM t LEFT JOIN f ON f.title_id = t.title_id AND f.track_id = t.track_id GROUP BY 1, 2""")
def _(spark, sf_dir):
    tracks = b.streams(spark, sf_dir).select(
        "title_id", F.col("pos").alias("item"), (F.coalesce("pid", F.lit(0)) % 2).alias("track_id"), "channels"
    )
    return j.drop_incompatible(tracks)


@query("j14_lookup", """SELECT c_custkey, coalesce(n_name, 'unknown') AS nation,
  CASE c_nationkey % 3 WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt470bg' ELSE 'unknown' END AS color
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE 0 END""")
def _(spark, sf_dir):
    # Every seventh customer asks for a code that no nation has.
    code = F.col("c_nationkey") + F.when(F.col("c_custkey") % 7 == 0, 100).otherwise(0)
    nation = b.table(spark, sf_dir, "nation")
    joined = b.table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == code, "left")
    color = lang.lookup({0: "bt709", 1: "bt470bg"}, F.col("c_nationkey") % 3, F.lit("unknown"))
    return joined.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), color.alias("color"))


@query("j15_best_movie", """WITH m AS (SELECT p_name AS name, p_size AS year, min(p_partkey) AS movie_id FROM part GROUP BY 1, 2),
q AS (SELECT p_partkey AS query_id, p_name AS name, p_size + p_partkey % 2 AS qy FROM part),
r AS (SELECT query_id, movie_id, year = qy AS same_year, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN year = qy THEN 0 ELSE 1 END, movie_id) AS r
  FROM q JOIN m USING (name))
SELECT query_id, movie_id, same_year FROM r WHERE r = 1""")
def _(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    queries = part.select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"), (F.col("p_size") + F.col("p_partkey") % 2).alias("year")
    )
    movies = part.select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("movie_id"), F.col("p_size").alias("year"), F.col("p_partkey").alias("rank")
    )
    return j.best_movie(queries, movies)


@query("j16_redistribute", f"""WITH {b.TICKS}, mi AS (SELECT DISTINCT stream_id, k % 7 AS id FROM ticks WHERE kind = 'purchase'),
ms AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY id) - 1 AS slot, count(*) OVER (PARTITION BY stream_id) AS n FROM mi),
orp AS (SELECT stream_id, seq, pts, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1 AS rn FROM ticks WHERE kind = 'view')
SELECT o.stream_id, seq, pts, id FROM orp o JOIN ms ON ms.stream_id = o.stream_id AND ms.slot = o.rn % ms.n""")
def _(spark, sf_dir):
    ticks = b.ticks(spark, sf_dir)
    missing = ticks.filter(F.col("kind") == "purchase").select("stream_id", (F.col("k") % 7).alias("id"))
    orphans = ticks.filter(F.col("kind") == "view").select("stream_id", "seq", "pts")
    return j.redistribute(orphans, missing, "stream_id", ["pts", "seq"], "id")


@query("j17_streams_from_ids", f"""WITH {b.STREAMS}, i AS (SELECT DISTINCT title_id, pid AS stream_id, (pid * 7) % 24 AS attr FROM streams WHERE pid IS NOT NULL),
at AS (SELECT title_id, (pid * 7) % 24 AS attr, min(codec) AS codec, min(channels) AS channels FROM streams WHERE type = 'audio' AND pid IS NOT NULL GROUP BY 1, 2),
la AS (SELECT title_id, (pid * 7) % 24 AS attr, min(lang) AS lang FROM streams WHERE type <> 'video' AND pid IS NOT NULL GROUP BY 1, 2)
SELECT i.title_id, i.stream_id, i.attr, coalesce(codec, 'ac3') AS codec, coalesce(channels, 2) AS channels, coalesce(lang, 'und') AS lang,
  CAST(row_number() OVER (PARTITION BY i.title_id ORDER BY i.attr, i.stream_id) - 1 AS INTEGER) AS type_index
FROM i LEFT JOIN "at" a ON a.title_id = i.title_id AND a.attr = i.attr LEFT JOIN la ON la.title_id = i.title_id AND la.attr = i.attr""".replace("at AS (SELECT title_id, (pid", '"at" AS (SELECT title_id, (pid'))
def _(spark, sf_dir):
    known = b.streams(spark, sf_dir).filter(F.col("pid").isNotNull()).withColumn("attr", F.col("pid") * 7 % 24)
    ids = known.select("title_id", F.col("pid").alias("stream_id"), "attr").distinct()
    attributes = known.filter(F.col("type") == "audio").groupBy("title_id", "attr").agg(
        F.min("codec").alias("codec"), F.min("channels").alias("channels")
    )
    languages = known.filter(F.col("type") != "video").groupBy("title_id", "attr").agg(F.min("lang").alias("lang"))
    return j.streams_from_ids(ids, attributes, languages)


@query("j18_inherited_ids", f"""WITH {b.ITEMS}, {b.TITLES}, {_DI},
c AS (SELECT DISTINCT disc_id, title_idx, clip_id FROM di),
i AS (SELECT disc_id, title_idx, size % 8 AS stream_id, min(part_id) AS attr FROM di WHERE part_id % 3 = 0 GROUP BY 1, 2, 3),
x AS (SELECT DISTINCT a.disc_id, a.title_idx, b.title_idx AS other FROM c a JOIN c b USING (disc_id, clip_id)),
al AS (SELECT x.disc_id, x.title_idx, i.stream_id, i.attr, x.other, x.other = x.title_idx AS own FROM x JOIN i ON i.disc_id = x.disc_id AND i.title_idx = x.other
  UNION SELECT disc_id, title_idx, stream_id, attr, title_idx, true FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY disc_id, title_idx, stream_id ORDER BY own DESC, other) AS r FROM al)
SELECT disc_id, title_idx, stream_id, attr, own FROM r WHERE r = 1""")
def _(spark, sf_dir):
    rows = disc_items(spark, sf_dir)
    ids = (
        rows.filter(F.col("part_id") % 3 == 0)
        .groupBy("disc_id", "title_idx", (F.col("size") % 8).alias("stream_id"))
        .agg(F.min("part_id").alias("attr"))
    )
    return j.inherited_ids(rows, ids, "disc_id", "title_idx", "clip_id")


@query("j19_lookup_relaxed", f"""WITH {b.CELLS}, e AS (SELECT chain_id, vob_id, cell_id, pos, first_sector FROM cells WHERE block_mode <> 2),
f AS (SELECT chain_id, vob_id, cell_id, arg_max(first_sector, pos) AS v FROM e GROUP BY 1, 2, 3),
g AS (SELECT cell_id, arg_min(first_sector, struct_pack(c := chain_id, p := pos)) AS v FROM e GROUP BY 1)
SELECT c.chain_id, c.pos, coalesce(f.v, g.v) AS sector, f.v IS NOT NULL AS exact
FROM cells c LEFT JOIN f ON f.chain_id = c.chain_id AND f.vob_id = c.vob_id AND f.cell_id = c.cell_id LEFT JOIN g ON g.cell_id = c.cell_id""")
def _(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    entries = cells.filter(F.col("block_mode") != 2).withColumns(
        {"place": F.struct("chain_id", "pos"), "sector": F.col("first_sector")}
    )
    found = j.lookup_relaxed(
        cells.select("chain_id", "pos", "vob_id", "cell_id"),
        entries,
        ["chain_id", "vob_id", "cell_id"],
        "cell_id",
        "place",
        "sector",
    )
    return found.select("chain_id", "pos", "sector", "exact")


@query("j20_first_title", f"""WITH {b.TITLES} SELECT disc_id, priority, arg_min(title_id, title_idx) AS title_id FROM titles GROUP BY 1, 2""")
def _(spark, sf_dir):
    sets = b.titles(spark, sf_dir).withColumn("set", F.struct("disc_id", "priority"))
    return j.first_title(sets, "set", "title_idx", "title_id").select("set.*", "title_id")
