"""Registered aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.registry import query
from discframe.operators import aggregate as a
from discframe.operators import ordered as o
from discframe.sources.catalog import require_columns


@query("a1_stream_summary", f"""WITH {b.STREAMS}, s AS (
SELECT title_id, count(*) FILTER (WHERE type = 'video') AS v, count(*) FILTER (WHERE type = 'audio') AS a,
  count(*) FILTER (WHERE type = 'subtitle') AS s,
  coalesce(list(lang ORDER BY pos) FILTER (WHERE type = 'audio'), []) AS langs FROM streams GROUP BY 1)
SELECT title_id, 'V:' || v || ' A:' || a || ' S:' || s AS summary,
  min(title_id) OVER (PARTITION BY s, langs) AS same_as FROM s""")
def _(spark, sf_dir):
    return a.stream_summary(b.streams(spark, sf_dir))


@query("a2_layout_signature", f"""WITH {b.STREAMS}, s AS (
SELECT title_id, count(*) AS n, list(struct_pack(pos := pos, t := type, c := codec, l := lang, p := pid, h := channels) ORDER BY pos) AS sig
  FROM streams GROUP BY 1)
SELECT title_id, n, min(title_id) OVER (PARTITION BY sig) AS same_as FROM s""")
def _(spark, sf_dir):
    signed = a.layout_signature(
        b.streams(spark, sf_dir), "title_id", ["pos"], ["type", "codec", "lang", "pid", "channels"]
    )
    return a.same_as(signed, "title_id").select("title_id", "n", "same_as")


@query("a3_manifest_fingerprint", f"""WITH {b.FILES}
SELECT group_id, sha256(string_agg(path || chr(0) || CAST(size AS VARCHAR) || chr(10), '' ORDER BY path, size)) AS digest,
  count(*) AS n_files FROM files GROUP BY 1""")
def _(spark, sf_dir):
    return a.manifest_fingerprint(require_columns(b.files(spark, sf_dir), {"group_id", "path", "size"}, "files"))


@query("a4_size_hash", f"""WITH {b.FILES}, h AS (SELECT group_id, path, size, lpad(hex(size), 16, '0') AS x FROM files),
le AS (SELECT *, substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2)
  || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS le FROM h)
SELECT group_id, upper(md5(unhex(string_agg(le, '' ORDER BY path, size)))) AS digest, count(*) AS n_files
FROM le GROUP BY 1""")
def _(spark, sf_dir):
    return a.size_hash(b.files(spark, sf_dir))


@query("a5_content_hash", """
SELECT source, md5(string_agg(text, '' ORDER BY doc_id)) AS digest, count(*) AS n_files
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _(spark, sf_dir):
    return a.content_hash(b.table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("a6_mode_first", f"""WITH {b.TICKS}, c AS (SELECT stream_id, kind, count(*) AS n, min(seq) AS f FROM ticks GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, f) AS r FROM c)
SELECT stream_id, kind, n FROM r WHERE r = 1""")
def _(spark, sf_dir):
    return a.mode_first(b.ticks(spark, sf_dir), "stream_id", "kind", "seq")


@query("a7_median_step", f"""WITH {b.TICKS}, d AS (SELECT DISTINCT stream_id, pts FROM ticks),
s AS (SELECT stream_id, lead(pts) OVER (PARTITION BY stream_id ORDER BY pts) - pts AS step FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS n
  FROM s WHERE step IS NOT NULL)
SELECT t.stream_id, coalesce(max(step) FILTER (WHERE i = n // 2), 0) AS median_step
FROM (SELECT DISTINCT stream_id FROM ticks) t LEFT JOIN r ON t.stream_id = r.stream_id GROUP BY 1""")
def _(spark, sf_dir):
    return a.median_step(b.ticks(spark, sf_dir))


@query("a8_true_median", f"""WITH {b.TICKS} SELECT stream_id, median(pts) AS median, count(*) AS n FROM ticks GROUP BY 1""")
def _(spark, sf_dir):
    return a.exact_median(b.ticks(spark, sf_dir), ["stream_id"], "pts", interpolate=True)


@query("a9_argmax", f"""WITH {b.TITLES}, r AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY duration DESC, priority DESC, title_idx) AS r
  FROM titles) SELECT disc_id, title_idx, title_id, duration FROM r WHERE r = 1""")
def _(spark, sf_dir):
    return a.argmax(
        b.titles(spark, sf_dir), "disc_id", [F.col("duration"), F.col("priority")], "title_idx", ["title_id", "duration"]
    )


@query("a10_choose_chain", f"""WITH {b.TITLES}, l AS (SELECT *, priority - 1 AS n_cells,
  CASE WHEN disc_id % 3 = 0 THEN 2 END AS explicit, status = 'P' AS designated FROM titles),
v AS (SELECT *, CASE WHEN explicit IS NOT NULL THEN CASE WHEN title_idx = explicit THEN 0 END
  WHEN designated AND n_cells > 0 THEN 1 WHEN duration > 0 OR n_cells > 0 THEN 2 END AS level FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY level, CASE WHEN level = 2 THEN -duration END,
  CASE WHEN level = 2 THEN -n_cells END, title_idx) AS r FROM v WHERE level IS NOT NULL)
SELECT disc_id, title_idx, duration, n_cells, level FROM r WHERE r = 1""")
def _(spark, sf_dir):
    chains = b.titles(spark, sf_dir).withColumn("n_cells", F.col("priority") - 1)
    explicit = F.when(F.col("disc_id") % 3 == 0, 2)
    return a.choose_chain(chains, "disc_id", explicit, F.col("status") == "P", "title_idx")


@query("a11_sum_by", f"""WITH {b.CELLS} SELECT chain_id, vob_id, cell_id, sum(duration) AS duration FROM cells GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return a.sum_by(b.cells(spark, sf_dir), ["chain_id", "vob_id", "cell_id"], "duration")


_DISC_ITEMS = "di AS (SELECT disc_id, title_idx, i.* FROM items i JOIN titles USING (title_id))"


def disc_items(spark, sf_dir, clips=10):
    titles = b.titles(spark, sf_dir).select("disc_id", "title_id", "title_idx")
    return b.items(spark, sf_dir, clips).join(titles, "title_id")


@query("a12_shared_fraction", f"""WITH {b.ITEMS}, {b.TITLES}, {_DISC_ITEMS},
base AS (SELECT disc_id, clip_id, sum(duration) AS m FROM di WHERE title_idx = 0 GROUP BY 1, 2),
tot AS (SELECT disc_id, sum(m) AS total FROM base GROUP BY 1),
oth AS (SELECT DISTINCT disc_id, title_id, clip_id FROM di WHERE title_idx > 0),
sh AS (SELECT o.disc_id, o.title_id, sum(m) AS shared FROM oth o JOIN base USING (disc_id, clip_id) GROUP BY 1, 2)
SELECT o.disc_id, o.title_id, coalesce(shared, 0.0) / total AS share
FROM (SELECT DISTINCT disc_id, title_id FROM oth) o JOIN tot USING (disc_id) LEFT JOIN sh USING (disc_id, title_id)""")
def _(spark, sf_dir):
    rows = disc_items(spark, sf_dir)
    first = F.col("title_idx") == 0
    return a.shared_fraction(rows.filter(first), rows.filter(~first), "disc_id", "title_id", "clip_id", "duration")


@query("a13_scan_vote", f"""WITH {b.TICKS}, f AS (SELECT stream_id, kind <> 'signup' AS interlaced,
  CASE WHEN k % 3 = 0 THEN NULL ELSE stream_id % 2 = 0 OR k = 1 END AS tff FROM ticks),
c AS (SELECT stream_id, count(*) AS n, count(*) FILTER (WHERE interlaced) AS n_interlaced,
  count(*) FILTER (WHERE interlaced AND tff) AS t, count(*) FILTER (WHERE interlaced AND NOT tff) AS b FROM f GROUP BY 1)
SELECT stream_id, n, n_interlaced, CASE WHEN n < 24 THEN NULL WHEN n_interlaced = 0 THEN 'progressive'
  WHEN n_interlaced < 0.7 * n THEN NULL WHEN t > 0 AND b = 0 THEN 'tff' WHEN b > 0 AND t = 0 THEN 'bff' END AS scan FROM c""")
def _(spark, sf_dir):
    frames = b.ticks(spark, sf_dir).select(
        "stream_id",
        (F.col("kind") != "signup").alias("interlaced"),
        F.when(F.col("k") % 3 != 0, (F.col("stream_id") % 2 == 0) | (F.col("k") == 1)).alias("top_field_first"),
    )
    return a.scan_vote(frames, min_share=0.7)


_CHEAPEST = """m AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY duration, title_idx) <= 3 AS member FROM titles)"""


def with_members(spark, sf_dir):
    """Titles with ``member``: the three shortest of each disc."""
    ranked = o.ordered(b.titles(spark, sf_dir), "disc_id", ["duration", "title_idx"], _rn=o.row_number())
    return ranked.withColumn("member", F.col("_rn") <= 3).drop("_rn")


@query("a14_sum_member", f"""WITH {b.TITLES}, {_CHEAPEST},
t AS (SELECT disc_id, sum(duration) AS total FROM m WHERE member GROUP BY 1),
r AS (SELECT m.disc_id, title_idx, duration, total, row_number() OVER (PARTITION BY m.disc_id ORDER BY title_idx) AS r
  FROM m JOIN t USING (disc_id) WHERE NOT member AND total > 0 AND duration >= 60 AND abs(duration - total) <= 0.05 * total)
SELECT disc_id, title_idx, duration, total FROM r WHERE r = 1""")
def _(spark, sf_dir):
    return a.find_sum_member(
        with_members(spark, sf_dir), "disc_id", F.col("member"), "duration", "title_idx", minimum=60
    )


@query("a15_dwarfed", f"""WITH {b.TITLES}, {_CHEAPEST},
g AS (SELECT disc_id, max(duration) FILTER (WHERE member) AS longest,
  max(duration) FILTER (WHERE NOT member AND status <> 'P') AS rival FROM m GROUP BY 1)
SELECT *, coalesce(rival >= 3 * longest, false) AS dwarfed FROM g""")
def _(spark, sf_dir):
    return a.dwarfed(
        with_members(spark, sf_dir), "disc_id", F.col("member"), "duration", exempt=F.col("status") == "P"
    )


@query("a16_group_counts", f"""WITH {b.TITLES}
SELECT disc_id, priority, count(*) AS n FROM titles WHERE status <> 'P' AND duration >= 1200 GROUP BY 1, 2""")
def _(spark, sf_dir):
    listed = (F.col("status") != "P") & (F.col("duration") >= 1200)
    return a.group_counts(b.titles(spark, sf_dir), ["disc_id", "priority"], listed)


@query("a17_outcomes", """SELECT event_type, count(*) FILTER (WHERE value < 100) AS n_ok,
  count(*) FILTER (WHERE NOT value < 100) AS n_failed FROM events GROUP BY 1""")
def _(spark, sf_dir):
    return a.outcomes(b.table(spark, sf_dir, "events"), "event_type", F.col("value") < 100)


@query("a19_any_after_first", f"""WITH {b.ITEMS}
SELECT title_id, bool_or(clip_id IN (5, 6) AND pos > 0) AS seamless FROM items GROUP BY 1""")
def _(spark, sf_dir):
    return a.any_after_first(b.items(spark, sf_dir), "title_id", F.col("clip_id").isin(5, 6))


@query("a20_unambiguous_ids", f"""WITH {b.STREAMS}, g AS (
SELECT title_id, count(*) AS n, count(pid) AS k, count(DISTINCT pid) AS d,
  array_to_string(list_sort(list(DISTINCT pid)), ',') AS ids FROM streams WHERE type = 'audio' GROUP BY 1)
SELECT title_id, CASE WHEN k = n AND d = n THEN ids END AS ids FROM g""")
def _(spark, sf_dir):
    audio = b.streams(spark, sf_dir).filter(F.col("type") == "audio")
    return a.unambiguous_ids(audio, "title_id", "pid", F.col("pid").isNotNull())


@query("a21_envelope", f"""WITH {b.CELLS},
c AS (SELECT chain_id, pos, CASE WHEN cell_id = 0 THEN 0 ELSE first_sector END AS f,
  CASE WHEN cell_id = 0 OR chain_id % 3 = 0 THEN 0 ELSE last_sector END AS l FROM cells),
bd AS (SELECT DISTINCT chain_id, first_sector + 7 AS sector FROM cells WHERE chain_id % 2 = 0),
n AS (SELECT *, lead(sector) OVER (PARTITION BY chain_id ORDER BY sector) AS nx FROM bd),
g AS (SELECT chain_id, min(f) FILTER (WHERE NOT (f = 0 AND l = 0)) AS s, arg_min(f = 0 AND l = 0, pos) AS z0,
  max(l) FILTER (WHERE l > 0) AS e, arg_max(f, pos) FILTER (WHERE f > 0) AS lf FROM c GROUP BY 1),
u AS (SELECT g.chain_id, min(nx) - 1 AS ue FROM g JOIN n ON n.chain_id = g.chain_id AND sector >= lf AND nx IS NOT NULL
  WHERE e IS NULL GROUP BY 1),
r AS (SELECT g.chain_id, CASE WHEN z0 THEN 0 ELSE s END AS start_sector,
  coalesce(e, ue, CASE WHEN lf IS NOT NULL THEN least(lf + 3000, 400000000 // 2048) END) AS end_sector
  FROM g LEFT JOIN u USING (chain_id))
SELECT chain_id, start_sector, end_sector, start_sector * 2048 AS start_byte,
  least((end_sector + 1) * 2048, 400000000) AS end_byte
FROM r WHERE end_sector > start_sector AND least((end_sector + 1) * 2048, 400000000) > start_sector * 2048""")
def _(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    bounds = cells.filter(F.col("chain_id") % 2 == 0).select("chain_id", (F.col("first_sector") + 7).alias("sector"))
    blank, no_end = F.col("cell_id") == 0, F.col("chain_id") % 3 == 0
    cells = cells.withColumns(
        {
            "first_sector": F.when(blank, 0).otherwise(F.col("first_sector")),
            "last_sector": F.when(blank | no_end, 0).otherwise(F.col("last_sector")),
        }
    )
    return a.envelope(cells, bounds.distinct(), F.lit(400_000_000), span=3000)


@query("a22_rebaseline", f"""WITH {b.TICKS}
SELECT stream_id, seq, pts - first_value(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS rel FROM ticks""")
def _(spark, sf_dir):
    return a.rebaseline(b.ticks(spark, sf_dir)).select("stream_id", "seq", "rel")
