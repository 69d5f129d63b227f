"""Registered timeline and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.registry import query
from discframe.bindings.sequence import item_marks
from discframe.functions import text as x
from discframe.operators import ordered as o
from discframe.operators import project as p
from discframe.operators import rank as r
from discframe.operators import sequence as s
from discframe.operators import timeline as t

_PRE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("i1_rebase", f"""WITH RECURSIVE {b.TICKS},
f AS (SELECT stream_id, seq, pts, CAST(0 AS BIGINT) AS off, pts AS latest, pts AS effective FROM ticks WHERE seq = 0
  UNION ALL
  SELECT t.stream_id, t.seq, t.pts, CASE WHEN t.pts + f.off < f.latest - 10000 THEN f.latest - t.pts ELSE f.off END,
    CASE WHEN t.pts + f.off < f.latest - 10000 THEN f.latest ELSE greatest(f.latest, t.pts + f.off) END,
    CASE WHEN t.pts + f.off < f.latest - 10000 THEN f.latest ELSE t.pts + f.off END
  FROM f JOIN ticks t ON t.stream_id = f.stream_id AND t.seq = f.seq + 1)
SELECT stream_id, seq, effective FROM f""")
def _(spark, sf_dir):
    return t.rebase(b.ticks(spark, sf_dir), tolerance=10_000).select("stream_id", "seq", "effective")


@query("i2_splice", f"""WITH {b.ITEMS}, u AS (SELECT title_id AS stream_id, pos AS seq, part_id AS start, part_id + CAST(duration AS BIGINT) - 8 AS "end" FROM items),
v AS (SELECT *, "end" - start AS len FROM u WHERE "end" > start)
SELECT stream_id, seq, start, "end", CAST(first_value(start) OVER w + coalesce(sum(len) OVER (PARTITION BY stream_id ORDER BY seq {_PRE}), 0) - start AS BIGINT) AS "offset"
FROM v WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""")
def _(spark, sf_dir):
    units = b.items(spark, sf_dir).select(
        F.col("title_id").alias("stream_id"),
        F.col("pos").alias("seq"),
        F.col("part_id").alias("start"),
        (F.col("part_id") + F.col("duration").cast("long") - 8).alias("end"),
    )
    return t.splice(units)


@query("i3_content_range", f"""WITH {b.TICKS},
d AS (SELECT *, CASE WHEN pts < lag(pts) OVER w - 10000 THEN 1 ELSE 0 END AS st FROM ticks WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
g AS (SELECT *, sum(st) OVER (PARTITION BY stream_id ORDER BY seq) AS sg FROM d),
sgs AS (SELECT stream_id, sg, min(seq) AS fr, arg_max(pts, seq) - arg_min(pts, seq) AS span, bool_and(stream_id % 3 <> 0) AS ok FROM g GROUP BY 1, 2),
z AS (SELECT *, max(span) OVER w AS longest, CAST(sum(span) OVER w AS BIGINT) AS total, max(sg) OVER w AS last FROM sgs WINDOW w AS (PARTITION BY stream_id)),
e AS (SELECT *, min(CASE WHEN span > longest * 0.4 THEN sg END) OVER w AS lo,
  CASE WHEN bool_and(ok) OVER w THEN max(CASE WHEN span > longest * 0.4 THEN sg END) OVER w ELSE last END AS hi FROM z WINDOW w AS (PARTITION BY stream_id)),
a AS (SELECT stream_id, count(*) AS segments, min(fr) FILTER (WHERE sg BETWEEN lo AND hi) AS start_seq, min(fr) FILTER (WHERE sg > hi) AS end_seq,
  CAST(sum(span) FILTER (WHERE sg BETWEEN lo AND hi) AS BIGINT) AS kept, max(total) AS total, min(lo) AS lo FROM e GROUP BY 1)
SELECT stream_id, segments, start_seq, end_seq, kept, total FROM a WHERE total > 0 AND (lo > 0 OR end_seq IS NOT NULL) AND kept >= total * 0.5""")
def _(spark, sf_dir):
    return t.content_range(b.ticks(spark, sf_dir), F.col("stream_id") % 3 != 0, tolerance=10_000)


_TAILS = """SELECT *, row_number() OVER (PARTITION BY track ORDER BY clip) AS i FROM (
  SELECT stream_id AS track, CAST(seq // 8 AS BIGINT) AS clip, CAST(max(fr) + 2880 - sum(pts % 7) * 100 AS BIGINT) AS ve, 2880 AS frame,
    list(CAST(fr AS BIGINT) ORDER BY fr) AS ends, list(CAST(seq AS BIGINT) ORDER BY fr) AS offs
  FROM (SELECT *, seq % 8 * 2880 + pts % 40 AS fr FROM ticks) GROUP BY 1, 2)
  QUALIFY clip < max(clip) OVER (PARTITION BY track)"""


@query("i4_seamless_trim", f"""WITH RECURSIVE {b.TICKS}, {b.drift_sql(_TAILS)}
SELECT track, clip, drift, cut_offset, dropped, dead AS failed FROM kept WHERE i > 0""")
def _(spark, sf_dir):
    clip = F.floor(F.col("seq") / 8)
    ticks = b.ticks(spark, sf_dir).withColumns({"clip": clip, "at": F.col("seq") % 8 * 2880 + F.col("pts") % 40})
    # Eight frames per clip: the arrays are bounded by construction.
    tails = ticks.groupBy(F.col("stream_id").alias("track"), "clip").agg(
        (F.max("at") + 2880 - F.sum(F.col("pts") % 7) * 100).alias("video_end"),
        F.lit(2880).cast("long").alias("frame"),
        F.collect_list("at").alias("pts"),
        F.collect_list(F.col("seq").cast("long")).alias("offsets"),
    )
    done = t.seamless_trim(tails)
    return done.select("track", "clip", "drift", "cut_offset", "dropped", "failed")


_CLIPS = f"""cl AS (SELECT title_id, pos, duration, coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos {_PRE}), 0) AS p_start,
  NOT (part_id % 6 = 0 AND pos > 0) AS kept FROM items),
ap AS (SELECT *, CASE WHEN kept THEN p_start + pos * 0.5 END AS ms, sum(duration) OVER (PARTITION BY title_id) + 10 AS total_end FROM cl),
bo AS (SELECT *, coalesce(min(ms) OVER (PARTITION BY title_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), total_end) AS nx FROM ap),
bounds AS (SELECT title_id, pos, duration, p_start, CASE WHEN kept THEN ms ELSE nx END AS real_start, nx AS real_end FROM bo)"""


def measured_clips(spark, sf_dir):
    """Planned clips with measured bounds: half a second of drift per clip, some dropped."""
    clips = s.with_offsets(b.items(spark, sf_dir), "title_id", "pos", "duration", "p_start")
    kept = ~((F.col("part_id") % 6 == 0) & (F.col("pos") > 0))
    sized = o.with_group(clips, "title_id", _total=F.sum("duration"))
    placed = sized.withColumns(
        {"kept": kept, "start": F.when(kept, F.col("p_start") + F.col("pos") * 0.5), "total_end": F.col("_total") + 10}
    )
    return t.append_bounds(placed, "kept").select("title_id", "pos", "duration", "p_start", "real_start", "real_end")


@query("i5_append_bounds", f"""WITH {b.ITEMS}, {_CLIPS} SELECT title_id, pos, real_start, real_end FROM bounds""")
def _(spark, sf_dir):
    return measured_clips(spark, sf_dir).select("title_id", "pos", "real_start", "real_end")


def planned_atoms(spark, sf_dir):
    """Two atoms per clip, the second one hidden on odd positions."""
    clips = s.with_offsets(b.items(spark, sf_dir), "title_id", "pos", "duration", "p_start")
    half = F.array(F.lit(0), F.lit(1))
    rows = clips.withColumn("h", F.explode(half))
    length = F.col("duration") / 2
    return rows.select(
        "title_id",
        F.lit(1).alias("edition"),
        (F.col("pos") * 2 + F.col("h")).alias("atom_idx"),
        (F.col("p_start") + F.col("h") * length).alias("start"),
        (F.col("p_start") + (F.col("h") + 1) * length).alias("end"),
        ((F.col("pos") + F.col("h")) % 2 == 1).alias("hidden"),
        F.concat(F.lit("Chapter "), (F.col("pos") * 2 + F.col("h")).cast("string")).alias("name"),
    )


_ATOMS = f"""at0 AS (SELECT title_id, pos, duration, coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos {_PRE}), 0) AS ps FROM items),
atoms AS (SELECT title_id, 1 AS edition, pos, CAST(pos * 2 + h AS INTEGER) AS atom_idx, ps + h * (duration / 2) AS "start", ps + (h + 1) * (duration / 2) AS "end",
  (pos + h) % 2 = 1 AS hidden, 'Chapter ' || (pos * 2 + h) AS name FROM at0, (VALUES (0), (1)) v(h))"""


@query("i5_retime", f"""WITH {b.ITEMS}, {_CLIPS}, {_ATOMS},
m AS (SELECT a.*, real_start + least(greatest(a."start" - p_start, 0.0), real_end - real_start) AS s,
  CASE WHEN a."end" >= p_start + duration - 0.000001 THEN real_end ELSE real_start + least(a."end" - p_start, real_end - real_start) END AS e
  FROM atoms a JOIN bounds b ON b.title_id = a.title_id AND b.pos = a.pos),
k AS (SELECT *, e - s > 0.000001 AS kept FROM m),
rn AS (SELECT *, coalesce(sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY title_id ORDER BY atom_idx {_PRE}), 0) AS run FROM k),
nm AS (SELECT title_id, run, arg_min(name, atom_idx) AS pending FROM rn WHERE NOT kept AND NOT hidden GROUP BY 1, 2)
SELECT r.title_id, edition, atom_idx, s AS "start", e AS "end", hidden AND pending IS NULL AS hidden,
  CASE WHEN hidden AND pending IS NOT NULL THEN pending ELSE name END AS name
FROM rn r LEFT JOIN nm ON nm.title_id = r.title_id AND nm.run = r.run WHERE kept""")
def _(spark, sf_dir):
    return t.retime(planned_atoms(spark, sf_dir), measured_clips(spark, sf_dir))


@query("i6_pull_back", f"""WITH {b.ITEMS}, {_ATOMS}, a2 AS (SELECT title_id, edition, atom_idx, "start" + CASE WHEN atom_idx % 3 = 2 THEN 4 ELSE 0 END AS st, "end" + CASE WHEN atom_idx % 3 = 2 THEN 4 ELSE 0 END AS en FROM atoms),
n AS (SELECT *, lead(st) OVER (PARTITION BY title_id, edition ORDER BY atom_idx) AS nx FROM a2)
SELECT title_id, atom_idx, round(CASE WHEN NOT coalesce(abs(nx - en) <= 0.000001, false) AND NOT (nx IS NULL AND en >= 100 - 0.000001) AND en - st > 0.002 THEN en - 0.001 ELSE en END, 6) AS "end" FROM n""")
def _(spark, sf_dir):
    shift = F.when(F.col("atom_idx") % 3 == 2, 4).otherwise(0)
    atoms = planned_atoms(spark, sf_dir).withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift})
    done = t.pull_back(atoms, F.lit(100.0), ["title_id", "edition"])
    return done.select("title_id", "atom_idx", F.round("end", 6).alias("end"))


_TRIM = f"""it AS (SELECT title_id, pos, CAST(part_id % 9 AS DOUBLE) AS ss, part_id % 9 + duration AS se, part_id % 9 + duration + part_id % 2 * 10 AS sl,
  part_id % 8 = 0 AND pos > 0 AS dropped FROM items),
ck AS (SELECT *, coalesce(sum(se - ss) OVER w, 0) AS tt, coalesce(sum(CASE WHEN dropped THEN 0 ELSE sl END) OVER w, 0) AS app
  FROM it WINDOW w AS (PARTITION BY title_id ORDER BY pos {_PRE})),
pa AS (SELECT *, greatest(12, tt) AS b, least(90, tt + se - ss) AS e FROM ck WHERE NOT dropped AND least(90, tt + se - ss) > greatest(12, tt)),
pl AS (SELECT *, coalesce(sum(e - b) OVER (PARTITION BY title_id ORDER BY pos {_PRE}), 0) AS os, app + ss - tt + b AS a1, app + ss - tt + e AS a2 FROM pa)"""


def _trim(spark, sf_dir):
    items = b.items(spark, sf_dir)
    start = (F.col("part_id") % 9).cast("double")
    spans = items.select(
        "title_id",
        "pos",
        start.alias("span_start"),
        (start + F.col("duration")).alias("span_end"),
        (start + F.col("duration") + F.col("part_id") % 2 * 10).alias("span_length"),
        ((F.col("part_id") % 8 == 0) & (F.col("pos") > 0)).alias("dropped"),
    )
    windows = items.select("title_id").distinct().withColumns({"win_start": F.lit(12.0), "win_end": F.lit(90.0)})
    marks = item_marks(spark, sf_dir).select("title_id", "mark_idx", "t")
    return t.trim_plan(spans, windows, marks)


@query("i7_trim_ranges", f"""WITH {b.ITEMS}, {_TRIM},
g AS (SELECT *, CASE WHEN abs(lag(a2) OVER w - a1) < 0.000001 THEN 0 ELSE 1 END AS st FROM pl WINDOW w AS (PARTITION BY title_id ORDER BY pos)),
i AS (SELECT *, sum(st) OVER (PARTITION BY title_id ORDER BY pos) AS rn FROM g)
SELECT title_id, CAST(rn AS BIGINT) AS range_no, min(a1) AS "start", max(a2) AS "end" FROM i GROUP BY 1, 2""")
def _(spark, sf_dir):
    return _trim(spark, sf_dir)[0]


@query("i7_trim_chapters", f"""WITH {b.ITEMS}, {_TRIM},
mk AS (SELECT title_id, pos AS mark_idx, coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos {_PRE}), 0) AS t FROM items),
c AS (SELECT m.title_id, mark_idx, os + t - b AS t FROM mk m JOIN pl ON pl.title_id = m.title_id AND b <= t AND t < e),
o AS (SELECT title_id, max(os + e - b) AS output FROM pl GROUP BY 1)
SELECT c.title_id, mark_idx, t FROM (SELECT *, max(mark_idx) OVER (PARTITION BY title_id) AS last FROM c) c JOIN o USING (title_id)
WHERE NOT (mark_idx = last AND t >= output - 0.5)""")
def _(spark, sf_dir):
    return _trim(spark, sf_dir)[1].select("title_id", "mark_idx", "t")


_CLOSE = f"""it AS (SELECT title_id, pos, coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos {_PRE}), 0) AS bg,
  sum(duration) OVER (PARTITION BY title_id ORDER BY pos) AS en, part_id % 3 <> 0 AS kept, clip_id % 2 = 0 AS sm FROM items),
pl AS (SELECT *, coalesce(sum(CASE WHEN kept THEN en - bg ELSE 0 END) OVER (PARTITION BY title_id ORDER BY pos {_PRE}), 0) AS nb,
  lag(kept) OVER (PARTITION BY title_id ORDER BY pos) AS pk FROM it)"""


def _close(spark, sf_dir):
    items = b.items(spark, sf_dir)
    placed = s.with_offsets(items, "title_id", "pos", "duration", "begin").select(
        "title_id",
        "pos",
        "begin",
        (F.col("begin") + F.col("duration")).alias("end"),
        (F.col("part_id") % 3 != 0).alias("kept"),
        (F.col("clip_id") % 2 == 0).alias("seamless"),
    )
    marks = s.with_offsets(items, "title_id", "pos", "duration", "t").select(
        "title_id", (F.floor(F.col("t") / 7) * 7.0).alias("t")
    )
    return t.close_up(placed, marks)


@query("i8_close_up_clips", f"""WITH {b.ITEMS}, {_CLOSE}
SELECT title_id, pos, nb AS new_begin, sm AND coalesce(pk, false) AS seamless FROM pl WHERE kept""")
def _(spark, sf_dir):
    return _close(spark, sf_dir)[0].select("title_id", "pos", "new_begin", "seamless")


@query("i8_close_up_chapters", f"""WITH {b.ITEMS}, {_CLOSE}, mk AS (SELECT title_id, floor(bg / 7) * 7 AS t FROM it)
SELECT DISTINCT p.title_id, nb + t - bg AS t FROM mk m JOIN pl p ON p.title_id = m.title_id AND bg <= t AND t < en WHERE kept""")
def _(spark, sf_dir):
    return _close(spark, sf_dir)[1]


@query("i9_align_series", f"""WITH {b.TICKS}, q AS (SELECT stream_id, pts + 300 + (k % 4) * 9 AS l, pts AS r FROM ticks WHERE NOT (stream_id % 4 = 0 AND seq = 0)
  ), xl AS (SELECT stream_id, l, row_number() OVER (PARTITION BY stream_id ORDER BY l) AS i FROM q),
xr AS (SELECT stream_id, pts AS r, row_number() OVER (PARTITION BY stream_id ORDER BY pts) AS i FROM ticks),
pr AS (SELECT coalesce(xl.stream_id, xr.stream_id) AS stream_id, l, r, l - r AS d FROM xl FULL JOIN xr ON xl.stream_id = xr.stream_id AND xl.i = xr.i),
md AS (SELECT stream_id, d, row_number() OVER (PARTITION BY stream_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS c FROM pr WHERE d IS NOT NULL),
m AS (SELECT stream_id, d AS "offset" FROM md WHERE i = c // 2),
a AS (SELECT p.stream_id, "offset", count(*) AS n, bool_and(l IS NOT NULL AND r IS NOT NULL) AS ev, count(*) FILTER (WHERE abs(d - "offset") <= 20) AS agreeing, min(l) AS anchor
  FROM pr p JOIN m USING (stream_id) GROUP BY 1, 2)
SELECT stream_id, "offset", n, agreeing, anchor, ev AND agreeing >= n * 0.8 AND abs("offset" - anchor) <= 500 AS aligned FROM a""")
def _(spark, sf_dir):
    ticks = b.ticks(spark, sf_dir)
    left = ticks.filter(~((F.col("stream_id") % 4 == 0) & (F.col("seq") == 0))).select(
        "stream_id", (F.col("pts") + 300 + F.col("k") % 4 * 9).alias("pts")
    )
    return t.align_series(left, ticks, "stream_id", "pts")


@query("i10_interleave", """WITH f AS (SELECT p_partkey, p_partkey * 3 AS extent, CAST(p_size * 1500 AS BIGINT) AS size, p_partkey % 4 AS unit, p_partkey % 3 AS gap FROM part),
r AS (SELECT *, CASE WHEN unit > 0 THEN (size + unit * 2048 - 1) // (unit * 2048) ELSE 1 END AS n FROM f)
SELECT p_partkey, g.run, (extent + g.run * (unit + gap)) * 2048 AS "offset",
  CASE WHEN unit > 0 THEN least(unit * 2048, size - g.run * unit * 2048) ELSE size END AS length
FROM r, generate_series(0, 60) g(run) WHERE g.run < n AND (unit = 0 OR size > 0)""")
def _(spark, sf_dir):
    files = b.table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_partkey") * 3).alias("extent"),
        (F.col("p_size") * 1500).cast("long").alias("size"),
        (F.col("p_partkey") % 4).alias("unit"),
        (F.col("p_partkey") % 3).alias("gap"),
    )
    return t.interleave(files, "extent", "size", "unit", "gap").select("p_partkey", "run", "offset", "length")


@query("i11_frame_times", f"""WITH {b.TICKS}, g AS (SELECT stream_id, seq, CASE WHEN kind = 'error' THEN 0 ELSE pts + 90000 END AS p, k % 3 AS lead_n, 1 + k % 4 AS n FROM ticks)
SELECT stream_id, seq, CAST(f AS INTEGER) AS frame, CASE WHEN p <> 0 THEN p - lead_n * 3003 + f * 3003 ELSE 0 END AS frame_pts
FROM g, generate_series(0, 3) v(f) WHERE f < n""")
def _(spark, sf_dir):
    groups = b.ticks(spark, sf_dir).select(
        "stream_id",
        "seq",
        F.when(F.col("kind") == "error", 0).otherwise(F.col("pts") + 90_000).alias("p"),
        (F.col("k") % 3).alias("leading"),
        (1 + F.col("k") % 4).cast("int").alias("n"),
    )
    done = t.frame_times(groups, "p", "leading", F.sequence(F.lit(0), F.col("n") - 1))
    return done.select("stream_id", "seq", "frame", "frame_pts")


@query("f19_clip_spans", f"""WITH {b.ITEMS}, sp AS (SELECT title_id, pos, (part_id % 3) * 4500 AS cs, CASE WHEN part_id % 40 <> 0 THEN (part_id % 3) * 4500 + 45000 * CAST(duration AS BIGINT) END AS ce,
  (part_id % 3) * 4500 + CASE WHEN size % 4 = 0 THEN 9000 ELSE 0 END AS it, (part_id % 3) * 4500 + 45000 * CAST(duration AS BIGINT) - CASE WHEN size % 5 = 0 THEN 18000 ELSE 0 END AS ot FROM items),
v AS (SELECT *, (it - cs) / 45000.0 AS s, (ot - cs) / 45000.0 AS e, (ce - cs) / 45000.0 AS l FROM sp),
j AS (SELECT *, bool_and(coalesce(s >= 0 AND e <= l + 0.05 AND e > s, false)) OVER w AS ok, bool_or(coalesce(s > 0.05 OR e < l - 0.05, false)) OVER w AS part FROM v WINDOW w AS (PARTITION BY title_id))
SELECT title_id, pos, s AS "start", least(e, l) AS "end", l AS length FROM j WHERE ok AND part""")
def _(spark, sf_dir):
    lead = F.col("part_id") % 3 * 4500
    whole = lead + 45_000 * F.col("duration").cast("long")
    items = b.items(spark, sf_dir).withColumns(
        {
            "clip_start": lead,
            "clip_end": F.when(F.col("part_id") % 40 != 0, whole),
            "in_ts": lead + F.when(F.col("size") % 4 == 0, 9000).otherwise(0),
            "out_ts": whole - F.when(F.col("size") % 5 == 0, 18_000).otherwise(0),
        }
    )
    return t.clip_spans(items).select("title_id", "pos", "start", "end", "length")


_NOTABLE = b.NOTABLE_SQL.format(minimum=1200, plain=3000)


def ranked_titles(spark, sf_dir):
    """Titles with everything the main-feature score reads."""
    facts = p.title_facts(b.titles(spark, sf_dir), b.streams(spark, sf_dir), b.items(spark, sf_dir), share=0.5)
    return facts.withColumns(
        {
            "remote_main": (F.col("status") == "P") & (F.col("title_id") % 50 == 0),
            "authorial": F.col("title_id") % 97 == 0,
            "default_edition": F.col("priority") != 3,
            "n_chapters": F.col("n_items"),
            "playlist_no": F.when(F.col("priority") < 5, F.col("title_id") % 100),
            "notable": p.notable_flag(minimum=1200, plain=3000),
        }
    )


@query("t1_main_feature", f"""WITH {b.CATALOG}, {b.facts_sql(0.5)},
s AS (SELECT *, {_NOTABLE} AS notable, status = 'P' AND title_id % 50 = 0 AS remote, title_id % 97 = 0 AS auth FROM facts),
r AS (SELECT disc_id, title_id, row_number() OVER (PARTITION BY disc_id ORDER BY NOT (notable OR remote), duration < 1500,
  CASE WHEN duration >= 1500 THEN -CAST(remote AS INTEGER) END, CASE WHEN duration >= 1500 THEN -CAST(auth AS INTEGER) END,
  CASE WHEN duration >= 1500 THEN -(n_audio + n_sub) END, CASE WHEN duration >= 1500 THEN -CAST(priority <> 3 AS INTEGER) END,
  CASE WHEN duration >= 1500 THEN -n_items END, CASE WHEN duration >= 1500 THEN CASE WHEN priority < 5 THEN title_id % 100 ELSE 0 END END,
  CASE WHEN duration >= 1500 THEN -duration END, title_idx) AS r FROM s)
SELECT disc_id, title_id FROM r WHERE r = 1""")
def _(spark, sf_dir):
    return r.main_feature(ranked_titles(spark, sf_dir), F.col("notable"), minimum=1500)


@query("t4_top_n", """WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT c_nationkey, c_custkey, c_acctbal FROM r WHERE r <= 5""")
def _(spark, sf_dir):
    customers = b.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return r.top_n(customers, "c_nationkey", [F.col("c_acctbal").desc(), "c_custkey"], 5)


@query("t5_version_gt", """WITH v AS (SELECT p_partkey, (p_partkey % 3) || '.' || (p_size % 12) || CASE WHEN p_partkey % 2 = 0 THEN '.' || p_partkey % 11 ELSE '' END || CASE WHEN p_partkey % 13 = 0 THEN 'b' ELSE '' END AS a, '1.' || p_partkey % 12 AS b FROM part),
k AS (SELECT *, list_transform(string_split(a, '.'), lambda x: TRY_CAST(x AS INTEGER)) AS ka, list_transform(string_split(b, '.'), lambda x: TRY_CAST(x AS INTEGER)) AS kb FROM v)
SELECT p_partkey, a, b, CASE WHEN list_contains(list_transform(ka, lambda x: x IS NULL), true) THEN false ELSE ka > kb END AS newer FROM k""")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    tail = F.when(key % 2 == 0, F.concat(F.lit("."), key % 11)).otherwise("")
    beta = F.when(key % 13 == 0, "b").otherwise("")
    versions = b.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat((key % 3).cast("string"), F.lit("."), (F.col("p_size") % 12).cast("string"), tail, beta).alias("a"),
        F.concat(F.lit("1."), key % 12).alias("b"),
    )
    return versions.withColumn("newer", x.version_gt(F.col("a"), F.col("b")))
