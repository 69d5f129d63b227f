"""Registered window, sequence and set-union queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.aggregate import disc_items
from discframe.bindings.registry import query
from discframe.operators import ordered as o
from discframe.operators import sequence as s

_ORDERED = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("w1_offsets", f"""WITH {b.ITEMS}
SELECT title_id, pos, duration, coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos {_ORDERED}), 0) AS "offset" FROM items""")
def _(spark, sf_dir):
    return s.with_offsets(b.items(spark, sf_dir), "title_id", "pos", "duration").select(
        "title_id", "pos", "duration", "offset"
    )


# Marks on the item's clip clock: 45 kHz, in_ts = 1000 * part % 7, one mark per item.
def _clip_marks(spark, sf_dir):
    items = b.items(spark, sf_dir).withColumn("in_ts", F.col("part_id") % 7 * 1000)
    marks = items.select(
        "title_id", F.col("pos").alias("item"), (F.col("in_ts") + (F.col("size") % 450_000)).alias("mark_time")
    )
    return marks, items


@query("w2_absolute_marks", f"""WITH RECURSIVE {b.ITEMS},
off AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos {_ORDERED}), 0) AS o FROM items),
m AS (SELECT title_id, o + (size % 450000) / 45000.0 AS t FROM off),
r AS (SELECT title_id, t, row_number() OVER (PARTITION BY title_id ORDER BY t) AS i FROM m),
f AS (SELECT title_id, i, t AS last, true AS kept, t FROM r WHERE i = 1
  UNION ALL
  SELECT r.title_id, r.i, CASE WHEN r.t - f.last >= 8 THEN r.t ELSE f.last END, r.t - f.last >= 8, r.t
  FROM f JOIN r ON r.title_id = f.title_id AND r.i = f.i + 1)
SELECT title_id, CAST(row_number() OVER w - 1 AS INTEGER) AS mark_idx, round(t - first_value(t) OVER w, 6) AS t
FROM f WHERE kept WINDOW w AS (PARTITION BY title_id ORDER BY t)""")
def _(spark, sf_dir):
    marks, items = _clip_marks(spark, sf_dir)
    return s.absolute_marks(marks, items, gap=8.0).select("title_id", "mark_idx", F.round("t", 6).alias("t"))


def item_marks(spark, sf_dir):
    """Title marks: the start of every item."""
    return s.with_offsets(b.items(spark, sf_dir), "title_id", "pos", "duration", "t").select(
        "title_id", F.col("pos").alias("mark_idx"), "t", "duration"
    )


@query("w3_strip_end_mark", f"""WITH {b.ITEMS},
m AS (SELECT title_id, pos AS mark_idx, coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos {_ORDERED}), 0) AS t,
  sum(duration) OVER (PARTITION BY title_id) AS total, max(pos) OVER (PARTITION BY title_id) AS last FROM items)
SELECT title_id, mark_idx, t FROM m WHERE NOT (mark_idx = last AND t >= total - 20)""")
def _(spark, sf_dir):
    marks = o.with_group(item_marks(spark, sf_dir), "title_id", total=F.sum("duration"))
    return s.strip_end_mark(marks, F.col("total") - 20).select("title_id", "mark_idx", "t")


_SPANS = """sp0 AS (SELECT *, clip_id % 2 AS clip, CAST(coalesce(sum(duration) OVER (PARTITION BY title_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + CASE WHEN part_id % 5 = 0 THEN 3 ELSE part_id % 2 END AS in_ts FROM items),
sp AS (SELECT *, in_ts + CAST(duration AS BIGINT) AS out_ts FROM sp0)"""


def spans(spark, sf_dir):
    """Items with a played range; some continue the item before, some do not."""
    start = F.col("offset").cast("long") + F.when(F.col("part_id") % 5 == 0, 3).otherwise(F.col("part_id") % 2)
    items = s.with_offsets(b.items(spark, sf_dir), "title_id", "pos", "duration")
    return items.withColumns({"clip": F.col("clip_id") % 2, "in_ts": start}).withColumn(
        "out_ts", F.col("in_ts") + F.col("duration").cast("long")
    )


@query("w5_merge_contiguous", f"""WITH {b.ITEMS}, {_SPANS},
g AS (SELECT *, CASE WHEN clip = lag(clip) OVER w AND abs(in_ts - lag(out_ts) OVER w) <= 1 THEN 0 ELSE 1 END AS st
  FROM sp WINDOW w AS (PARTITION BY title_id ORDER BY pos)),
i AS (SELECT *, sum(st) OVER (PARTITION BY title_id ORDER BY pos) AS run FROM g)
SELECT title_id, CAST(run AS BIGINT) AS run, min(pos) AS pos, arg_min(clip, pos) AS clip, arg_min(in_ts, pos) AS in_ts,
  arg_max(out_ts, pos) AS out_ts, sum(duration) AS duration, count(*) AS n_merged FROM i GROUP BY title_id, run""")
def _(spark, sf_dir):
    return s.merge_contiguous(spans(spark, sf_dir), ["clip"])


_EXTENTS = """ex AS (SELECT title_id AS file_id, pos AS seq, CASE WHEN clip_id % 4 = 3 THEN NULL ELSE in_ts END AS "offset",
  CASE WHEN clip_id = 0 THEN 0 ELSE CAST(duration AS BIGINT) END AS length FROM sp)"""


def _extents(spark, sf_dir):
    return spans(spark, sf_dir).select(
        F.col("title_id").alias("file_id"),
        F.col("pos").alias("seq"),
        F.when(F.col("clip_id") % 4 != 3, F.col("in_ts")).alias("offset"),
        F.when(F.col("clip_id") == 0, 0).otherwise(F.col("duration").cast("long")).alias("length"),
    )


@query("w6_merge_runs", f"""WITH {b.ITEMS}, {_SPANS}, {_EXTENTS},
g AS (SELECT *, CASE WHEN lag("offset") OVER w + lag(length) OVER w = "offset" THEN 0
  WHEN lag(length) OVER w IS NOT NULL AND lag("offset") OVER w IS NULL AND "offset" IS NULL THEN 0 ELSE 1 END AS st
  FROM ex WHERE length > 0 WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
i AS (SELECT *, sum(st) OVER (PARTITION BY file_id ORDER BY seq) AS run FROM g)
SELECT file_id, CAST(run AS BIGINT) AS run, min("offset") AS "offset", CAST(sum(length) AS BIGINT) AS length, count(*) AS n_merged FROM i GROUP BY 1, 2""")
def _(spark, sf_dir):
    return s.merge_runs(_extents(spark, sf_dir))


@query("w7_index_runs", f"""WITH {b.TICKS}, d AS (SELECT DISTINCT stream_id, k FROM ticks),
r AS (SELECT *, k - row_number() OVER (PARTITION BY stream_id ORDER BY k) AS i FROM d)
SELECT stream_id, min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY stream_id, i""")
def _(spark, sf_dir):
    return s.index_runs(b.ticks(spark, sf_dir), "stream_id", "k")


@query("w8_trim_to_total", f"""WITH {b.ITEMS}, {_SPANS}, {_EXTENTS},
r AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY seq {_ORDERED}), 0) AS BIGINT) AS before,
  sum(length) OVER (PARTITION BY file_id) AS have FROM ex)
SELECT file_id, seq, least(length, 90 - before) AS length, have < 90 AS short FROM r WHERE before < 90""")
def _(spark, sf_dir):
    return s.trim_to_total(_extents(spark, sf_dir), F.lit(90)).select("file_id", "seq", "length", "short")


@query("w9_backward_jumps", f"""WITH {b.CELLS}, p AS (SELECT *, lag(first_sector) OVER (PARTITION BY chain_id ORDER BY pos) AS prev FROM cells)
SELECT chain_id, count(*) FILTER (WHERE first_sector < prev) AS backward_jumps FROM p GROUP BY 1""")
def _(spark, sf_dir):
    return s.backward_jumps(b.cells(spark, sf_dir))


@query("w10_pick_from_block", f"""WITH {b.CELLS},
g AS (SELECT *, CASE WHEN block_mode <= 1 OR coalesce(lag(block_mode) OVER w IN (0, 3), true) THEN 1 ELSE 0 END AS st
  FROM cells WHERE NOT (first_sector = 0 AND last_sector = 0) WINDOW w AS (PARTITION BY chain_id ORDER BY pos)),
i AS (SELECT *, sum(st) OVER (PARTITION BY chain_id ORDER BY pos) AS blk FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY chain_id, blk ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chain_id, blk) AS n FROM i)
SELECT chain_id, pos, block_mode, duration FROM n WHERE block_mode = 0 OR i = CASE WHEN 1 < n THEN 1 ELSE 0 END""")
def _(spark, sf_dir):
    return s.pick_from_block(b.cells(spark, sf_dir), 1).select("chain_id", "pos", "block_mode", "duration")


@query("w11_program_chapters", f"""WITH {b.CELLS},
e AS (SELECT *, CASE WHEN pos % 2 = 1 THEN pos // 2 END AS program FROM cells),
f AS (SELECT *, last_value(program IGNORE NULLS) OVER (PARTITION BY chain_id ORDER BY pos) AS own FROM e),
p AS (SELECT chain_id, own AS program, sum(duration) AS duration, count(*) AS n_cells FROM f WHERE own IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY chain_id ORDER BY program {_ORDERED}), 0) AS start,
  max(CASE WHEN duration >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY chain_id ORDER BY program ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later,
  row_number() OVER (PARTITION BY chain_id ORDER BY program) AS rn FROM p)
SELECT chain_id, program, duration, n_cells, start FROM o WHERE later = 1 OR rn = 1""")
def _(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    programs = cells.filter(F.col("pos") % 2 == 1).select(
        "chain_id", F.floor(F.col("pos") / 2).alias("program"), F.col("pos").alias("entry")
    )
    return s.program_chapters(programs, cells, minimum=25)


_FIELDS = """fr AS (SELECT stream_id, seq, kind = 'error' AS interlaced, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 2 = 0 END AS tff,
  kind IN ('click', 'view') AS single FROM ticks)"""


@query("w12_pair_fields", f"""WITH {b.TICKS}, {_FIELDS},
g AS (SELECT *, CASE WHEN single AND lag(single) OVER w AND tff IS DISTINCT FROM lag(tff) OVER w THEN 0 ELSE 1 END AS st
  FROM fr WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
i AS (SELECT *, sum(st) OVER (PARTITION BY stream_id ORDER BY seq) AS run FROM g),
n AS (SELECT *, row_number() OVER w AS rn, lead(seq) OVER w AS nx FROM i WINDOW w AS (PARTITION BY stream_id, run ORDER BY seq))
SELECT stream_id, seq, interlaced OR (single AND nx IS NOT NULL) AS interlaced, tff AS top_field_first,
  single AND nx IS NULL AS single_field FROM n WHERE rn % 2 = 1""")
def _(spark, sf_dir):
    frames = b.ticks(spark, sf_dir).select(
        "stream_id",
        "seq",
        (F.col("kind") == "error").alias("interlaced"),
        F.when(F.col("k") % 5 != 0, F.col("k") % 2 == 0).alias("top_field_first"),
        F.col("kind").isin("click", "view").alias("single_field"),
    )
    return s.pair_fields(frames)


@query("w13_presentation_order", f"""WITH {b.TICKS},
h AS (SELECT *, kind <> 'click' AS held FROM ticks),
x AS (SELECT *, min(CASE WHEN held THEN seq END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nh FROM h)
SELECT stream_id, seq, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY CASE WHEN held THEN coalesce(nh, 1000000000) ELSE seq END) - 1 AS INTEGER) AS shown FROM x""")
def _(spark, sf_dir):
    frames = b.ticks(spark, sf_dir).withColumn("at_once", F.col("kind") == "click")
    return s.presentation_order(frames, "at_once").select("stream_id", "seq", "shown")


@query("w14_cadence_times", f"""WITH {b.TICKS},
f AS (SELECT stream_id, seq, CASE WHEN kind = 'purchase' THEN pts END AS p, 1 + k % 2 AS fields FROM ticks),
z AS (SELECT *, first_value(p IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f0,
  CAST(coalesce(sum(fields) OVER (PARTITION BY stream_id ORDER BY seq {_ORDERED}), 0) AS BIGINT) AS s FROM f),
m AS (SELECT *, CASE WHEN p IS NOT NULL THEN (p - f0 + 8589934592) % 8589934592 END AS ats FROM z),
l AS (SELECT *, last_value(ats IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq) AS a1,
  last_value(CASE WHEN ats IS NOT NULL THEN s END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq) AS s1,
  last_value(ats IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq {_ORDERED}) AS a0,
  last_value(CASE WHEN ats IS NOT NULL THEN s END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq {_ORDERED}) AS s0 FROM m)
SELECT stream_id, seq, coalesce(a1, 0) + (s - coalesce(s1, 0)) * 1500.5 AS time, p IS NOT NULL AND seq > 0 AS checked,
  p IS NOT NULL AND seq > 0 AND abs(ats - (coalesce(a0, 0) + (s - coalesce(s0, 0)) * 1500.5)) > 2000 AS miss FROM l""")
def _(spark, sf_dir):
    frames = b.ticks(spark, sf_dir).select(
        "stream_id", "seq", F.when(F.col("kind") == "purchase", F.col("pts")).alias("pts"), (1 + F.col("k") % 2).alias("fields")
    )
    return s.cadence_times(frames, 1500.5, tolerance=2000).select("stream_id", "seq", "time", "checked", "miss")


@query("w15_retime_duplicates", f"""WITH {b.ITEMS},
t AS (SELECT title_id AS stream_id, pos AS seq, CAST(sum(CASE WHEN part_id % 4 = 0 THEN 0 ELSE duration END) OVER (PARTITION BY title_id ORDER BY pos) AS BIGINT) AS pts FROM items),
x AS (SELECT *, lag(pts) OVER w AS p, lead(pts) OVER w AS n, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
g AS (SELECT *, count(*) OVER (PARTITION BY stream_id) AS c, arg_max(pts, seq) OVER (PARTITION BY stream_id) AS l,
  max(CASE WHEN rn = 2 THEN pts END) OVER (PARTITION BY stream_id) AS s FROM x),
e AS (SELECT *, CAST(round_even(n - (l - s) / nullif(c - 2, 0), 0) AS BIGINT) AS earlier FROM g)
SELECT stream_id, seq, pts, CASE WHEN c >= 3 AND l > s AND p IS NOT NULL AND pts = n AND earlier > p THEN earlier ELSE pts END AS retimed FROM e""")
def _(spark, sf_dir):
    step = F.when(F.col("part_id") % 4 == 0, 0.0).otherwise(F.col("duration"))
    summed = o.ordered(b.items(spark, sf_dir).withColumn("_d", step), "title_id", ["pos"], pts=o.sum_to("_d"))
    ticks = summed.select(F.col("title_id").alias("stream_id"), F.col("pos").alias("seq"), F.col("pts").cast("long").alias("pts"))
    return s.retime_duplicates(ticks)


_CUES = f"""c AS (SELECT *, lag(kind) OVER w AS prev, row_number() OVER w AS rn FROM ticks WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
d AS (SELECT *, lead(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS nx FROM c WHERE rn = 1 OR kind IS DISTINCT FROM prev),
cues AS (SELECT stream_id, seq, pts AS start, coalesce(nx, pts + 450000) AS "end", kind,
  CAST(row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS INTEGER) AS cue FROM d WHERE kind <> 'error')"""


@query("w16_caption_cues", f"""WITH {b.TICKS}, {_CUES} SELECT * FROM cues""")
def _(spark, sf_dir):
    return s.caption_cues(b.ticks(spark, sf_dir), "kind", F.col("kind") != "error")


@query("w16_turn_cues", """WITH t AS (SELECT conv_id AS stream_id, turn AS seq, turn * 90000 AS pts, lower(substr(text, 1, 1)) AS head FROM conversations),
c AS (SELECT *, lag(head) OVER w AS prev, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
d AS (SELECT *, lead(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS nx FROM c WHERE rn = 1 OR head IS DISTINCT FROM prev)
SELECT stream_id, seq, pts AS start, coalesce(nx, pts + 450000) AS "end", head,
  CAST(row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS INTEGER) AS cue FROM d WHERE head <> ''""")
def _(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"),
        F.col("turn").alias("seq"),
        (F.col("turn") * 90_000).alias("pts"),
        F.lower(F.substring("text", 1, 1)).alias("head"),
    )
    return s.caption_cues(turns, "head", F.col("head") != "")


@query("w17_number_episodes", f"""WITH {b.TITLES}, e AS (SELECT *, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY title_idx) AS INTEGER) AS episode FROM titles WHERE status = 'F')
SELECT disc_id, title_id, episode, lpad(CAST(episode AS VARCHAR), CAST(length(CAST(max(episode) OVER (PARTITION BY disc_id) AS VARCHAR)) AS INTEGER), '0') AS number FROM e""")
def _(spark, sf_dir):
    episodes = b.titles(spark, sf_dir).filter(F.col("status") == "F")
    return s.number_episodes(episodes, "disc_id", ["title_idx"]).select("disc_id", "title_id", "episode", "number")


@query("w18_reindex", f"""WITH {b.TITLES}, l AS (SELECT *, CASE WHEN priority = 5 THEN title_idx + 1 END AS episode, priority = 4 AS play_all,
  CASE WHEN priority = 5 AND title_idx % 2 = 0 THEN 'b' END AS part, CASE WHEN priority <= 2 THEN title_id END AS source_pos FROM titles)
SELECT disc_id, title_id, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY CASE WHEN status = 'P' THEN 1 ELSE 0 END,
  CASE WHEN play_all THEN 2 WHEN episode IS NOT NULL THEN 0 ELSE 1 END, coalesce(episode, 0), coalesce(part, ''),
  CASE WHEN source_pos IS NULL THEN 1 ELSE 0 END, coalesce(source_pos, 0), -duration, title_idx) - 1 AS INTEGER) AS new_idx FROM l""")
def _(spark, sf_dir):
    rank = F.col("priority")
    titles = b.titles(spark, sf_dir).withColumns(
        {
            "episode": F.when(rank == 5, F.col("title_idx") + 1),
            "play_all": rank == 4,
            "part": F.when((rank == 5) & (F.col("title_idx") % 2 == 0), "b"),
            "source_pos": F.when(rank <= 2, F.col("title_id")),
        }
    )
    listed = s.reindex(titles, "disc_id", s.listing_keys(F.col("status") != "P"))
    return listed.select("disc_id", "title_id", "new_idx")


_DI = "di AS (SELECT disc_id, title_idx, i.* FROM items i JOIN titles USING (title_id))"


@query("u1_ordered_union", f"""WITH {b.ITEMS}, {b.TITLES}, {_DI},
f AS (SELECT disc_id, clip_id, arg_min(struct_pack(a := title_idx, p := pos, d := duration, z := size), struct_pack(a := title_idx, p := pos)) AS f FROM di GROUP BY 1, 2)
SELECT disc_id, clip_id, f.a AS title_idx, f.p AS pos, f.d AS duration, f.z AS size,
  CAST(row_number() OVER (PARTITION BY disc_id ORDER BY f.a, f.p) - 1 AS INTEGER) AS out_idx FROM f""")
def _(spark, sf_dir):
    return s.ordered_union(disc_items(spark, sf_dir), "disc_id", "title_idx", "pos", "clip_id", ["duration", "size"])


@query("u2_union_streams", f"""WITH {b.STREAMS}, {b.TITLES},
d AS (SELECT disc_id, title_idx, st.*, coalesce('id' || pid, 'sig' || type || codec || lang || coalesce(CAST(channels AS VARCHAR), '~')) AS key
  FROM streams st JOIN titles USING (title_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY disc_id, key ORDER BY title_idx, pos) AS r FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY title_idx, pos) - 1 AS oi FROM f WHERE r = 1)
SELECT disc_id, type, codec, lang, pid, CAST(oi AS INTEGER) AS out_idx,
  CAST(row_number() OVER (PARTITION BY disc_id, type ORDER BY oi) - 1 AS INTEGER) AS type_index FROM k""")
def _(spark, sf_dir):
    titles = b.titles(spark, sf_dir).select("disc_id", "title_id", "title_idx")
    rows = b.streams(spark, sf_dir).select("title_id", "pos", "type", "codec", "lang", "pid", "channels").join(titles, "title_id")
    union = s.union_streams(
        rows.drop("title_id"), "disc_id", "title_idx", ["type", "codec", "lang", "pid", "channels"], ["pid"]
    )
    return union.select("disc_id", "type", "codec", "lang", "pid", "out_idx", "type_index")


@query("u3_shared_items", f"""WITH {b.ITEMS}, {b.TITLES}, {_DI},
a AS (SELECT DISTINCT disc_id, title_idx, clip_id FROM di), z AS (SELECT DISTINCT disc_id, title_idx - 1 AS title_idx, clip_id FROM di)
SELECT disc_id, title_idx, count(*) AS n_shared FROM (SELECT * FROM a INTERSECT SELECT * FROM z) GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = disc_items(spark, sf_dir)
    # Every title against the one after it.
    first = rows.select("disc_id", "title_idx", "clip_id")
    second = rows.select("disc_id", (F.col("title_idx") - 1).alias("title_idx"), "clip_id")
    return first.intersect(second).groupBy("disc_id", "title_idx").agg(F.count(F.lit(1)).alias("n_shared"))


@query("u5_all_disjoint", f"""WITH {b.ITEMS}, {b.TITLES}, {_DI},
p AS (SELECT disc_id, clip_id, count(DISTINCT title_id) AS n FROM di GROUP BY 1, 2)
SELECT disc_id, max(n) = 1 AS disjoint, CAST(sum(n) AS BIGINT) AS n_items FROM p GROUP BY 1""")
def _(spark, sf_dir):
    rows = disc_items(spark, sf_dir)
    return s.all_disjoint(rows, "disc_id", "title_id", "clip_id")


@query("u6_covers", f"""WITH {b.ITEMS4}, {b.TITLES}, {_DI},
h AS (SELECT DISTINCT disc_id, clip_id FROM di WHERE title_idx = 0), w AS (SELECT DISTINCT disc_id, clip_id FROM di WHERE title_idx > 0)
SELECT disc_id, bool_and(w.clip_id IS NOT NULL) AS subset, bool_and(w.clip_id IS NOT NULL AND h.clip_id IS NOT NULL) AS equal
FROM (SELECT coalesce(h.disc_id, w.disc_id) AS disc_id, h.clip_id AS hc, w.clip_id AS wc FROM h FULL JOIN w ON h.disc_id = w.disc_id AND h.clip_id = w.clip_id) q
JOIN (SELECT 1) ON true LEFT JOIN LATERAL (SELECT q.wc AS clip_id) w ON true LEFT JOIN LATERAL (SELECT q.hc AS clip_id) h ON true GROUP BY 1""")
def _(spark, sf_dir):
    rows = disc_items(spark, sf_dir, 4)
    return s.covers(rows.filter(F.col("title_idx") == 0), rows.filter(F.col("title_idx") > 0), "disc_id", "clip_id")


@query("u7_extras", f"""WITH {b.TITLES}, m AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY duration, title_idx) <= 3 AS member FROM titles)
SELECT disc_id, title_id FROM m WHERE duration >= 1200 AND NOT member AND title_idx > 0 AND priority <> 4""")
def _(spark, sf_dir):
    from discframe.bindings.aggregate import with_members

    titles = with_members(spark, sf_dir)
    rest = s.without(
        titles.filter(F.col("duration") >= 1200).select("disc_id", "title_id"),
        titles.filter("member"),
        titles.filter(F.col("priority") == 4),
        titles.filter(F.col("title_idx") == 0),
        on=["title_id"],
    )
    return rest
