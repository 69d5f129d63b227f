"""Registered decision queries: episodes, packed titles, protection, naming, catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.registry import query
from discframe.bindings.sequence import item_marks
from discframe.bindings.timeline import ranked_titles
from discframe.operators import aggregate as a
from discframe.operators import ordered as o
from discframe.operators import project as p
from discframe.operators import rank as r
from discframe.plans import chains as c
from discframe.plans import episodes as ep
from discframe.plans import naming as n
from discframe.plans import packed as pk
from discframe.session import cut_lineage

_PRE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_NOTABLE = b.NOTABLE_SQL.format(minimum=1200, plain=3000)

# --- C5 ------------------------------------------------------------------------------

_PLAYLISTS = f"""sup AS (SELECT l_orderkey AS title_id, pos, l_suppkey AS clip_id FROM lines),
sq AS (SELECT title_id, list(clip_id ORDER BY pos) AS clips FROM sup GROUP BY 1),
pt AS (SELECT f.disc_id, f.title_id, f.title_idx, f.duration, clips, title_id % 1000 AS playlist_no, priority // 3 AS layout,
  {_NOTABLE} AS content, {_NOTABLE} AND duration >= 1500 AND status <> 'P' AS candidate FROM facts f JOIN sq USING (title_id))"""
_EPISODES = """rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disc_id, clips ORDER BY title_idx) AS r FROM pt WHERE candidate) WHERE r = 1),
tf AS (SELECT disc_id, title_idx AS parent, clips, 0 AS at0, CAST([] AS INTEGER[]) AS parts, CAST([] AS BIGINT[]) AS lens FROM rp
  UNION ALL SELECT f.disc_id, f.parent, f.clips, f.at0 + len(q.clips), list_append(f.parts, q.title_idx), list_append(f.lens, len(q.clips))
  FROM tf f JOIN rp q ON q.disc_id = f.disc_id AND q.title_idx <> f.parent AND f.at0 + len(q.clips) <= len(f.clips) AND f.clips[f.at0 + 1 : f.at0 + len(q.clips)] = q.clips),
tl AS (SELECT disc_id, parent, arg_max(parts, lens) AS parts FROM tf WHERE at0 = len(clips) GROUP BY 1, 2),
sg AS (SELECT rp.* FROM rp ANTI JOIN tl ON tl.disc_id = rp.disc_id AND tl.parent = rp.title_idx),
cm AS (SELECT x.disc_id, x.title_idx AS centre, y.title_idx AS m, y.layout, y.title_id FROM sg x JOIN sg y ON x.disc_id = y.disc_id AND abs(x.duration - y.duration) * 100 <= 15 * greatest(x.duration, y.duration, 1)),
dj AS (SELECT disc_id, centre FROM (SELECT DISTINCT cm.disc_id, centre, m, clip_id FROM cm JOIN sup USING (title_id)) GROUP BY 1, 2 HAVING count(*) = count(DISTINCT clip_id)),
ly AS (SELECT disc_id, centre, layout, count(*) AS n, min(m) AS i FROM cm SEMI JOIN dj ON dj.disc_id = cm.disc_id AND dj.centre = cm.centre GROUP BY 1, 2, 3),
dm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disc_id, centre ORDER BY n DESC, i) AS r FROM ly) WHERE r = 1),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY n DESC, centre) AS r2 FROM dm) WHERE r2 = 1 AND n >= 2),
gr AS (SELECT bs.disc_id, cm.m AS title_idx, bs.n FROM bs JOIN cm ON cm.disc_id = bs.disc_id AND cm.centre = bs.centre AND cm.layout = bs.layout),
gl AS (SELECT disc_id, list(title_idx) AS ids, max(n) AS n FROM gr GROUP BY 1),
us AS (SELECT tl.disc_id, parent, parts, len(list_distinct(parts)) = gl.n AS covers FROM tl JOIN gl ON gl.disc_id = tl.disc_id WHERE len(list_filter(parts, lambda x: NOT list_contains(ids, x))) = 0),
cv AS (SELECT disc_id, min(parent) AS cover FROM us WHERE covers GROUP BY 1),
ok AS (SELECT gr.*, cover FROM gr LEFT JOIN cv USING (disc_id) WHERE n >= 3 OR cover IS NOT NULL),
lo AS (SELECT ok.disc_id, max(duration) AS longest FROM ok JOIN rp ON rp.disc_id = ok.disc_id AND rp.title_idx = ok.title_idx GROUP BY 1),
mine AS (SELECT rp.disc_id, rp.clips FROM rp JOIN ok ON rp.disc_id = ok.disc_id AND rp.title_idx = ok.title_idx
  UNION SELECT rp.disc_id, rp.clips FROM rp JOIN us ON rp.disc_id = us.disc_id AND rp.title_idx = us.parent),
rv AS (SELECT DISTINCT pt.disc_id FROM pt JOIN lo USING (disc_id) WHERE content AND pt.duration >= 3 * longest
  AND NOT EXISTS (SELECT 1 FROM mine WHERE mine.disc_id = pt.disc_id AND mine.clips = pt.clips)),
ed AS (SELECT ok.* FROM ok WHERE disc_id NOT IN (SELECT disc_id FROM rv)),
nm AS (SELECT ed.disc_id, rp.title_id, rp.title_idx, cover,
    row_number() OVER (PARTITION BY ed.disc_id ORDER BY playlist_no, ed.title_idx) AS by_list FROM ed JOIN rp ON rp.disc_id = ed.disc_id AND rp.title_idx = ed.title_idx),
labels AS (SELECT nm.disc_id, nm.title_id, CAST(CASE WHEN cover IS NULL THEN by_list ELSE len(parts) + 1 - list_position(list_reverse(parts), nm.title_idx) END AS INTEGER) AS episode, false AS play_all
    FROM nm LEFT JOIN tl ON tl.disc_id = nm.disc_id AND tl.parent = cover
  UNION ALL SELECT us.disc_id, rp.title_id, NULL, true FROM us JOIN rp ON rp.disc_id = us.disc_id AND rp.title_idx = us.parent WHERE us.disc_id IN (SELECT disc_id FROM nm))"""


def playlists(spark, sf_dir):
    """Facts of every title as a playlist over supplier clips."""
    facts = p.title_facts(b.titles(spark, sf_dir), b.streams(spark, sf_dir), b.items(spark, sf_dir), share=0.5)
    listed = facts.withColumn("content", p.notable_flag(minimum=1200, plain=3000))
    return listed.withColumns(
        {
            "playlist_no": F.col("title_id") % 1000,
            "layout": F.floor(F.col("priority") / 3),
            "candidate": F.col("content") & (F.col("duration") >= 1500) & (F.col("status") != "P"),
        }
    )


def supplier_items(spark, sf_dir, *more):
    return b.lines(spark, sf_dir, ["l_suppkey", "l_quantity", *more]).select(
        F.col("l_orderkey").alias("title_id"), "pos", F.col("l_suppkey").alias("clip_id"), F.col("l_quantity").alias("seconds"), *more
    )


@query("c5_playlist_episodes", f"""WITH RECURSIVE {b.CATALOG}, {b.facts_sql(0.5)}, {_PLAYLISTS}, {_EPISODES}
SELECT disc_id, title_id, episode, play_all FROM labels""")
def _(spark, sf_dir):
    return ep.label_playlist_episodes(playlists(spark, sf_dir), cut_lineage(supplier_items(spark, sf_dir)))


# --- C6, C7, C12, U7 -------------------------------------------------------------------


def title_sets(spark, sf_dir):
    """Chains of a title set (= customer) and their cells (= supplier clips)."""
    items = cut_lineage(supplier_items(spark, sf_dir))
    stats = items.groupBy("title_id").agg(F.count(F.lit(1)).alias("n_cells"))
    chains = b.titles(spark, sf_dir).join(stats, "title_id", "left").select(
        F.col("disc_id").alias("set_id"),
        F.col("title_idx").alias("pgc"),
        "duration",
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
        (F.col("priority") == 2).alias("angle"),
        "title_id",
    )
    cells = items.join(chains.select("set_id", "pgc", "title_id"), "title_id").select(
        "set_id", "pgc", "pos", F.col("clip_id").alias("cell"), "seconds"
    )
    return chains.drop("title_id"), cells


@query("c6_chain_episodes")
def _(spark, sf_dir):
    chains, cells = title_sets(spark, sf_dir)
    return ep.label_chain_episodes(chains, cells, minimum=1500)


@query("c6_footage_pairs", f"""WITH {b.LINES}, {b.TITLES}, sc AS (SELECT disc_id AS set_id, title_idx AS pgc, l_suppkey AS cell, sum(l_quantity) AS s FROM lines JOIN titles ON title_id = l_orderkey GROUP BY 1, 2, 3),
tt AS (SELECT set_id, pgc, sum(s) AS t FROM sc GROUP BY 1, 2),
pr AS (SELECT x.set_id, x.pgc AS a, y.pgc AS b, sum(x.s) AS sa, sum(y.s) AS sb FROM sc x JOIN sc y ON x.set_id = y.set_id AND x.cell = y.cell AND x.pgc < y.pgc GROUP BY 1, 2, 3)
SELECT pr.set_id, a, b FROM pr JOIN tt ta ON ta.set_id = pr.set_id AND ta.pgc = a JOIN tt tb ON tb.set_id = pr.set_id AND tb.pgc = b WHERE sa >= 0.5 * ta.t OR sb >= 0.5 * tb.t""")
def _(spark, sf_dir):
    _, cells = title_sets(spark, sf_dir)
    seconds = cells.groupBy("set_id", "pgc", "cell").agg(F.sum("seconds").alias("seconds"))
    return ep.footage_pairs(seconds, "set_id", "pgc")


@query("c7_episode_parts", f"""WITH {b.TITLES}, m AS (SELECT disc_id, title_idx AS pgc, CASE WHEN title_idx % 2 = disc_id % 2 THEN 1200 ELSE 300 END + title_id % 7 AS d FROM titles),
k AS (SELECT *, CASE WHEN d > 1000 THEN 'l' ELSE 's' END AS fam, row_number() OVER (PARTITION BY disc_id ORDER BY pgc) AS rn FROM m),
g AS (SELECT disc_id FROM k GROUP BY 1 HAVING count(*) FILTER (WHERE fam = 'l') = count(*) FILTER (WHERE fam = 's') AND count(*) >= 4)
SELECT disc_id, pgc, CAST((rn + 1) // 2 AS INTEGER) AS episode, CASE WHEN rn % 2 = 1 THEN 'a' ELSE 'b' END AS part FROM k WHERE disc_id IN (SELECT disc_id FROM g)""")
def _(spark, sf_dir):
    rows = b.titles(spark, sf_dir)
    length = F.when(F.col("title_idx") % 2 == F.col("disc_id") % 2, 1200).otherwise(300) + F.col("title_id") % 7
    members = rows.select("disc_id", F.col("title_idx").alias("pgc"), length.alias("duration"))
    return ep.episode_parts(members, "disc_id")


@query("c12_alternate_chains", f"""WITH {b.LINES}, {b.TITLES}, sc AS (SELECT disc_id, title_idx, title_id, duration, l_suppkey % 10 AS cell, sum(l_quantity) AS s FROM lines JOIN titles ON title_id = l_orderkey GROUP BY 1, 2, 3, 4, 5),
df AS (SELECT disc_id, arg_min(title_idx, struct_pack(d := -duration, i := title_idx)) AS pgc FROM (SELECT DISTINCT disc_id, title_idx, duration FROM sc) GROUP BY 1),
ba AS (SELECT sc.disc_id, cell, s FROM sc JOIN df ON df.disc_id = sc.disc_id AND df.pgc = sc.title_idx),
tt AS (SELECT disc_id, sum(s) AS t FROM ba GROUP BY 1),
sh AS (SELECT sc.disc_id, title_idx, sum(ba.s) AS shared FROM sc JOIN ba ON ba.disc_id = sc.disc_id AND ba.cell = sc.cell GROUP BY 1, 2)
SELECT x.disc_id AS set_id, x.title_idx AS pgc, coalesce(shared >= 0.5 * t, false) AS is_edition FROM (SELECT DISTINCT disc_id, title_idx, duration FROM sc) x
JOIN df ON df.disc_id = x.disc_id AND df.pgc <> x.title_idx JOIN tt ON tt.disc_id = x.disc_id LEFT JOIN sh ON sh.disc_id = x.disc_id AND sh.title_idx = x.title_idx WHERE duration >= 1200""")
def _(spark, sf_dir):
    chains, cells = title_sets(spark, sf_dir)
    cells = cells.withColumn("cell", F.col("cell") % 10)
    played = chains.filter(F.col("n_cells") > 0)
    none = F.lit(None).cast("int")
    defaults = a.choose_chain(played, "set_id", none, F.lit(False), "pgc")
    return ep.alternate_chains(chains, cells, defaults, minimum=1200)


# --- C9, C10 --------------------------------------------------------------------------------

_RULES = pk.Rules(short=6000, bucket=500, min_episode=0, max_episode=1e12, spread=0.9, lead_match=150, snap=6000)


def tick_titles(spark, sf_dir):
    """Event users as titles: marks are running sums of their values, in hundredths."""
    summed = o.ordered(b.ticks(spark, sf_dir), "stream_id", ["seq"], _t=o.sum_before("pts"))
    marks = summed.select(
        F.col("stream_id").alias("title_id"), F.col("seq").alias("mark_idx"), F.col("_t").cast("double").alias("t"), "pts"
    )
    titles = marks.groupBy("title_id").agg(F.sum("pts").cast("double").alias("duration"))
    return marks.drop("pts"), titles


def packed_sql(marks: str, r: pk.Rules) -> str:
    """CTEs up to ``segments`` over *marks*: ``title_id, i0, t, duration`` (rules without an upper bound)."""
    return f"""mk AS ({marks}),
gp AS (SELECT title_id, t, duration, row_number() OVER w - 1 AS i, coalesce(lead(t) OVER w, duration) - t AS gap FROM mk WHERE t >= 0 AND t < duration WINDOW w AS (PARTITION BY title_id ORDER BY t, i0)),
kd AS (SELECT *, CAST(round_even(gap / {r.bucket}, 0) AS BIGINT) AS kind, i = 0 OR pg < {r.short} AS after FROM (SELECT *, lag(gap) OVER (PARTITION BY title_id ORDER BY i) AS pg FROM gp) WHERE gap > 0 AND gap < {r.short}),
sp AS (SELECT *, t - lag(t) OVER (PARTITION BY title_id, kind, after ORDER BY i) AS space FROM kd),
ks AS (SELECT title_id, kind, after, count(*) AS n, median(space) AS typical, min(space) AS lo, max(space) AS hi, min(t) AS first FROM sp GROUP BY 1, 2, 3),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY first, n DESC) AS r FROM ks WHERE n >= {r.min_cycles} AND typical >= {r.min_episode} AND hi - typical <= {r.spread} * typical AND typical - lo <= {r.spread} * typical) WHERE r = 1),
an AS (SELECT kd.title_id, kd.i, typical FROM kd JOIN bk ON bk.title_id = kd.title_id AND bk.kind = kd.kind AND bk.after = kd.after),
rn AS (SELECT gp.*, an.i IS NOT NULL AS anchor, gp.i - 1 - coalesce(max(CASE WHEN gap >= {r.short} THEN gp.i END) OVER (PARTITION BY gp.title_id ORDER BY gp.i {_PRE}), -1) AS run,
  min(an.i) OVER (PARTITION BY gp.title_id) AS a0, max(typical) OVER (PARTITION BY gp.title_id) AS typ FROM gp LEFT JOIN an ON an.title_id = gp.title_id AND an.i = gp.i),
fc AS (SELECT title_id, min(run) FILTER (WHERE anchor AND i > a0) AS ending, max(run) FILTER (WHERE anchor AND i > a0) AS longest, coalesce(max(i) FILTER (WHERE i = a0 AND run = i), 0) AS lead_n, min(t) AS t0, max(a0) AS a0, max(typ) AS typ, max(duration) AS duration
  FROM rn WHERE a0 IS NOT NULL GROUP BY 1),
it AS (SELECT fc.title_id, lead_n FROM fc JOIN rn a ON a.title_id = fc.title_id AND a.anchor AND a.i > fc.a0
  JOIN rn g ON g.title_id = a.title_id AND g.i >= a.i - lead_n AND g.i < a.i JOIN rn l ON l.title_id = a.title_id AND l.i = g.i - (a.i - lead_n)
  WHERE lead_n > 0 AND lead_n < ending AND ending = longest GROUP BY 1, 2 HAVING bool_and(abs(g.gap - l.gap) <= {r.lead_match})),
st AS (SELECT a.title_id, s.t AS start, a.i AS byi FROM rn a JOIN fc ON fc.title_id = a.title_id AND a.anchor AND a.i > fc.a0 LEFT JOIN it ON it.title_id = a.title_id
  JOIN gp s ON s.title_id = a.title_id AND s.i = a.i - (a.run - (ending - coalesce(it.lead_n, 0)))
  UNION ALL SELECT title_id, t0, -1 FROM fc),
sgm AS (SELECT st.title_id, row_number() OVER w - 1 AS seg_idx, start, coalesce(lead(start) OVER w, duration) AS en, row_number() OVER w AS episode, lead(start) OVER w IS NULL AS last, typ, duration FROM st JOIN fc USING (title_id) WINDOW w AS (PARTITION BY st.title_id ORDER BY byi)),
cu AS (SELECT sgm.title_id, arg_min(bd.t, struct_pack(o := abs(bd.t - (start + typ)), t := bd.t)) AS cut, min(abs(bd.t - (start + typ))) AS off, max(en) AS en FROM sgm
  JOIN (SELECT title_id, t FROM gp UNION ALL SELECT title_id, duration FROM fc) bd ON bd.title_id = sgm.title_id AND bd.t > start WHERE last AND en - start > typ + {r.snap} GROUP BY 1),
ct AS (SELECT title_id, cut FROM cu WHERE off <= {r.snap} AND cut < en),
segments AS (SELECT sgm.title_id, CAST(seg_idx AS INTEGER) AS seg_idx, start, CASE WHEN last AND cut IS NOT NULL THEN cut ELSE en END AS "end", CAST(episode AS INTEGER) AS episode FROM sgm LEFT JOIN ct USING (title_id)
  UNION ALL SELECT sgm.title_id, CAST(seg_idx + 1 AS INTEGER), cut, en, NULL FROM sgm JOIN ct USING (title_id) WHERE last)"""


_PACKED = packed_sql(
    f"""SELECT stream_id AS title_id, seq AS i0, CAST(coalesce(sum(pts) OVER (PARTITION BY stream_id ORDER BY seq {_PRE}), 0) AS DOUBLE) AS t,
  CAST(sum(pts) OVER (PARTITION BY stream_id) AS DOUBLE) AS duration FROM ticks""",
    _RULES,
)


@query("c9_packed_episodes", f"""WITH {b.TICKS}, {_PACKED} SELECT * FROM segments""")
def _(spark, sf_dir):
    marks, titles = tick_titles(spark, sf_dir)
    return pk.packed_episodes(marks, titles, _RULES)


def _segments(spark, sf_dir):
    total = b.items(spark, sf_dir).groupBy("title_id").agg(F.sum("duration").alias("total"))
    last = F.floor((F.col("total") - 1) / 40).cast("int")
    rows = total.withColumn("seg_idx", F.explode(F.sequence(F.lit(0), last)))
    is_last = (F.col("seg_idx") == last) & (last > 0)
    return rows.select(
        "title_id",
        "seg_idx",
        (F.col("seg_idx") * 40.0).alias("start"),
        F.least((F.col("seg_idx") + 1) * 40.0, "total").alias("end"),
        F.when(~is_last, F.col("seg_idx") + 1).alias("episode"),
    )


_SPLIT = f"""ck AS (SELECT *, coalesce(sum(duration) OVER w, 0) AS cs, CAST(coalesce(sum(size) OVER w, 0) AS BIGINT) AS bs, sum(duration) OVER (PARTITION BY title_id) AS total FROM items WINDOW w AS (PARTITION BY title_id ORDER BY pos {_PRE})),
sg AS (SELECT title_id, CAST(g AS INTEGER) AS seg_idx, g * 40.0 AS st, least((g + 1) * 40.0, total) AS en, CASE WHEN NOT (g = floor((total - 1) / 40) AND g > 0) THEN g + 1 END AS episode FROM (SELECT DISTINCT title_id, total FROM ck), generate_series(0, 40) s(g) WHERE g <= floor((total - 1) / 40)),
ch AS (SELECT sg.*, (SELECT max(pos) FROM ck WHERE ck.title_id = sg.title_id AND cs <= st + 0.001) AS fp, (SELECT min(pos) FROM ck WHERE ck.title_id = sg.title_id AND cs + duration >= en - 0.001) AS lp FROM sg)"""


@query("c10_split_children", f"""WITH {b.ITEMS}, {_SPLIT}
SELECT ch.title_id, seg_idx, CAST(episode AS INTEGER) AS episode, 'T' || ch.title_id || CASE WHEN episode IS NULL THEN ' - Extra 1' ELSE ' - Episode ' || lpad(CAST(episode AS VARCHAR), CAST(length(CAST(max(episode) OVER (PARTITION BY ch.title_id) AS VARCHAR)) AS INTEGER), '0') END AS name,
  fp AS first_pos, lp AS last_pos, st - f.cs AS range_start, en - f.cs AS range_end, l.bs + l.size - f.bs AS size
FROM ch JOIN ck f ON f.title_id = ch.title_id AND f.pos = fp JOIN ck l ON l.title_id = ch.title_id AND l.pos = lp""")
def _(spark, sf_dir):
    return _split(spark, sf_dir)[0]


def _split(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    names = segments.select("title_id").distinct().withColumn("base_name", F.concat(F.lit("T"), F.col("title_id").cast("string")))
    marks = item_marks(spark, sf_dir).select("title_id", "mark_idx", "t")
    return pk.split_packed(segments, b.items(spark, sf_dir), marks, names)


@query("c10_split_chapters", f"""WITH {b.ITEMS}, {_SPLIT}
SELECT m.title_id, seg_idx, m.pos AS mark_idx, m.cs - f.cs AS t FROM ck m JOIN ch ON ch.title_id = m.title_id AND st <= m.cs AND m.cs < en JOIN ck f ON f.title_id = ch.title_id AND f.pos = fp""")
def _(spark, sf_dir):
    return _split(spark, sf_dir)[1]


@query("c10_expand_order", f"""WITH {b.ITEMS}, {b.TITLES}, {_SPLIT},
al AS (SELECT disc_id, t.title_id, title_idx, 0 AS seg_idx FROM titles t WHERE t.title_id NOT IN (SELECT title_id FROM sg) UNION ALL SELECT disc_id, t.title_id, title_idx, seg_idx FROM titles t JOIN sg USING (title_id))
SELECT *, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY title_idx, seg_idx) - 1 AS INTEGER) AS new_idx FROM al""")
def _(spark, sf_dir):
    return pk.expand_order(b.titles(spark, sf_dir), _segments(spark, sf_dir))


# --- C11, C13 ---------------------------------------------------------------------------------


def protected_chains(spark, sf_dir):
    """Every title as a chain: 4 clips, so that equal cell lists occur on a disc."""
    cells = cut_lineage(b.items(spark, sf_dir, 4).select("title_id", "pos", "clip_id", "part_id"))
    fingerprint = a.layout_signature(cells, "title_id", ["pos"], ["clip_id"])
    jumps = o.ordered(cells, "title_id", ["pos"], _prev=o.lag("part_id"))
    back = jumps.groupBy("title_id").agg(F.count_if(F.col("part_id") < F.col("_prev")).alias("backward_jumps"))
    chains = b.titles(spark, sf_dir).join(fingerprint, "title_id").join(back, "title_id")
    return chains.select(
        "disc_id",
        "title_id",
        (F.floor(F.col("duration") / 2000) * 2000).alias("duration"),
        F.col("priority").alias("vts"),
        F.col("title_idx").alias("chain_pgc"),
        "backward_jumps",
        (F.col("status") == "P").alias("padded"),
        F.col("n").alias("n_cells"),
        F.struct("n", "sig_a", "sig_b").alias("cells_sig"),
        (F.col("title_id") % 2).alias("tracks_sig"),
        F.when(F.col("status") == "F", F.col("title_idx") + 1).alias("episode"),
        F.lit(None).cast("string").alias("part"),
        (F.col("priority") == 1).alias("play_all"),
    )


_PROTECTED = f"""fp AS (SELECT title_id, list(clip_id ORDER BY pos) AS cells, count(*) AS n_cells FROM items GROUP BY 1),
jp AS (SELECT title_id, count(*) FILTER (WHERE part_id < pv) AS jumps FROM (SELECT *, lag(part_id) OVER (PARTITION BY title_id ORDER BY pos) AS pv FROM items) GROUP BY 1),
pc AS (SELECT disc_id, t.title_id, title_idx, priority AS vts, floor(duration / 2000) * 2000 AS d, status, jumps, cells, n_cells, t.title_id % 2 AS tr FROM titles t JOIN fp USING (title_id) JOIN jp USING (title_id)),
fl AS (SELECT *, d >= 0.5 * max(d) OVER (PARTITION BY disc_id) AS film FROM pc),
dc AS (SELECT *, film AND jumps >= 2 AND count(*) FILTER (WHERE film) OVER (PARTITION BY disc_id) >= 5 AND bool_or(film AND jumps = 0) OVER (PARTITION BY disc_id) AS decoy FROM fl),
ex AS (SELECT *, count(*) FILTER (WHERE NOT decoy AND status <> 'P') OVER (PARTITION BY disc_id, vts) AS exact FROM dc),
du AS (SELECT *, NOT decoy AND row_number() OVER (PARTITION BY disc_id, cells, d, tr, CASE WHEN n_cells < 3 THEN vts ELSE -1 END, decoy ORDER BY status = 'P', exact DESC, vts, title_idx, title_id) > 1 AS duplicate FROM ex),
protected AS (SELECT disc_id, title_id, title_idx, vts, d, decoy, duplicate, CASE WHEN NOT decoy AND NOT duplicate AND status = 'F' THEN title_idx + 1 END AS episode, vts = 1 AND NOT decoy AND NOT duplicate AS play_all FROM du)"""


@query("c11_settle_protection", f"""WITH {b.ITEMS4}, {b.TITLES}, {_PROTECTED} SELECT disc_id, title_id, decoy, duplicate, episode, play_all FROM protected""")
def _(spark, sf_dir):
    settled = c.settle_protection(protected_chains(spark, sf_dir), features=5, jumps=2)
    return settled.select("disc_id", "title_id", "decoy", "duplicate", "episode", "play_all")


def _editions(spark, sf_dir):
    ranked = ranked_titles(spark, sf_dir)
    mains = r.main_feature(ranked, F.col("notable"), minimum=1500)
    titles = ranked.select(
        "disc_id",
        "title_id",
        F.col("priority").alias("vts"),
        F.col("title_idx").alias("chain_pgc"),
        "duration",
        "notable",
        (F.col("status") == "O").alias("is_edition"),
        F.when((F.col("disc_id") % 5 == 0) & (F.col("title_idx") == 0), 1).alias("episode"),
        F.lit(False).alias("play_all"),
        F.when(F.col("title_idx") > 0, F.col("title_idx")).alias("pgc_number"),
    )
    return titles, mains


_MAIN = f"""sc AS (SELECT *, {_NOTABLE} AS notable, status = 'P' AND title_id % 50 = 0 AS remote, title_id % 97 = 0 AS auth FROM facts),
mr AS (SELECT disc_id, title_id, row_number() OVER (PARTITION BY disc_id ORDER BY NOT (notable OR remote), duration < 1500,
  CASE WHEN duration >= 1500 THEN -CAST(remote AS INTEGER) END, CASE WHEN duration >= 1500 THEN -CAST(auth AS INTEGER) END,
  CASE WHEN duration >= 1500 THEN -(n_audio + n_sub) END, CASE WHEN duration >= 1500 THEN -CAST(priority <> 3 AS INTEGER) END,
  CASE WHEN duration >= 1500 THEN -n_items END, CASE WHEN duration >= 1500 THEN CASE WHEN priority < 5 THEN title_id % 100 ELSE 0 END END,
  CASE WHEN duration >= 1500 THEN -duration END, title_idx) AS r FROM sc),
mains AS (SELECT disc_id, title_id FROM mr WHERE r = 1)"""


@query("c13_settle_editions", f"""WITH {b.CATALOG}, {b.facts_sql(0.5)}, {_MAIN},
mv AS (SELECT m.disc_id, s.priority AS mvts, s.duration AS md FROM mains m JOIN sc s USING (title_id)),
v AS (SELECT s.*, s.priority = mvts AS inm, status = 'O' AS ie, bool_or(s.disc_id % 5 = 0 AND title_idx = 0) OVER (PARTITION BY s.disc_id) AS series, abs(duration - md) <= 0.1 * md AS near FROM sc s LEFT JOIN mv USING (disc_id)),
w AS (SELECT *, inm AND NOT series AND notable AND (ie OR near) AS ver FROM v),
x AS (SELECT *, count(*) FILTER (WHERE ver) OVER (PARTITION BY disc_id) AS n, sum(CASE WHEN ver THEN 1 ELSE 0 END) OVER (PARTITION BY disc_id ORDER BY title_idx, title_id) AS no FROM w)
SELECT disc_id, title_id, CAST(CASE WHEN ver AND n >= 2 THEN no END AS BIGINT) AS edition_no, (ver AND n >= 2) OR (ie AND inm AND NOT (ver AND n < 2)) AS is_edition,
  CASE WHEN ver AND n >= 2 THEN 'Edition ' || CAST(no AS BIGINT) WHEN title_idx > 0 THEN 'PGC ' || title_idx END AS label FROM x""")
def _(spark, sf_dir):
    titles, mains = _editions(spark, sf_dir)
    settled = c.settle_editions(titles, mains)
    return settled.select("disc_id", "title_id", "edition_no", "is_edition", c.chain_label().alias("label"))


# --- C14, C15, C16, C17 -----------------------------------------------------------------------------


_CROSS = """cd AS (SELECT * FROM (SELECT disc_id, title_id, title_idx, priority * 10 + title_idx // 2 AS number, duration, row_number() OVER (PARTITION BY disc_id, priority * 10 + title_idx // 2 ORDER BY title_idx) AS r FROM titles WHERE status <> 'P' AND duration >= 600) WHERE r = 1),
nn AS (SELECT x.disc_id, x.title_idx, x.duration AS v, count(*) AS near FROM cd x JOIN cd y ON x.disc_id = y.disc_id AND abs(x.duration - y.duration) * 100 <= 15 * greatest(x.duration, y.duration, 1) GROUP BY 1, 2, 3),
bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY near DESC, title_idx) AS r FROM nn) WHERE r = 1 AND near >= 3),
cg AS (SELECT cd.* FROM cd JOIN bc ON bc.disc_id = cd.disc_id AND abs(cd.duration - v) * 100 <= 15 * greatest(cd.duration, v, 1)),
cl AS (SELECT disc_id, max(duration) AS longest FROM cg GROUP BY 1),
cr AS (SELECT DISTINCT t.disc_id FROM titles t JOIN cl USING (disc_id) WHERE priority <> 4 AND duration >= 600 AND duration >= 3 * longest AND NOT EXISTS (SELECT 1 FROM cg WHERE cg.disc_id = t.disc_id AND cg.number = t.priority * 10 + t.title_idx // 2)),
crossed AS (SELECT disc_id, title_id, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY number) AS INTEGER) AS episode FROM cg WHERE disc_id NOT IN (SELECT disc_id FROM cr))"""


def numbered_titles(spark, sf_dir):
    return b.titles(spark, sf_dir).withColumns(
        {"number": F.col("priority") * 10 + F.floor(F.col("title_idx") / 2), "play_all": F.col("priority") == 4}
    )


@query("c14_cross_set", f"""WITH {b.TITLES}, {_CROSS} SELECT * FROM crossed""")
def _(spark, sf_dir):
    return ep.label_cross_set(numbered_titles(spark, sf_dir), F.col("status") != "P", minimum=600)


@query("a15_demote_dwarfed", f"""WITH {b.TITLES}, e AS (SELECT *, CASE WHEN priority >= 4 AND duration < 5000 THEN title_idx END AS ep0, priority = 1 AS pa FROM titles),
g AS (SELECT *, max(CASE WHEN ep0 IS NOT NULL AND NOT pa THEN duration END) OVER w AS longest, max(CASE WHEN ep0 IS NULL AND NOT pa THEN duration END) OVER w AS rival FROM e WINDOW w AS (PARTITION BY disc_id))
SELECT disc_id, title_id, CASE WHEN ep0 IS NOT NULL AND NOT pa AND coalesce(rival >= 3 * longest, false) THEN NULL ELSE ep0 END AS episode FROM g""")
def _(spark, sf_dir):
    titles = b.titles(spark, sf_dir).withColumns(
        {
            "episode": F.when((F.col("priority") >= 4) & (F.col("duration") < 5000), F.col("title_idx")),
            "play_all": F.col("priority") == 1,
            "part": F.lit(None).cast("string"),
        }
    )
    return ep.demote_dwarfed(titles).select("disc_id", "title_id", "episode")


@query("c15_name_titles", f"""WITH {b.TITLES},
ds AS (SELECT c_custkey AS disc_id, CASE WHEN c_custkey % 3 = 0 THEN 'Show ' || c_custkey % 7 || ' Disc ' || (1 + c_custkey % 9) WHEN c_custkey % 3 = 1 THEN 'Film ' || c_custkey END AS dn FROM customer),
l AS (SELECT t.*, dn, t.disc_id % 3 AS k, CASE WHEN status = 'F' AND t.disc_id % 2 = 0 THEN title_idx + 1 END AS e, priority = 4 AND NOT (status = 'F' AND t.disc_id % 2 = 0) AS pa, priority = 5 AS dec, title_idx = 3 AS dup,
  CASE WHEN duration < 900 THEN 'Short clip' END AS sl, CASE WHEN title_idx = 1 THEN 'Edition 2' END AS el FROM titles t LEFT JOIN ds ON ds.disc_id = t.disc_id),
m AS (SELECT *, max(coalesce(e, 0)) OVER w AS top, bool_or(e IS NOT NULL OR pa) OVER w AS series, CASE k WHEN 0 THEN 'Show ' || disc_id % 7 WHEN 1 THEN 'Film ' || disc_id ELSE 'Source ' || disc_id || ' 1999' END AS disc,
  CASE k WHEN 0 THEN 'Show ' || disc_id % 7 || printf(' - D%02d', 1 + disc_id % 9) WHEN 1 THEN 'Film ' || disc_id ELSE 'Source ' || disc_id || ' 1999' END AS show_n FROM l WINDOW w AS (PARTITION BY disc_id)),
q AS (SELECT *, CASE WHEN series THEN show_n ELSE CASE k WHEN 0 THEN dn ELSE disc END END AS base FROM m)
SELECT disc_id, title_id, CASE WHEN e IS NOT NULL THEN show_n || ' - Episode ' || lpad(CAST(e AS VARCHAR), CAST(length(CAST(greatest(top, 1) AS VARCHAR)) AS INTEGER), '0') WHEN pa THEN show_n || ' - Play All'
  WHEN dec THEN base || ' - Decoy' WHEN dup THEN base || ' - Duplicate' WHEN sl IS NOT NULL THEN base || ' - ' || sl WHEN el IS NOT NULL THEN base || ' - ' || el ELSE base END AS name FROM q""")
def _(spark, sf_dir):
    key = F.col("c_custkey")
    discs = b.table(spark, sf_dir, "customer").select(
        key.alias("disc_id"),
        F.when(
            key % 3 == 0,
            F.concat(F.lit("Show "), (key % 7).cast("string"), F.lit(" Disc "), (1 + key % 9).cast("string")),
        )
        .when(key % 3 == 1, F.concat(F.lit("Film "), key.cast("string")))
        .alias("disc_name"),
        F.concat(F.lit("source."), key.cast("string"), F.lit(".1999.NTSC.DVD9")).alias("source_name"),
        F.lit("volumes").alias("parent_name"),
    )
    episode = F.when((F.col("status") == "F") & (F.col("disc_id") % 2 == 0), F.col("title_idx") + 1)
    none = F.lit(None).cast("string")
    titles = b.titles(spark, sf_dir).select(
        "disc_id",
        "title_id",
        F.lit("?").alias("name"),
        F.lit(False).alias("keep_name"),
        episode.alias("episode"),
        none.alias("part"),
        ((F.col("priority") == 4) & episode.isNull()).alias("play_all"),
        F.lit(False).alias("packed"),
        (F.col("priority") == 5).alias("decoy"),
        (F.col("title_idx") == 3).alias("duplicate"),
        F.when(F.col("duration") < 900, "Short clip").alias("short_label"),
        F.when(F.col("title_idx") == 1, "Edition 2").alias("edition_label"),
    )
    return n.name_titles(titles, discs).select("disc_id", "title_id", "name")


@query("c16_apply_catalog", f"""WITH {b.TITLES},
md AS (SELECT DISTINCT disc_id, disc_id % 500 AS h FROM titles WHERE disc_id % 4 <> 0),
re AS (SELECT DISTINCT disc_id AS remote_id, disc_id % 500 AS h, disc_id % 500 % 7 AS sig FROM titles WHERE disc_id % 3 <> 0),
ma AS (SELECT md.disc_id, min(remote_id) AS remote_id FROM md JOIN re USING (h) GROUP BY 1 HAVING count(DISTINCT sig) = 1),
rt AS (SELECT disc_id AS remote_id, title_id AS rid, CAST(title_idx AS VARCHAR) AS k, duration + title_id % 5 AS d, 'Item ' || title_id AS nm, CASE WHEN title_idx = 0 THEN 'MainMovie' ELSE 'Extra' END AS ty FROM titles),
cx AS (SELECT t.disc_id, t.title_id, rt.rid, nm, ty FROM titles t JOIN ma USING (disc_id) JOIN rt ON rt.remote_id = ma.remote_id AND rt.k = CAST(t.title_idx AS VARCHAR) AND abs(rt.d - t.duration) <= 3),
c1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY title_id) AS n FROM cx) WHERE n = 1),
ok AS (SELECT * FROM c1 WHERE disc_id NOT IN (SELECT disc_id FROM c1 GROUP BY disc_id, rid HAVING count(*) > 1))
SELECT t.disc_id, t.title_id, coalesce(nm, 'T' || t.title_id) AS name, ty AS item_type, coalesce(ty = 'MainMovie', false) AS remote_main FROM titles t LEFT JOIN ok ON ok.title_id = t.title_id""")
def _(spark, sf_dir):
    titles = b.titles(spark, sf_dir).select(
        "disc_id", "title_id", "title_idx", "duration", F.concat(F.lit("T"), F.col("title_id").cast("string")).alias("name")
    )
    key = F.col("title_idx").cast("string")
    keys = titles.select("title_id", key.alias("source_key"))
    discs = titles.select("disc_id").distinct()
    digest = F.concat(F.lit("h"), (F.col("disc_id") % 500).cast("string"))
    local = discs.filter(F.col("disc_id") % 4 != 0).select("disc_id", F.lit("hash").alias("kind"), digest.alias("value"))
    remote = discs.filter(F.col("disc_id") % 3 != 0).select(
        F.col("disc_id").alias("remote_id"),
        F.col("disc_id").alias("ordinal"),
        (F.col("disc_id") % 500 % 7).cast("string").alias("signature"),
        F.lit("hash").alias("kind"),
        F.upper(digest).alias("value"),
    )
    offered = titles.select(
        F.col("disc_id").alias("remote_id"),
        F.col("title_id").alias("remote_title"),
        key.alias("source_key"),
        (F.col("duration") + F.col("title_id") % 5).alias("duration"),
        F.concat(F.lit("dir/Item "), F.col("title_id").cast("string"), F.lit(".mkv")).alias("filename"),
        F.when(F.col("title_idx") == 0, "MainMovie").otherwise("Extra").alias("item_type"),
        F.lit(None).cast("int").alias("season"),
        F.lit(None).cast("int").alias("episode"),
    )
    done = n.apply_catalog(titles, keys, local, remote, offered)
    return done.select("disc_id", "title_id", "name", "item_type", "remote_main")


@query("c17_rip_set", f"""WITH {b.CATALOG}, {b.facts_sql(0.5)}, {_MAIN},
e AS (SELECT *, disc_id % 3 = 0 AND status = 'F' AS ep FROM titles), s AS (SELECT *, bool_or(ep) OVER (PARTITION BY disc_id) AS series FROM e)
SELECT disc_id, title_id, series FROM s WHERE CASE WHEN series THEN ep ELSE title_id IN (SELECT title_id FROM mains) END""")
def _(spark, sf_dir):
    ranked = ranked_titles(spark, sf_dir)
    mains = r.main_feature(ranked, F.col("notable"), minimum=1500)
    episode = F.when((F.col("disc_id") % 3 == 0) & (F.col("status") == "F"), 1)
    titles = b.titles(spark, sf_dir).withColumns({"episode": episode, "play_all": F.lit(False)})
    return n.rip_set(titles, mains)
