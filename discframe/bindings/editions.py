"""Registered queries: duplicates, edition groups, combined editions, tiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.aggregate import disc_items
from discframe.bindings.registry import query
from discframe.operators import project as p
from discframe.operators import sequence as s
from discframe.plans import editions as e
from discframe.session import cut_lineage

_PRE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_DI = "di AS (SELECT disc_id, title_idx, i.* FROM items i JOIN titles USING (title_id))"


def playlist_titles(spark, sf_dir, clips=4):
    """Titles timed by their items, with the counts that rank duplicates."""
    stats = p.item_stats(b.items(spark, sf_dir, clips)).select("title_id", "runtime")
    return b.titles(spark, sf_dir).join(stats, "title_id").select(
        "disc_id",
        "title_id",
        "title_idx",
        (F.col("runtime") / 50).alias("duration"),
        F.col("priority").alias("n_chapters"),
        (F.col("title_id") % 3).alias("n_streams"),
        (F.col("title_id") % 2).alias("n_tracks"),
    )


@query("c1_dedup_titles", f"""WITH {b.ITEMS4}, {b.TITLES},
q AS (SELECT title_id, list(clip_id ORDER BY pos) AS clips, CAST(round_even(CAST(sum(duration) / 50 AS DOUBLE), 0) AS BIGINT) AS secs FROM items GROUP BY 1),
r AS (SELECT t.*, clips, secs, row_number() OVER (PARTITION BY disc_id, clips, secs ORDER BY priority DESC, t.title_id % 3 DESC, t.title_id % 2 DESC, title_idx) AS r,
  min(title_idx) OVER (PARTITION BY disc_id, clips, secs) AS f, count(*) OVER (PARTITION BY disc_id, clips, secs) AS copies FROM titles t JOIN q USING (title_id))
SELECT disc_id, title_id, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY f) - 1 AS INTEGER) AS new_idx, copies FROM r WHERE r = 1""")
def _(spark, sf_dir):
    return e.dedup_titles(playlist_titles(spark, sf_dir), b.items(spark, sf_dir, 4))


_NOTABLE = b.NOTABLE_SQL.format(minimum=1200, plain=3000)
_EDGES = f"""ca AS (SELECT disc_id, title_id, title_idx, duration AS d, CASE WHEN status = 'F' THEN priority END AS vts FROM facts WHERE n_items > 1 AND (status <> 'F' OR {_NOTABLE})),
pc AS (SELECT disc_id, title_idx, d, vts, coalesce(CAST(vts AS VARCHAR), '') || ':' || clip_id AS clip, sum(duration) AS s FROM items JOIN ca USING (title_id) GROUP BY 1, 2, 3, 4, 5),
tot AS (SELECT disc_id, title_idx, sum(s) AS total FROM pc GROUP BY 1, 2),
pr AS (SELECT a.disc_id, a.title_idx AS u, b.title_idx AS v, any_value(a.vts IS NOT NULL AND b.vts IS NOT NULL) AS chains, count(*) AS shared, sum(b.s) AS footage
  FROM pc a JOIN pc b ON a.disc_id = b.disc_id AND a.title_idx < b.title_idx AND a.clip = b.clip AND abs(a.d - b.d) <= 0.25 * greatest(a.d, b.d) GROUP BY 1, 2, 3),
ed AS (SELECT pr.disc_id, u, v FROM pr JOIN tot x ON x.disc_id = pr.disc_id AND x.title_idx = u JOIN tot y ON y.disc_id = pr.disc_id AND y.title_idx = v
  WHERE shared >= 3 AND (NOT chains OR footage >= 0.5 * least(x.total, y.total)))"""


@query("c2_edition_groups", f"""WITH RECURSIVE {b.CATALOG}, {b.facts_sql(0.9)}, {_EDGES},
nb AS (SELECT s.disc_id, s.title_idx AS i, coalesce(list(v) FILTER (WHERE v IS NOT NULL), []) AS later FROM titles s LEFT JOIN ed ON ed.disc_id = s.disc_id AND ed.u = s.title_idx GROUP BY 1, 2),
g AS (SELECT disc_id, -1 AS i, CAST([] AS INTEGER[]) AS taken, CAST([] AS INTEGER[]) AS found FROM (SELECT DISTINCT disc_id FROM titles)
  UNION ALL
  SELECT g.disc_id, nb.i, CASE WHEN list_contains(taken, nb.i) THEN taken ELSE list_concat(taken, later) END,
    CASE WHEN list_contains(taken, nb.i) THEN CAST([] AS INTEGER[]) ELSE list_filter(later, lambda x: NOT list_contains(taken, x)) END
  FROM g JOIN nb ON nb.disc_id = g.disc_id AND nb.i = g.i + 1)
SELECT disc_id, i AS head, i AS title_idx FROM g WHERE len(found) > 0
UNION ALL SELECT disc_id, i AS head, unnest(found) AS title_idx FROM g WHERE len(found) > 0""")
def _(spark, sf_dir):
    # Finished orders are chains of the title set their priority names; the others are playlists.
    facts = p.title_facts(b.titles(spark, sf_dir), b.streams(spark, sf_dir), b.items(spark, sf_dir))
    chain = F.col("status") == "F"
    titles = facts.withColumns(
        {
            "n_streams": F.col("n_items"),
            "vts": F.when(chain, F.col("priority")),
            "playlist_no": F.when(~chain, F.col("title_idx")),
            "notable": p.notable_flag(F.lit(False), 1200, 3000),
        }
    )
    return e.edition_groups(e.edition_candidates(titles), b.items(spark, sf_dir), share=(1, 2))


def editions(spark, sf_dir):
    """The titles of every disc as its editions, written once: several steps read them."""
    titles = b.titles(spark, sf_dir).select("disc_id", "title_id", "title_idx")
    rows = b.plain_items(spark, sf_dir).join(titles, "title_id").select(
        F.col("disc_id").alias("group_id"), F.col("title_idx").alias("edition"), "title_id", "pos", "clip_id", "duration"
    )
    return cut_lineage(rows)


_EDITIONS = """en AS (SELECT disc_id AS group_id, title_idx AS edition, title_id, pos, clip_id, duration, size FROM di{extra})"""
_UNION = f"""fu AS (SELECT group_id, clip_id, arg_min(duration, edition * 1000000 + pos) AS d, min(edition * 1000000 + pos) AS o FROM en GROUP BY 1, 2),
un AS (SELECT group_id, clip_id, d AS clip_duration, coalesce(sum(d) OVER (PARTITION BY group_id ORDER BY o {_PRE}), 0) AS clip_start FROM fu)"""
_ATOMS = f"""pl AS (SELECT en.group_id, edition, pos, clip_start, clip_duration,
    coalesce(sum(clip_duration) OVER (PARTITION BY en.group_id, edition ORDER BY pos {_PRE}), 0) AS v FROM en JOIN un ON un.group_id = en.group_id AND un.clip_id = en.clip_id),
ch AS (SELECT group_id, edition, t FROM mk),
cu AS (SELECT p.group_id, p.edition, pos, clip_start + t - v AS "end", false AS tail, clip_start FROM pl p JOIN ch c ON c.group_id = p.group_id AND c.edition = p.edition
   AND v + 0.000001 < t AND t <= v + clip_duration + 0.000001),
pi AS (SELECT * FROM cu UNION ALL SELECT group_id, edition, pos, clip_start + clip_duration, true, clip_start FROM pl),
s1 AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY group_id, edition, pos ORDER BY tail, "end"), clip_start) AS "start" FROM pi),
s2 AS (SELECT *, coalesce(lag(tail) OVER w, false) AS hidden, row_number() OVER w - 1 AS i FROM s1 WHERE NOT tail OR "start" < "end" - 0.000001
  WINDOW w AS (PARTITION BY group_id, edition ORDER BY pos, tail, "end")),
atoms AS (SELECT group_id, edition, CAST(i AS INTEGER) AS atom_idx, "start", "end", hidden, CASE WHEN NOT hidden THEN
  printf('Chapter %02d', CAST(sum(CASE WHEN hidden THEN 0 ELSE 1 END) OVER (PARTITION BY group_id, edition ORDER BY i) AS BIGINT)) END AS name FROM s2)"""


def _marks(editions_df):
    """Chapters of an edition: its item starts, and item middles on even clips."""
    offsets = s.with_offsets(s.o.together(editions_df, "group_id"), ["group_id", "edition"], "pos", "duration", "t0")
    middle = F.when(F.col("clip_id") % 2 == 0, F.col("t0") + F.col("duration") / 2)
    times = F.explode(F.array_compact(F.array(F.col("t0"), middle))).alias("t")
    return offsets.select("group_id", "edition", "title_id", times).filter(F.col("t") > 0)


_MARKS = f"""mo AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY group_id, edition ORDER BY pos {_PRE}), 0) AS t0 FROM en),
mk AS (SELECT group_id, edition, title_id, t0 AS t FROM mo WHERE t0 > 0 UNION ALL SELECT group_id, edition, title_id, t0 + duration / 2 FROM mo WHERE clip_id % 2 = 0)"""


@query("c4_edition_atoms", f"""WITH {b.ITEMS}, {b.TITLES}, {_DI}, {_EDITIONS.format(extra="")}, {_UNION}, {_MARKS}, {_ATOMS} SELECT * FROM atoms""")
def _(spark, sf_dir):
    rows = editions(spark, sf_dir)
    return e.edition_atoms(rows, e.union_timeline(rows), _marks(rows).select("group_id", "edition", "t"))


_JUDGE_AT = """tt AS (SELECT disc_id AS group_id, title_idx AS edition, title_id, duration, status = 'P' AS kind FROM titles),
jd AS (SELECT x.group_id, x.edition, x.title_id, CASE WHEN x.kind <> f.kind THEN 'other_kind'
  WHEN (SELECT count(DISTINCT a.clip_id) FROM items a JOIN items z ON z.clip_id = a.clip_id AND z.title_id = f.title_id WHERE a.title_id = x.title_id) < {k} THEN 'few_shared_clips'
  WHEN abs(x.duration - f.duration) > {within} * greatest(x.duration, f.duration) THEN 'other_length' END AS reason
  FROM tt x JOIN tt f ON f.group_id = x.group_id AND f.edition = 0 WHERE x.edition > 0)"""
_JUDGE = _JUDGE_AT.format(k=3, within=0.25)
_JUDGE_LOOSE = _JUDGE_AT.format(k=1, within=0.9)


def _edition_titles(spark, sf_dir):
    titles = b.titles(spark, sf_dir)
    return titles.select(
        F.col("disc_id").alias("group_id"),
        F.col("title_idx").alias("edition"),
        "title_id",
        "duration",
        (F.col("status") == "P").alias("kind"),
    )


@query("c3_validate_editions", f"""WITH {b.ITEMS}, {b.TITLES}, {_JUDGE} SELECT * FROM jd""")
def _(spark, sf_dir):
    return e.validate_editions(_edition_titles(spark, sf_dir), b.items(spark, sf_dir))


@query("c3_combine_editions", f"""WITH {b.ITEMS}, {b.TITLES}, {_DI}, {_JUDGE_LOOSE},
{_EDITIONS.format(extra=" WHERE disc_id NOT IN (SELECT group_id FROM jd WHERE reason IS NOT NULL)")},
{_UNION}, {_MARKS}, {_ATOMS}
SELECT *, edition = 0 AS is_default FROM atoms""")
def _(spark, sf_dir):
    rows = editions(spark, sf_dir)
    marks = s.o.ordered(_marks(rows), "title_id", ["t"], _rn=s.o.row_number()).select(
        "title_id", (F.col("_rn") - 1).alias("mark_idx"), "t"
    )
    atoms, _ = e.combine_editions(_edition_titles(spark, sf_dir), b.items(spark, sf_dir), marks, k=1, within=(9, 10))
    return atoms


@query("c8_tile_sequences", f"""WITH RECURSIVE {b.ITEMS4}, {b.TITLES}, {_DI},
sq AS (SELECT disc_id, clips, min(title_id) AS id FROM (SELECT disc_id, title_id, list(clip_id ORDER BY pos) AS clips FROM di GROUP BY 1, 2) GROUP BY 1, 2),
f AS (SELECT disc_id, id AS parent, clips, 0 AS at0, CAST([] AS BIGINT[]) AS parts, CAST([] AS BIGINT[]) AS lens FROM sq
  UNION ALL
  SELECT f.disc_id, f.parent, f.clips, f.at0 + len(q.clips), list_append(f.parts, q.id), list_append(f.lens, len(q.clips))
  FROM f JOIN sq q ON q.disc_id = f.disc_id AND q.id <> f.parent AND f.clips[f.at0 + 1 : f.at0 + len(q.clips)] = q.clips AND f.at0 + len(q.clips) <= len(f.clips)),
w AS (SELECT disc_id, parent, arg_max(parts, lens) AS parts, max(lens) AS lens FROM f WHERE at0 = len(clips) GROUP BY 1, 2)
SELECT disc_id, parent, CAST(i - 1 AS INTEGER) AS step, parts[i] AS part, CAST(coalesce(list_sum(lens[1 : i - 1]), 0) AS INTEGER) AS "offset" FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM w)""")
def _(spark, sf_dir):
    return e.tile_sequences(disc_items(spark, sf_dir, 4), "disc_id", "title_id", "clip_id")
