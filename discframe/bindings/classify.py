"""The flagship query: classify every title of every disc."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.plans import _EPISODES, packed_sql, supplier_items
from discframe.bindings.registry import query
from discframe.operators import aggregate as a
from discframe.operators import ordered as o
from discframe.operators import project as p
from discframe.operators import sequence as s
from discframe.plans.classify import Thresholds, classify_catalog
from discframe.plans.packed import Rules
from discframe.session import cut_lineage, cut_result, drop_written

#: Marks of short titles: two short segments of a kind make a cycle.
PACKED = Rules(short=40, bucket=25, min_episode=0, max_episode=1e12, spread=0.9, min_cycles=2, lead_match=15, snap=40)
LIMITS = Thresholds(
    listed=1200, plain=3000, short=900, empty_bytes=4_000_000, minimum=600, films=5, jumps=2, packed=PACKED
)
_NOTABLE = b.NOTABLE_SQL.format(minimum=1200, plain=3000)

_MARKS = """SELECT title_id, pos AS i0, CAST(coalesce(sum(items.duration) OVER (PARTITION BY title_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS t,
  titles.duration FROM items JOIN titles USING (title_id) WHERE disc_id % 4 = 1"""

# Every fourth disc is a series with labelled chains, another fourth holds playlists.
CLASSIFY_SQL = f"""WITH RECURSIVE {b.CATALOG4}, {b.facts_sql(0.9)},
fp AS (SELECT title_id, list(clip_id ORDER BY pos) AS cells FROM items GROUP BY 1),
jp AS (SELECT title_id, count(*) FILTER (WHERE part_id < pv) AS jumps FROM (SELECT *, lag(part_id) OVER (PARTITION BY title_id ORDER BY pos) AS pv FROM items) GROUP BY 1),
c0 AS (SELECT f.*, jumps, cells, f.title_id % 2 AS tr, CASE WHEN status = 'F' AND disc_id % 4 = 0 THEN title_idx + 1 END AS ep0, status <> 'F' AND priority = 1 AND disc_id % 4 = 0 AS pa0 FROM facts f JOIN fp USING (title_id) JOIN jp USING (title_id)),
c1 AS (SELECT *, duration >= 0.5 * max(duration) OVER (PARTITION BY disc_id) AS film FROM c0),
c2 AS (SELECT *, film AND jumps >= 2 AND count(*) FILTER (WHERE film) OVER (PARTITION BY disc_id) >= 5 AND bool_or(film AND jumps = 0) OVER (PARTITION BY disc_id) AS decoy FROM c1),
c3 AS (SELECT *, count(*) FILTER (WHERE NOT decoy AND status <> 'P') OVER (PARTITION BY disc_id, priority) AS exact FROM c2),
c4 AS (SELECT *, NOT decoy AND row_number() OVER (PARTITION BY disc_id, cells, round_even(duration, 0), tr, CASE WHEN n_items < 3 THEN priority ELSE -1 END, decoy ORDER BY status = 'P', exact DESC, priority, title_idx, title_id) > 1 AS duplicate FROM c3),
c5 AS (SELECT *, CASE WHEN NOT decoy AND NOT duplicate THEN ep0 END AS ep1, pa0 AND NOT decoy AND NOT duplicate AS pa, {_NOTABLE} AND NOT decoy AND NOT duplicate AS notable,
  CASE WHEN looped THEN 'Menu loop' WHEN duration <= 0 OR (bytes > 0 AND bytes < 4000000) THEN 'Empty' WHEN duration < 900 THEN 'Short clip' END AS sl FROM c4),
c6 AS (SELECT *, max(CASE WHEN ep1 IS NOT NULL AND NOT pa THEN duration END) OVER w AS longest, max(CASE WHEN ep1 IS NULL AND NOT pa THEN duration END) OVER w AS rival FROM c5 WINDOW w AS (PARTITION BY disc_id)),
c7 AS (SELECT *, CASE WHEN ep1 IS NOT NULL AND NOT pa AND coalesce(rival >= 3 * longest, false) THEN NULL ELSE ep1 END AS ep2, status = 'O' AS ie, CASE WHEN disc_id % 4 <> 1 THEN priority * 10 + title_idx // 2 END AS number, CASE WHEN disc_id % 4 = 1 THEN title_idx END AS playlist_no FROM c6),
cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disc_id, number ORDER BY title_idx) AS r FROM c7 WHERE ep2 IS NULL AND NOT pa AND NOT ie AND duration >= 600 AND number IS NOT NULL) WHERE r = 1),
nn AS (SELECT x.disc_id, x.title_idx, x.duration AS v, count(*) AS near FROM cd x JOIN cd y ON x.disc_id = y.disc_id AND abs(x.duration - y.duration) * 100 <= 15 * greatest(x.duration, y.duration, 1) GROUP BY 1, 2, 3),
bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY near DESC, title_idx) AS r FROM nn) WHERE r = 1 AND near >= 3),
cg AS (SELECT cd.* FROM cd JOIN bc ON bc.disc_id = cd.disc_id AND abs(cd.duration - v) * 100 <= 15 * greatest(cd.duration, v, 1)),
cl AS (SELECT disc_id, max(duration) AS top FROM cg GROUP BY 1),
cr AS (SELECT DISTINCT t.disc_id FROM c7 t JOIN cl USING (disc_id) WHERE NOT pa AND duration >= 600 AND duration >= 3 * top AND NOT EXISTS (SELECT 1 FROM cg WHERE cg.disc_id = t.disc_id AND cg.number = t.number)),
cx AS (SELECT title_id, row_number() OVER (PARTITION BY disc_id ORDER BY number) AS ce FROM cg WHERE disc_id NOT IN (SELECT disc_id FROM cr)),
c8a AS (SELECT c7.*, CAST(coalesce(ep2, ce) AS INTEGER) AS episode FROM c7 LEFT JOIN cx USING (title_id)),
sup AS (SELECT l_orderkey AS title_id, pos, l_suppkey AS clip_id FROM lines),
sq AS (SELECT title_id, list(clip_id ORDER BY pos) AS clips FROM sup GROUP BY 1),
pt AS (SELECT c.disc_id, c.title_id, c.title_idx, c.duration, clips, playlist_no, priority // 3 AS layout, notable AND NOT looped AS content,
  notable AND NOT looped AND episode IS NULL AND NOT pa AND playlist_no IS NOT NULL AND duration >= 600 AS candidate FROM c8a c JOIN sq USING (title_id)),
{_EPISODES},
c8 AS (SELECT c8a.* REPLACE (coalesce(c8a.episode, labels.episode) AS episode, pa OR coalesce(labels.play_all, false) AS pa) FROM c8a LEFT JOIN labels USING (title_id)),
{packed_sql(_MARKS, PACKED)},
pe AS (SELECT title_id, count(episode) AS packed_episodes FROM segments GROUP BY 1),
c9 AS (SELECT *, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY CASE WHEN notable THEN 0 ELSE 1 END, CASE WHEN pa THEN 2 WHEN episode IS NOT NULL THEN 0 ELSE 1 END, coalesce(episode, 0), '', 0, priority * 1000 + title_idx, -duration, title_idx) - 1 AS INTEGER) AS ni FROM c8),
mr AS (SELECT disc_id, title_id, row_number() OVER (PARTITION BY disc_id ORDER BY NOT notable, duration < 600, CASE WHEN duration >= 600 THEN -(n_audio + n_sub) END, CASE WHEN duration >= 600 THEN -CAST(priority <> 3 AS INTEGER) END,
  CASE WHEN duration >= 600 THEN -n_items END, CASE WHEN duration >= 600 THEN coalesce(playlist_no, 0) END, CASE WHEN duration >= 600 THEN -duration END, ni) AS r FROM c9),
mv AS (SELECT m.disc_id, c.priority AS mvts, c.duration AS md, m.title_id AS mid FROM mr m JOIN c9 c USING (title_id) WHERE m.r = 1),
e1 AS (SELECT c.*, mid, priority = mvts AS inm, bool_or(episode IS NOT NULL OR pa) OVER (PARTITION BY c.disc_id) AS series, abs(duration - md) <= 0.1 * md AS near FROM c9 c LEFT JOIN mv USING (disc_id)),
e2 AS (SELECT *, inm AND NOT series AND notable AND (ie OR near) AS ver FROM e1),
e3 AS (SELECT *, count(*) FILTER (WHERE ver) OVER (PARTITION BY disc_id) AS n, CAST(sum(CASE WHEN ver THEN 1 ELSE 0 END) OVER (PARTITION BY disc_id ORDER BY title_idx, title_id) AS BIGINT) AS no FROM e2),
e4 AS (SELECT *, CASE WHEN ver AND n >= 2 THEN no END AS edition_no, max(coalesce(episode, 0)) OVER (PARTITION BY disc_id) AS top FROM e3),
e5 AS (SELECT *, CASE WHEN edition_no IS NOT NULL THEN 'Edition ' || edition_no WHEN priority > 1 THEN 'PGC ' || (priority - 1) END AS el, 'Customer#' || lpad(CAST(disc_id AS VARCHAR), 9, '0') AS base FROM e4)
SELECT disc_id, title_id, ni AS title_idx, CASE WHEN episode IS NOT NULL THEN base || ' - Episode ' || lpad(CAST(episode AS VARCHAR), CAST(length(CAST(greatest(top, 1) AS VARCHAR)) AS INTEGER), '0') WHEN pa THEN base || ' - Play All'
  WHEN decoy THEN base || ' - Decoy' WHEN duplicate THEN base || ' - Duplicate' WHEN sl IS NOT NULL THEN base || ' - ' || sl WHEN status = 'O' AND el IS NOT NULL THEN base || ' - ' || el ELSE base END AS name,
  notable, decoy, duplicate, episode, pa AS play_all, edition_no, packed_episodes, title_id = mid AS is_main FROM e5 LEFT JOIN pe USING (title_id)"""


@query("c18_classify_catalog", CLASSIFY_SQL)
def _(spark, sf_dir):
    # Steps that need the order of line items read it from here.
    placed = cut_lineage(supplier_items(spark, sf_dir, "l_partkey"))
    discs = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("disc_id"),
        F.col("c_name").alias("disc_name"),
        F.lit("").alias("source_name"),
        F.lit("").alias("parent_name"),
    )
    marks = s.with_offsets(placed, "title_id", "pos", "seconds", "t").select("title_id", F.col("pos").alias("mark_idx"), "t")
    classified = classify_catalog(
        lambda: cut_result(lambda: _chains(spark, sf_dir, placed)), discs, placed.drop("l_partkey"), marks, LIMITS
    )
    drop_written(placed)
    return classified.drop("part")


def _chains(spark, sf_dir, placed):
    """Every title as a chain with the facts of its tracks, its items and their order."""
    titles = b.titles(spark, sf_dir)
    items = b.items(spark, sf_dir, 4)
    facts = cut_result(lambda: p.title_facts(titles, b.streams(spark, sf_dir), items, write=True).drop("runtime"))
    order = placed.select("title_id", "pos", (F.col("clip_id") % 4).alias("clip_id"), F.col("l_partkey").alias("part_id"))
    fingerprint = a.layout_signature(order, "title_id", ["pos"], ["clip_id"])
    back = o.ordered(order, "title_id", ["pos"], _prev=o.lag("part_id")).groupBy("title_id").agg(
        F.count_if(F.col("part_id") < F.col("_prev")).alias("backward_jumps")
    )
    series, listed = F.col("disc_id") % 4 == 0, F.col("disc_id") % 4 == 1
    return (
        facts.join(fingerprint, "title_id")
        .join(back, "title_id")
        .withColumns(
            {
                "vts": F.col("priority"),
                "chain_pgc": F.col("title_idx"),
                "padded": F.col("status") == "P",
                "n_cells": F.col("n"),
                "cells_sig": F.struct("n", "sig_a", "sig_b"),
                "tracks_sig": F.col("title_id") % 2,
                "episode": F.when((F.col("status") == "F") & series, F.col("title_idx") + 1),
                "part": F.lit(None).cast("string"),
                "play_all": (F.col("status") != "F") & (F.col("priority") == 1) & series,
                "number": F.when(~listed, F.col("priority") * 10 + F.floor(F.col("title_idx") / 2)),
                "layout": F.floor(F.col("priority") / 3),
                "source_pos": F.col("priority") * 1000 + F.col("title_idx"),
                "playlist_no": F.when(listed, F.col("title_idx").cast("long")),
                "is_edition": F.col("status") == "O",
                "was_chain": F.col("status") == "O",
                "pgc_number": F.col("priority") - 1,
                "remote_main": F.lit(False),
                "authorial": F.lit(False),
                "default_edition": F.col("priority") != 3,
                "n_chapters": F.col("n_items"),
                "secondary": F.lit(False),
                "keep_name": F.lit(False),
                "name": F.lit(""),
            }
        )
        .drop("n", "sig_a", "sig_b", "status")
    )
