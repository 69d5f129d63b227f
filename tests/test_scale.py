"""Plans whose work has to spread over tasks, and whose building must not run them."""

import os
import re
import time

from pyspark.sql import functions as F

from discframe.bindings import QUERIES, streaming
from discframe.bindings import tables as b
from discframe.operators import heavy, joins
from discframe.plans import chains, editions, episodes
from discframe.session import cut_lineage, cut_result, shared_folder
from discframe.sources import documents as d
from discframe.sources import sinks
from discframe.streaming import jobs

XML = (
    '<Playlist><TitleSet timeBase="60fps"><Title titleNumber="{n}" titleDuration="00:00:02:00" id="T{n}">'
    '<PrimaryAudioVideoClip titleTimeBegin="00:00:00:00" titleTimeEnd="00:00:01:00" src="file:///d/C{n}.MAP"/>'
    '<ChapterList><Chapter titleTimeBegin="00:00:01:00"/><Chapter titleTimeBegin="00:00:00:00"/></ChapterList></Title></TitleSet></Playlist>'
)


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        time.sleep(0.5)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_playlists_are_not_parsed_while_plans_are_built(spark):
    rows = [(i, XML.format(n=i)) for i in (1, 2, 2)] + [(None, XML.format(n=5))]
    docs = heavy.marked(spark.createDataFrame(rows, "doc long, xml string"), {"doc": 2})
    tables, jobs = _jobs(spark, "playlists", lambda: d.parse_playlists(docs, "xml", "doc"))
    assert jobs == 0
    marks = sorted(map(tuple, tables["marks"].collect()), key=str)
    second = [(2, 2, i, t) for i, t in enumerate((0.0, 0.0, 1.001, 1.001))]
    found = [(k, n, i, round(t, 6)) for k, n, i, t in marks]
    assert found == sorted([(1, 1, 0, 0.0), (1, 1, 1, 1.001), *second, (None, 5, 0, 0.0), (None, 5, 1, 1.001)], key=str)


def test_one_file_is_spread_over_tasks(spark):
    few = spark.range(0, 101, 1, 1)
    dealt = b.spread(few, 25)
    assert dealt.groupBy(F.spark_partition_id()).count().count() == 5 and dealt.distinct().count() == 101
    assert b.spread(few.filter("id < 0")).collect() == []


def test_a_query_meets_two_movies_of_its_name(spark):
    movies = spark.createDataFrame(
        [("a", 10 + y, y, 100 - y) for y in range(40)] + [("a", 5, None, 99), ("b", 7, None, 1), (None, 8, 3, 1)],
        "name string, movie_id long, year int, rank long",
    )
    queries = spark.createDataFrame(
        [(1, "a", 3), (2, "a", 77), (3, "a", None), (4, "b", 1), (5, None, 3), (6, "c", 1), (7, "a", 77), (7, "a", 4)],
        "query_id long, name string, year int",
    )
    best = joins.best_movie(queries, movies)
    want = [(1, 13, True), (2, 49, False), (3, 49, False), (4, 7, False), (7, 14, True)]
    assert sorted(map(tuple, best.collect())) == want
    # Two joins, and no row per year of a name.
    joined = best._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Join ") == 2 and "LeftOuter" in joined


def test_catalog_queries_sort_small_partitions(spark):
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.unset(names[0])
        spark.conf.set(names[1], "7")
        out = QUERIES["u5_all_disjoint"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(names[0]) == "16m" and spark.conf.get(names[1]) == "7"
        # More partitions than the session's four: what a task sorts does not grow with the tables.
        assert out.count() > 0 and "hashpartitioning" in out._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset(names[1])
        again = QUERIES["u5_all_disjoint"](spark, "/root/testdata/sf0.001")
        assert ", 1000)" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def test_plans_over_editions_know_their_heavy_keys(spark, monkeypatch):
    real, unknown = heavy.peak, []

    def peak(df, key):
        found = real(df, key)
        if found is None:
            unknown.append(key)
        return found

    monkeypatch.setattr(heavy, "peak", peak)
    for name in ("c4_edition_atoms", "s12_chapters_xml"):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        # Nothing is counted while the plan is built, and line items were read once, before.
        assert unknown == [] and "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tiling_offers_windows_by_their_first_item(spark, monkeypatch):
    rows = [("d", t, p, c) for t, clips in enumerate(("ab", "abab", "ba", "abba", "cab", "c", "ccc")) for p, c in enumerate(clips)]
    items = spark.createDataFrame(rows, "d string, t long, pos int, clip string")
    written = []
    monkeypatch.setattr(editions, "cut_lineage", lambda df: written.append(df) or df)
    tiles = editions.tile_sequences(items, "d", "t", "clip")
    found = sorted((r.parent, r.step, r.part, r.offset) for r in tiles.collect())
    want = [(1, 0, 0, 0), (1, 1, 0, 2), (3, 0, 0, 0), (3, 1, 2, 2), (4, 0, 5, 0), (4, 1, 0, 1)]
    assert found == sorted([*want, *[(6, i, 5, i) for i in range(3)]])
    # Checksums of a place are long integers, and a window of another first item is not made.
    assert dict(written[1].dtypes)["_s"] == dict(written[1].dtypes)["_t"] == "bigint" and "_first" in written[1].columns


def test_episodes_read_line_items_once(spark):
    for name in ("c5_playlist_episodes", "c6_chain_episodes"):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "l_suppkey" not in out._jdf.queryExecution().optimizedPlan().toString(), name


def test_chains_and_tracks_read_line_items_once(spark):
    for name in ("c11_settle_protection", "j1_map_tracks", "c18_classify_catalog"):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "l_linenumber" not in out._jdf.queryExecution().optimizedPlan().toString(), name


def _tables(spark):
    folder = f"{shared_folder(spark)}/discframe-tables/{spark.sparkContext.applicationId}"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(f) for f in disk.localDirsString()]
    return {n for top in folders for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    kept = cut_lineage(spark.range(1000).groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and kept.count() == 7


def test_a_result_takes_the_tables_on_the_way_with_it(spark):
    before = _tables(spark)

    def inner():
        return cut_lineage(spark.range(9)).union(cut_lineage(spark.range(2)))

    out = cut_result(lambda: cut_result(inner).join(cut_lineage(spark.range(5)), "id"))
    assert len(_tables(spark) - before) == 1 and out.count() == 7


def test_classification_leaves_few_tables(spark):
    before = _tables(spark)
    out = QUERIES["c18_classify_catalog"](spark, "/root/testdata/sf0.001")
    # Listed titles and the count of packed episodes: every step took the tables before with it.
    assert len(_tables(spark) - before) == 2 and out.count() > 0


def test_line_items_in_order_of_what_is_read(spark, tmp_path):
    rows = [(1, p, s, n, q, x) for x in (2.0, 1.0) for n in (2, 1, None) for p, s, q in ((5, 7, 3.0), (5, None, 3.0), (4, 7, None))]
    rows += [(None, 1, 1, 1, 1.0, 1.0), (2, 9, 9, 1, 5.0, 1.0)]
    named = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    df = spark.createDataFrame(rows, named).selectExpr(
        "*", "0.0D l_discount", "0.0D l_tax", "'A' l_returnflag", "'F' l_linestatus", "timestamp'1995-01-01' l_shipdate"
    )
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    read = ["l_partkey", "l_suppkey", "l_quantity"]
    every, fewer = b.lines(spark, str(tmp_path)), b.lines(spark, str(tmp_path), read)
    same = [sorted(map(str, t.select("l_orderkey", "pos", *read).collect())) for t in (every, fewer)]
    assert same[0] == same[1] and len(same[0]) == len(rows)
    # What cannot change these rows is not shuffled.
    assert "l_extendedprice" not in fewer.columns and "l_tax" not in fewer.columns


def test_protection_deals_discs_once(spark):
    rows = [(1, i, 100.0, v, s) for i, (v, s) in enumerate(((1, 1), (1, 1), (None, 2), (None, 2), (2, None), (2, None)))]
    rows += [(None, 10 + i, 100.0, 1, 1) for i in range(2)] + [(2, 20, 100.0, 1, 1)]
    df = spark.createDataFrame(
        [(*r[:3], r[3], r[1], 0, False, 1, r[4], 1, None, None, False) for r in rows],
        "disc_id int, title_id int, duration double, vts int, chain_pgc int, backward_jumps int, padded boolean, "
        "n_cells int, cells_sig int, tracks_sig int, episode int, part string, play_all boolean",
    )
    found = {}
    for limit in ("1000", "1"):
        spark.conf.set("spark.discframe.groupRows", limit)
        try:
            settled = chains.settle_protection(df)
            found[limit] = sorted((r.title_id, r.decoy, r.duplicate) for r in settled.collect())
            if limit == "1000":
                plan = settled._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
                assert plan.count("hashpartitioning(") == 1, plan
        finally:
            spark.conf.unset("spark.discframe.groupRows")
    # Chains of an unknown disc or with unknown cells are nobody's duplicate.
    assert found["1000"] == found["1"] == [(r[1], False, r[1] in (1, 3)) for r in rows]


def test_chapters_deal_groups_once(spark):
    out = QUERIES["s12_chapters_xml"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((\w+)#\d+L?, \d+\), (\w+)", plan)
    assert set(dealt) == {("group_id", "REPARTITION_BY_COL")} and plan.count("hashpartitioning") == len(dealt), plan


def _either_plan(spark, run):
    """What *run* returns while groups are small, and while every group is hot."""
    out = []
    for limit in ("1000", "1"):
        spark.conf.set("spark.discframe.groupRows", limit)
        try:
            out.append(sorted(map(str, run().collect())))
        finally:
            spark.conf.unset("spark.discframe.groupRows")
    return out


def test_atoms_of_unknown_clips_in_either_plan(spark):
    rows = [(1, e, p, c, d) for e, clips in enumerate(((7, 8, None), (8, None, 7, 9), (9,))) for p, (c, d) in enumerate((x, 10.0 + (x or 1)) for x in clips)]
    rows += [(None, 0, 0, 7, 5.0), (2, 0, 0, 7, 5.0)]
    items = spark.createDataFrame(rows, "group_id long, edition int, pos int, clip_id long, duration double")
    marks = spark.createDataFrame([(1, 0, 4.0), (1, 0, 17.0), (1, 1, 18.0), (None, 0, 2.0), (2, 0, 5.0)], "group_id long, edition int, t double")
    union = editions.union_timeline(items)
    small, hot = _either_plan(spark, lambda: editions.edition_atoms(items, union, marks))
    # Clips nobody can name keep their place on the timeline and are not played.
    assert small == hot and len(small) == 8 and not any("group_id=None" in r for r in small)


def test_lines_of_chapters_in_either_plan(spark):
    rows = [(g, e, a, float(a), a + 1.0, a == 1, f"Chapter {a}") for g, e, n in ((1, None, 1), (1, 0, 3), (1, 4, 1), (2, 3, 2)) for a in range(n)]
    atoms = spark.createDataFrame(rows, "group_id long, edition int, atom_idx int, start double, end double, hidden boolean, name string")
    small, hot = _either_plan(spark, lambda: sinks.chapters_xml(atoms))
    assert small == hot
    found = {}
    for r in sinks.chapters_xml(atoms).orderBy("group_id", "line_no").collect():
        found.setdefault(r.group_id, []).append((r.line_no, r.line))
    assert [[n for n, _ in lines] for lines in found.values()] == [list(range(11)), list(range(4))]
    kinds = [["-" if x is None else re.sub(r"<EditionEntry>.*", "E", re.sub(r"<ChapterAtom><ChapterUID>(\d+).*", r"\1", x)) for _, x in lines] for lines in found.values()]
    close, last = "</EditionEntry>", "</EditionEntry></Chapters>"
    assert kinds[0] == ["-", "1001", close, "<Chapters>E", "1002", "1003", "1004", close, "E", "1005", last]
    assert kinds[1] == ["<Chapters>E", "1001", "1002", last]


def _chain_sets(spark, sets):
    """Chains and cells of ``{set: {pgc: [(cell, seconds), ..]}}``."""
    chains = [(s, p, float(sum(x for _, x in c)), len(c), False) for s, of in sets.items() for p, c in of.items()]
    cells = [(s, p, i, c, x) for s, of in sets.items() for p, cs in of.items() for i, (c, x) in enumerate(cs)]
    return (
        spark.createDataFrame(chains, "set_id long, pgc long, duration double, n_cells long, angle boolean"),
        spark.createDataFrame(cells, "set_id long, pgc long, pos int, cell long, seconds double"),
    )


def test_rounds_of_chain_sets_meet_only_sets_in_doubt(spark, monkeypatch):
    own = lambda p, x: [(100 * p + i, x / 4) for i in range(4)]
    three = {p: own(p, 1200.0 + p) for p in (1, 2, 3)}
    every = [c for p in three for c in three[p]]
    short = {p: own(p, 200.0 + p) for p in (11, 12)}
    sets = {
        1: three,  # alike, nothing else
        2: three | {9: own(9, 9000.0)},  # dwarfed by a film
        3: three | {9: every},  # with their play-all
        4: three | {8: own(8, 9000.0), 9: every},
        5: three | short | {9: every + [c for p in short for c in short[p]]},  # siblings join
        6: {p: own(p, x) for p, x in ((1, 1000.0), (2, 1100.0), (3, 4000.0), (4, 4100.0), (5, 4200.0))},
    }
    taken = []
    real = episodes._merge_siblings
    monkeypatch.setattr(episodes, "_merge_siblings", lambda decided, *rest: taken.append(decided) or real(decided, *rest))
    roles = episodes.label_chain_episodes(*_chain_sets(spark, sets))
    found = sorted(map(tuple, roles.collect()))
    want = [(s, p, "episode") for s in (1, 3) for p in (1, 2, 3)] + [(s, 9, "play_all") for s in (3, 5)]
    want += [(5, p, "episode") for p in (1, 2, 3, 11, 12)] + [(6, p, "episode") for p in (3, 4, 5)]
    assert found == sorted(want)
    assert {r.set_id for r in taken[0].collect()} == {5}


def test_streams_that_aggregate_have_few_batches(spark, monkeypatch):
    monkeypatch.setattr(streaming, "SLICE_ROWS", 100)
    out = {}
    for batches in (None, 3):
        source = streaming.event_stream(spark, "/root/testdata/sf0.001", batches)
        folder = f"{shared_folder(spark)}/few-{batches}"
        jobs.run_available(jobs.stalled(streaming._without_marks(source), "2 hours", streaming.DELAY), folder)
        commits = [n for n in os.listdir(f"{folder}/state/commits") if n.isdigit()]
        out[batches] = len(commits), sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
    assert out[3][0] <= 6 < out[None][0] and out[3][1] == out[None][1]
