"""Registered source and sink queries (documents are built from table rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.editions import editions, _marks
from discframe.bindings.registry import query
from discframe.operators import aggregate as a
from discframe.operators import project as p
from discframe.operators import sequence as s
from discframe.plans import editions as e
from discframe.sources import documents as d
from discframe.sources import files as f
from discframe.sources import sinks as k

_PRE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("s2_playlist_clips", """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS h, o_orderkey % 60 AS m, o_orderkey % 59 AS s FROM orders)
SELECT o_orderkey, CAST(o_orderkey % 40 AS INTEGER) AS title_number, pos, 'C' || o_orderkey || '_' || pos || '.evo' AS clip, CASE WHEN pos = 0 THEN 0.0 ELSE (m * 60 + s) * 60 * 1001 / 60000.0 END AS begin,
  CASE WHEN pos = 0 THEN (m * 60 + s) * 60 * 1001 / 60000.0 ELSE ((h * 3600 + m * 60 + s) * 60 + 5) * 1001 / 60000.0 END AS "end", pos = 1 AS seamless
FROM o, (VALUES (0), (1)) v(pos)""")
def _(spark, sf_dir):
    return _playlists(spark, sf_dir)["clips"].withColumnRenamed("doc", "o_orderkey")


def _playlists(spark, sf_dir):
    """One small playlist document per order."""
    key = F.col("o_orderkey")
    mid = F.format_string("00:%02d:%02d:00", key % 60, key % 59)
    end = F.format_string("%02d:%02d:%02d:05", key % 3, key % 60, key % 59)
    doc = F.format_string(
        '<Playlist><MediaAttributeList><AudioAttributeItem index="1" codec="DD+"/></MediaAttributeList><TitleSet timeBase="60fps" defaultLanguage="en">'
        '<Title titleNumber="%d" titleDuration="%s" id="T%d" displayName="%s"><PrimaryAudioVideoClip titleTimeBegin="00:00:00:00" titleTimeEnd="%s" src="file:///d/C%d_0.MAP">'
        '<Video track="1"/><Audio track="1" streamNumber="2" mediaAttr="1" description="French commentary"/><Subtitle track="1"/></PrimaryAudioVideoClip>'
        '<PrimaryAudioVideoClip titleTimeBegin="%s" titleTimeEnd="%s" src="file:///d/C%d_1.MAP" seamless="true"><Video track="1"/></PrimaryAudioVideoClip>'
        '<TrackNavigationList><SubtitleTrack track="1" langcode="fr:09"/></TrackNavigationList>'
        '<ChapterList><Chapter titleTimeBegin="%s"/><Chapter titleTimeBegin="00:00:00:00"/></ChapterList></Title></TitleSet></Playlist>',
        key % 40, end, key, F.col("o_orderpriority"), mid, key, mid, end, key, mid,
    )
    orders = b.spread(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))
    return d.parse_playlists(orders.select(key.alias("doc"), doc.alias("xml")), "xml", "doc")


@query("s2_playlist_streams", """SELECT o_orderkey, pos, kind, lang, codec, is_forced, is_commentary, sub_id FROM orders,
(VALUES (0, 'video', 'eng', '', false, false, NULL), (0, 'audio', 'fra', 'DD+', false, true, 193), (0, 'subtitle', 'fra', '', true, false, NULL), (1, 'video', 'eng', '', false, false, NULL)) v(pos, kind, lang, codec, is_forced, is_commentary, sub_id)""")
def _(spark, sf_dir):
    rows = _playlists(spark, sf_dir)["streams"].withColumnRenamed("doc", "o_orderkey")
    return rows.select("o_orderkey", "pos", "kind", "lang", "codec", "is_forced", "is_commentary", "sub_id")


@query("s2_longest_playlist", """WITH t AS (SELECT o_custkey, o_orderkey, (o_orderkey % 3 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 59) * 60 + 5 AS fr FROM orders)
SELECT o_custkey AS group_id, arg_min(o_orderkey, struct_pack(f := -fr, k := CAST(o_orderkey AS VARCHAR))) AS doc, max(fr) * 1001 / 60000.0 AS longest FROM t GROUP BY 1""")
def _(spark, sf_dir):
    owners = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), "o_custkey")
    titles = _playlists(spark, sf_dir)["titles"].join(owners, "doc")
    return d.choose_playlist(titles, F.col("o_custkey"), "doc")


@query("s3_disc_xml", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Show - ' || c_name WHEN c_custkey % 3 = 1 THEN c_name END AS disc_name,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(100000000000 + c_custkey AS VARCHAR) ELSE 'No. ' || c_custkey END AS catalog_number FROM customer""")
def _(spark, sf_dir):
    key = F.col("c_custkey")
    name = (
        F.when(key % 3 == 0, F.concat(F.lit("Show\n"), F.col("c_name")))
        .when(key % 3 == 1, F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
        .otherwise("BD-ROM")
    )
    number = F.when(key % 2 == 0, F.concat(F.lit("100-000-"), F.lpad(key.cast("string"), 6, "0"))).otherwise(
        F.concat(F.lit("No. "), key.cast("string"))
    )
    doc = F.concat(
        F.lit('<?xml version="1.0"?><disclib><di:discinfo><di:title><di:name>Blu-ray</di:name><di:name>'), name,
        F.lit("</di:name></di:title><catalogNumber>"), number, F.lit("</catalogNumber></di:discinfo></disclib>"),
    )
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", doc.alias("xml"), F.lit("bdmt_eng.xml").alias("file"))
    return d.read_disc_xml(rows, "xml", "c_custkey", "file")


@query("s4_event_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf_dir):
    parsed = b.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return parsed.select("event_id", "p.k")


@query("s4_flatten_catalog", f"""WITH {b.TITLES}
SELECT disc_id, title_id, 0 AS item_no, CAST(disc_id % 2 AS INTEGER) AS disc_no, 'f' || title_idx AS source_key, CAST(title_idx * 60 + 5 AS DOUBLE) AS duration, CASE WHEN title_idx = 0 THEN 'MainMovie' END AS item_type FROM titles""")
def _(spark, sf_dir):
    entry = F.struct(
        F.col("title_idx").alias("index"),
        F.concat(F.lit("0:"), F.col("title_idx").cast("string"), F.lit(":05")).alias("duration"),
        F.concat(F.lit("F"), F.col("title_idx").cast("string")).alias("sourceFile"),
        F.struct(F.when(F.col("title_idx") == 0, "MainMovie").alias("type")).alias("item"),
    )
    empty = F.struct(F.lit(9).alias("index"), F.array().cast("array<struct<index:int,duration:string,sourceFile:string,item:struct<type:string>>>").alias("titles"))
    disc = F.struct(F.lit(0).alias("index"), F.array(entry).alias("titles"))
    discs = F.when(F.col("disc_id") % 2 == 1, F.array(empty, disc)).otherwise(F.array(disc))
    doc = F.to_json(F.array(F.struct(F.lit("x").alias("title"), F.array(F.struct(discs.alias("discs"))).alias("releases"))))
    rows = b.titles(spark, sf_dir).select("disc_id", "title_id", F.struct("disc_id", "title_id").alias("k"), doc.alias("doc"))
    flat = d.flatten_catalog(rows, "doc", "k").filter(F.col("title_no").isNotNull())
    return flat.select("k.*", "item_no", "disc_no", "source_key", "duration", "item_type")


@query("s5_streams_from_probe", f"""WITH {b.STREAMS}
SELECT title_id, pos, type, CASE codec WHEN 'c0' THEN 'truehd' ELSE codec END AS codec, lang, is_default, pid AS source_number, CASE WHEN type = 'video' THEN height * 2 END AS width,
  CASE WHEN type = 'audio' THEN channels END AS channels, 0 AS type_index FROM streams""")
def _(spark, sf_dir):
    rows = b.streams(spark, sf_dir)
    track = F.struct(
        F.col("pos").alias("id"),
        F.when(F.col("type") == "subtitle", "subtitles").otherwise(F.col("type")).alias("type"),
        "codec",
        F.struct(
            F.col("pid").alias("number"),
            F.when(F.col("lang") != "und", F.col("lang")).alias("language"),
            F.col("is_default").alias("default_track"),
            F.concat((F.col("height") * 2).cast("string"), F.lit("x"), F.col("height").cast("string")).alias("pixel_dimensions"),
            F.col("channels").alias("audio_channels"),
        ).alias("properties"),
    )
    buttons = F.struct(
        F.lit(99).alias("id"), F.lit("buttons").alias("type"), F.lit("b").alias("codec"),
        F.lit(None).cast(rows.select(track.alias("t")).schema["t"].dataType["properties"].dataType).alias("properties"),
    )
    docs = rows.select(F.struct("title_id", "pos").alias("k"), F.to_json(F.struct(F.array(buttons, track).alias("tracks"))).alias("doc"))
    found = d.streams_from_probe(docs, "doc", "k", codecs={"c0": "truehd"}).drop("pos")
    return found.select("k.*", "type", "codec", "lang", "is_default", "source_number", "width", "channels", "type_index")


@query("s6_classify_source", f"""WITH {b.FILES},
m AS (SELECT group_id, CASE length(group_id) % 5 WHEN 0 THEN CASE WHEN page_id % 3 = 0 THEN 'VIDEO_TS/' ELSE '' END WHEN 1 THEN CASE WHEN page_id % 4 = 0 THEN 'BDMV/' ELSE '' END ELSE 'd/' END
  || page_id || CASE WHEN length(group_id) % 5 = 2 AND page_id % 2 = 0 THEN '.M2TS' WHEN length(group_id) % 5 = 3 THEN '.evo' ELSE '.iso' END AS path FROM files)
SELECT group_id, CASE WHEN bool_or(starts_with(path, 'VIDEO_TS/')) THEN 'dvd' WHEN bool_or(starts_with(path, 'BDMV/')) THEN 'bluray' WHEN bool_or(ends_with(path, '.M2TS')) THEN 'bluray_raw'
  WHEN bool_or(ends_with(path, '.evo')) THEN 'hddvd_raw' WHEN bool_or(NOT contains(path, '/') AND ends_with(path, '.iso')) THEN 'iso_unknown' ELSE 'unknown' END AS source_type FROM m GROUP BY 1""")
def _(spark, sf_dir):
    kind, page = F.length("group_id") % 5, F.col("page_id")
    folder = (
        F.when(kind == 0, F.when(page % 3 == 0, "VIDEO_TS/").otherwise(""))
        .when(kind == 1, F.when(page % 4 == 0, "BDMV/").otherwise(""))
        .otherwise("d/")
    )
    suffix = F.when((kind == 2) & (page % 2 == 0), ".M2TS").when(kind == 3, ".evo").otherwise(".iso")
    manifest = b.files(spark, sf_dir).select("group_id", F.concat(folder, page.cast("string"), suffix).alias("path"))
    return f.classify_source(manifest, "group_id")


def _log_titles(spark, sf_dir):
    facts = p.title_facts(b.titles(spark, sf_dir), b.streams(spark, sf_dir), b.items(spark, sf_dir))
    return facts.select(
        "disc_id", "title_id", "title_idx", "duration", "bytes",
        F.col("n_items").alias("n_chapters"),
        F.format_string("%05d.mpls", F.col("title_id") % 1000).alias("source"),
        F.concat(F.lit("a,"), F.col("title_id").cast("string")).alias("segment_map"),
        F.when(F.col("title_idx") == 1, 'Disc "X"').alias("disc_name"),
        F.concat(F.lit("T"), F.col("title_id").cast("string")).alias("name"),
        F.when(F.col("priority") < 4, F.col("priority") * 10 + F.col("title_idx")).alias("dvd_title_id"),
    )


_LOG = """lt AS (SELECT * FROM facts WHERE n_items > 0),
hd AS (SELECT disc_id, -1 AS ti, 0 AS sec, 0 AS sub, 'CINFO:1,0,"Blu-ray disc"' AS line FROM lt GROUP BY 1
  UNION ALL SELECT disc_id, -1, 0, 1, 'CINFO:2,0,"Disc ''X''"' FROM lt WHERE title_idx = 1
  UNION ALL SELECT disc_id, -1, 0, 2, 'TCOUNT:' || count(*) FROM lt GROUP BY 1
  UNION ALL SELECT disc_id, title_idx, 1, i, 'TINFO:' || title_idx || ',' || c || ',0,"' || CASE i WHEN 0 THEN CAST(n_items AS VARCHAR)
     WHEN 1 THEN (CAST(duration AS BIGINT) // 3600) || printf(':%02d:%02d', CAST(duration AS BIGINT) % 3600 // 60, CAST(duration AS BIGINT) % 60)
     WHEN 2 THEN printf('%.1f GB', bytes / 1000000000.0) WHEN 3 THEN CAST(bytes AS VARCHAR) WHEN 4 THEN printf('%05d.mpls', title_id % 1000) ELSE 'a,' || title_id END || '"'
   FROM lt, (VALUES (0, 8), (1, 9), (2, 10), (3, 11), (4, 16), (5, 26)) v(i, c)),
tk AS (SELECT disc_id, title_idx AS ti, 2 AS sec, pos * 10 + i AS sub, 'SINFO:' || title_idx || ',' || pos || ',' || c || ',0,"' ||
     CASE i WHEN 0 THEN upper(type[1:1]) || type[2:] WHEN 1 THEN codec WHEN 2 THEN codec WHEN 5 THEN (height * 2) || 'x' || height ELSE lang END || '"' AS line
   FROM streams JOIN lt USING (title_id), (VALUES (0, 1), (1, 7), (2, 2), (3, 3), (4, 4), (5, 19)) v(i, c)
   WHERE i < 2 OR (i = 2 AND type = 'audio') OR (i IN (3, 4) AND type <> 'video') OR (i = 5 AND type = 'video'))"""


@query("s8_scan_log", f"""WITH {b.CATALOG}, {b.facts_sql(0.9)}, {_LOG}
SELECT disc_id, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY ti, sec, sub) - 1 AS INTEGER) AS line_no, line FROM (SELECT * FROM hd UNION ALL SELECT * FROM tk)""")
def _(spark, sf_dir):
    tracks = b.streams(spark, sf_dir).withColumn("width", F.col("height") * 2)
    return k.scan_log(_log_titles(spark, sf_dir), tracks)


@query("s9_disc_manifest", f"""WITH {b.CATALOG}, {b.facts_sql(0.9)},
m AS (SELECT disc_id, max(title_idx) AS last FROM facts GROUP BY 1),
mt AS (SELECT title_id, max(pos) AS mp FROM streams GROUP BY 1),
l AS (SELECT disc_id, -1 AS ti, 0 AS sec, 0 AS sub, '{{"schema_version":1,"titles":[' AS line FROM m
 UNION ALL SELECT disc_id, title_idx, 1, 0, '{{"index":' || title_idx || ',"name":"T' || title_id || '","duration_seconds":' || round_even(CAST(duration AS DOUBLE), 3) || ',"size_bytes":' || bytes || ',"chapters":' || n_items
   || ',"source_file":"' || printf('%05d.mpls', title_id % 1000) || '","segment_map":"a,' || title_id || '","dvd_title_id":' || CASE WHEN priority < 4 THEN CAST(priority * 10 + title_idx AS VARCHAR) ELSE 'null' END || ',"streams":[' FROM facts
 UNION ALL SELECT disc_id, title_idx, 2, pos, '{{"index":' || pos || ',"type":"' || type || '","codec":"' || codec || '","language":"' || lang || '","title":' || CASE WHEN pid IS NULL THEN 'null' ELSE '"Track ' || pid || '"' END || '}}' || CASE WHEN pos < mp THEN ',' ELSE '' END FROM streams JOIN facts USING (title_id) JOIN mt USING (title_id)
 UNION ALL SELECT disc_id, title_idx, 3, 0, ']}}' || CASE WHEN title_idx < last THEN ',' ELSE '' END FROM facts JOIN m USING (disc_id)
 UNION ALL SELECT disc_id, last + 1, 4, 0, ']}}' FROM m)
SELECT disc_id, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY ti, sec, sub) - 1 AS INTEGER) AS line_no, line FROM l""")
def _(spark, sf_dir):
    tracks = b.streams(spark, sf_dir).withColumn("title", F.concat(F.lit("Track "), F.col("pid").cast("string")))
    return k.disc_manifest(_log_titles(spark, sf_dir), tracks)


_CUES = """c AS (SELECT *, lag(kind) OVER w AS prev, row_number() OVER w AS rn FROM tt WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
d AS (SELECT *, lead(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS nx FROM c WHERE rn = 1 OR kind IS DISTINCT FROM prev),
cues AS (SELECT stream_id, seq, pts AS st, coalesce(nx, pts + 450000) AS en, kind, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS cue FROM d WHERE kind <> 'error')"""
_TIMED = "tt AS (SELECT stream_id, seq, kind, CAST(seq AS BIGINT) * 123457 AS pts FROM ticks)"


def _cues(spark, sf_dir):
    timed = b.ticks(spark, sf_dir).withColumn("pts", F.col("seq").cast("long") * 123_457)
    return s.caption_cues(timed.select("stream_id", "seq", "pts", "kind"), "kind", F.col("kind") != "error")


def _srt_sql(t: str) -> str:
    ms = f"CAST(round_even(greatest({t}, 0) * 1000 / 90000.0, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"


def _ass_sql(t: str) -> str:
    cs = f"CAST(round_even({t} / 900.0, 0) AS BIGINT)"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} % 360000 // 6000, {cs} % 6000 // 100, {cs} % 100)"


@query("s10_srt", f"""WITH {b.TICKS}, {_TIMED}, {_CUES}
SELECT stream_id, CAST(cue AS INTEGER) AS cue, cue || chr(10) || {_srt_sql('(st - 45000)')} || ' --> ' || {_srt_sql('(en - 45000)')} || chr(10) || kind || chr(10) AS block FROM cues""")
def _(spark, sf_dir):
    return k.to_srt(_cues(spark, sf_dir), text="kind", offset=45_000)


@query("s10_ass", f"""WITH {b.TICKS}, {_TIMED}, {_CUES}
SELECT stream_id, CAST(cue AS INTEGER) AS cue, seq % 15 AS "row", 'Dialogue: 0,' || {_ass_sql('st')} || ',' || {_ass_sql('en')} || ',CC,,0,0,0,,{{\\pos(' ||
  CAST(round_even((seq % 32) * 720 / 32.0, 0) AS INTEGER) || ',' || CAST(round_even((seq % 15 + 0.8) * 480 / 15.0, 0) AS INTEGER) || ')}}' || kind AS line FROM cues""")
def _(spark, sf_dir):
    placed = _cues(spark, sf_dir).withColumns({"row": F.col("seq") % 15, "column": F.col("seq") % 32, "text": F.col("kind")})
    return k.to_ass(placed)


@query("s11_vobsub_index", f"""WITH {b.TICKS}, e AS (SELECT stream_id, seq, pts, 32 + k % 3 AS sub_id, 2048 * (1 + k % 4) AS size FROM ticks),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY stream_id ORDER BY pts, sub_id, seq {_PRE}), 0) AS BIGINT) AS at0 FROM e)
SELECT stream_id, sub_id, CAST(row_number() OVER (PARTITION BY stream_id, sub_id ORDER BY pts, at0) - 1 AS INTEGER) AS line_no,
  'timestamp: ' || replace({_srt_sql('pts')}, ',', ':') || ', filepos: ' || lpad(lower(hex(at0)), 9, '0') AS line FROM p""")
def _(spark, sf_dir):
    events = b.ticks(spark, sf_dir).select(
        "stream_id", "seq", "pts", (32 + F.col("k") % 3).alias("sub_id"), (2048 * (1 + F.col("k") % 4)).alias("size")
    )
    return k.vobsub_index(events)


@query("s12_chapters_xml")
def _(spark, sf_dir):
    rows = editions(spark, sf_dir)
    atoms = e.edition_atoms(rows, e.union_timeline(rows), _marks(rows).select("group_id", "edition", "t"))
    return k.chapters_xml(atoms)


@query("s12_tag_pairs", """SELECT p_partkey, t.i AS tag_no, t.n AS name, CASE t.i WHEN 0 THEN p_name WHEN 1 THEN CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END ELSE 'a, ' || p_type END AS value
FROM part, (VALUES (0, 'TITLE'), (1, 'RUNTIME'), (2, 'GENRE'), (3, 'ACTOR')) t(i, n) WHERE t.i IN (0, 3) OR (t.i = 1 AND p_size > 10) OR (t.i = 2 AND p_partkey % 2 <> 0 AND p_brand <> '')""")
def _(spark, sf_dir):
    tags = [
        ("TITLE", F.col("p_name")),
        ("RUNTIME", F.when(F.col("p_size") > 10, F.col("p_size"))),
        ("GENRE", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand"))),
        ("ACTOR", F.concat_ws(", ", F.array(F.lit("a"), F.col("p_type")))),
    ]
    return k.tag_pairs(b.table(spark, sf_dir, "part"), "p_partkey", tags)


@query("s13_group_parts", f"""WITH {b.FILES}, m AS (SELECT group_id, 'VTS_' || lpad(CAST(page_id % 4 AS VARCHAR), 2, '0') || '_' || page_id % 13 || CASE WHEN page_id % 11 = 0 THEN '.IFO' ELSE '.VOB' END AS path FROM files),
n AS (SELECT *, TRY_CAST(regexp_extract(path, '^VTS_(\\d+)_\\d+\\.VOB$', 1) AS INTEGER) AS set_no, TRY_CAST(regexp_extract(path, '_(\\d+)\\.VOB$', 1) AS INTEGER) AS part_no FROM m),
q AS (SELECT * FROM n x WHERE set_no IS NOT NULL AND part_no IS NOT NULL AND EXISTS (SELECT 1 FROM n y WHERE y.group_id = x.group_id AND y.set_no = x.set_no AND y.part_no = 1))
SELECT group_id, path, set_no, part_no, CAST(row_number() OVER (PARTITION BY group_id, set_no ORDER BY part_no, path) - 1 AS INTEGER) AS part_idx FROM q""")
def _(spark, sf_dir):
    page = F.col("page_id")
    name = F.concat(
        F.lit("VTS_"), F.lpad((page % 4).cast("string"), 2, "0"), F.lit("_"), (page % 13).cast("string"),
        F.when(page % 11 == 0, ".IFO").otherwise(".VOB"),
    )
    manifest = b.files(spark, sf_dir).select("group_id", name.alias("path"))
    return f.group_parts(manifest, r"^VTS_(\d+)_\d+\.VOB$", r"_(\d+)\.VOB$")


@query("a18_credits", """SELECT p_partkey, p_name || '|' || p_brand AS cast_names, p_brand || ' (Writer)' AS writers, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS directors,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_type ELSE NULL END AS rating FROM part""")
def _(spark, sf_dir):
    def person(name, department, job):
        return F.struct(name.alias("name"), F.lit(department).alias("department"), job.alias("job"))

    part = b.table(spark, sf_dir, "part")
    cast = F.array(*[F.struct(F.col(c).alias("name")) for c in ("p_name", "p_brand", "p_type")])
    crew = F.array(
        person(F.col("p_brand"), "Writing", F.lit("Writer")),
        person(F.col("p_name"), "Directing", F.when(F.col("p_size") % 2 == 0, "Director").otherwise("Assistant")),
    )
    country = F.when(F.col("p_partkey") % 3 == 0, "DE").otherwise("US")
    rating = F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise("")
    releases = F.array(F.struct(country.alias("country"), F.array(F.lit(""), rating).alias("certifications")))
    rows = part.select("p_partkey", cast.alias("c"), crew.alias("w"), releases.alias("r"))
    done = a.credits(rows, "c", "w", "r", "US", top=2)
    return done.select(
        "p_partkey", *[F.array_join(n, "|").alias(n) for n in ("cast_names", "writers", "directors")], "rating"
    )


@query("s7_packets", """SELECT event_id, CAST(4096 + user_id % 4096 AS BIGINT) AS pid, CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0 AS starts,
  CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0 THEN abs(CAST(round(value * 100) AS BIGINT)) END AS pts FROM events""")
def _(spark, sf_dir):
    """Every event as one transport packet, written byte by byte and decoded again."""
    k = F.get_json_object("props", "$.k").cast("long")
    pid, pts = 4096 + F.col("user_id") % 4096, F.abs(F.round(F.col("value") * 100).cast("long"))

    def byte(value):
        return F.lpad(F.hex(value.cast("long")), 2, "0")

    def bits(value, right, mask):
        return F.shiftright(value, right).bitwiseAND(F.lit(mask).cast("long"))

    stamp = [
        bits(pts, 29, 0x0E).bitwiseOR(F.lit(0x21).cast("long")),
        bits(pts, 22, 0xFF),
        bits(pts, 14, 0xFE).bitwiseOR(F.lit(1).cast("long")),
        bits(pts, 7, 0xFF),
        F.shiftleft(pts, 1).bitwiseAND(F.lit(0xFE).cast("long")).bitwiseOR(F.lit(1).cast("long")),
    ]
    starts = k % 3 == 0
    first = F.shiftright(pid, 8) + F.when(starts, 0x40).otherwise(0)
    head = F.concat(F.lit("0000000047"), byte(first), byte(pid % 256), F.lit("10"))
    body = F.when(starts, F.concat(F.lit("000001E00000808005"), *map(byte, stamp))).otherwise("")
    record = F.unhex(F.rpad(F.concat(head, body), 2 * 192, "F"))
    records = b.table(spark, sf_dir, "events").select("event_id", record.alias("record"))
    return f.decode_packets(records, ["event_id"])
