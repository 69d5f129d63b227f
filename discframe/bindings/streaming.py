"""Registered streaming queries over the events file, and batch forms of the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discframe.bindings import tables as b
from discframe.bindings.registry import query
from discframe.operators import fragments as g
from discframe.session import shared_folder
from discframe.streaming import jobs


#: Files of the events arrive in order of time, and rows of one time in one file.
DELAY = "1 minute"
#: Rows of a file, about: what a key can have waiting is a few files.
SLICE_ROWS = 1_000_000
#: Batches of the streams that aggregate: every batch commits or rewrites the state of all keys.
BATCHES = 4


def event_stream(spark: SparkSession, sf_dir: str, batches: int | None = None) -> DataFrame:
    """The events as a stream of files in order of time, and an end to it.

    One file per batch and rows that end each key; or, given *batches*, that many batches of
    one or more files, for aggregations, which need no order in a batch and no ends of keys.
    """
    events = b.table(spark, sf_dir, "events")
    stamp = F.col("ts").cast("timestamp")
    rows = events.select(
        F.col("user_id").alias("stream_id"),
        stamp.alias("ts"),
        F.unix_micros(stamp).alias("ts_us"),
        "event_id",
        F.round(F.col("value") * 100).cast("long").alias("pts"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.lit(False).alias("end"),
    )
    folder = f"{shared_folder(spark)}/discframe-streams/{uuid.uuid4().hex}"
    slices = max(3, -(-rows.count() // SLICE_ROWS))
    by_time = rows.repartitionByRange(slices, "ts").withColumn("slice", F.spark_partition_id())
    by_time.write.partitionBy("slice").parquet(f"{folder}-slices")
    sliced = spark.read.parquet(f"{folder}-slices")
    found = sorted(n for (n,) in sliced.select("slice").distinct().collect())
    files = -(-len(found) // batches) if batches and found else 1
    # A stream takes the oldest files first, so each batch is written after the last one.
    for at in range(0, len(found), files):
        some = found[at : at + files]
        part = sliced.filter(F.col("slice").between(some[0], some[-1])).select(*rows.columns)
        part = part.repartition(len(some)) if len(some) > 1 else part.coalesce(1)
        # Small row groups let several tasks read a file.
        part.write.mode("append").option("parquet.block.size", 4 << 20).parquet(folder)
    rows = sliced.select(*rows.columns)
    ends = jobs.closing_rows(rows, "stream_id", "ts", DELAY).select(*rows.columns)
    if batches is None:
        closing = ends.filter("end").repartition(max(1, -(-rows.select("stream_id").distinct().count() // SLICE_ROWS)))
        closing.write.mode("append").parquet(folder)
    # The row that moves the watermark past everything comes last.
    ends.filter(F.col("end").isNull()).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _run(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything a stream emits, through a parquet sink in the shared folder."""
    folder = f"{shared_folder(spark)}/discframe-streams/{uuid.uuid4().hex}"
    jobs.run_available(stream, folder, mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("x1_rebase_stream", f"""WITH RECURSIVE {b.TICKS},
f AS (SELECT stream_id, event_id, seq, pts, CAST(0 AS BIGINT) AS off, pts AS latest, pts AS effective FROM ticks WHERE seq = 0
  UNION ALL
  SELECT t.stream_id, t.event_id, t.seq, t.pts, CASE WHEN t.pts + f.off < f.latest - 10000 THEN f.latest - t.pts ELSE f.off END,
    CASE WHEN t.pts + f.off < f.latest - 10000 THEN f.latest ELSE greatest(f.latest, t.pts + f.off) END,
    CASE WHEN t.pts + f.off < f.latest - 10000 THEN f.latest ELSE t.pts + f.off END
  FROM f JOIN ticks t ON t.stream_id = f.stream_id AND t.seq = f.seq + 1)
SELECT stream_id, event_id, pts, effective FROM f""")
def _(spark, sf_dir):
    return _run(spark, jobs.rebase_stream(event_stream(spark, sf_dir), 10_000, DELAY))


def _chunks(df: DataFrame) -> DataFrame:
    """Fragments: the event type's bytes; only every third packet carries a time."""
    time = F.when(F.col("k") % 3 == 0, F.col("pts")).otherwise(0)
    return df.withColumns({"chunk": F.encode("kind", "UTF-8"), "time": time})


@query("x2_assemble", f"""WITH RECURSIVE {b.TICKS},
fr AS (SELECT stream_id, seq, CASE WHEN k % 3 = 0 THEN pts ELSE 0 END AS p, kind AS c, lead(seq) OVER (PARTITION BY stream_id ORDER BY seq) IS NULL AS fin FROM ticks),
f AS (SELECT stream_id, seq, p AS opened, c AS data, fin, CAST(NULL AS BIGINT) AS ep, CAST(NULL AS VARCHAR) AS ed FROM fr WHERE seq = 0
  UNION ALL
  SELECT r.stream_id, r.seq, CASE WHEN r.p <> 0 AND r.p <> f.opened THEN r.p WHEN f.opened = 0 THEN r.p ELSE f.opened END,
   CASE WHEN r.p <> 0 AND r.p <> f.opened THEN r.c ELSE f.data || r.c END, r.fin,
   CASE WHEN r.p <> 0 AND r.p <> f.opened THEN f.opened END, CASE WHEN r.p <> 0 AND r.p <> f.opened THEN f.data END
  FROM f JOIN fr r ON r.stream_id = f.stream_id AND r.seq = f.seq + 1)
SELECT stream_id, seq, 0 AS part, ep AS pts, ed AS data FROM f WHERE ed IS NOT NULL
UNION ALL SELECT stream_id, seq, 1, opened, data FROM f WHERE fin""")
def _(spark, sf_dir):
    rows = _chunks(b.ticks(spark, sf_dir)).select("stream_id", "seq", F.col("time").alias("pts"), "chunk")
    done = g.assemble(rows)
    # Event-type texts state sizes far above any assembled length, so only times end one.
    return done.withColumn("data", F.decode("data", "UTF-8"))


@query("x2_assemble_stream", f"""WITH RECURSIVE {b.TICKS},
fr AS (SELECT stream_id, seq, CASE WHEN k % 3 = 0 THEN pts ELSE 0 END AS p, kind AS c, lead(seq) OVER (PARTITION BY stream_id ORDER BY seq) IS NULL AS fin FROM ticks),
f AS (SELECT stream_id, seq, p AS opened, c AS data, fin, CAST(NULL AS BIGINT) AS ep, CAST(NULL AS VARCHAR) AS ed FROM fr WHERE seq = 0
  UNION ALL
  SELECT r.stream_id, r.seq, CASE WHEN r.p <> 0 AND r.p <> f.opened THEN r.p WHEN f.opened = 0 THEN r.p ELSE f.opened END,
   CASE WHEN r.p <> 0 AND r.p <> f.opened THEN r.c ELSE f.data || r.c END, r.fin,
   CASE WHEN r.p <> 0 AND r.p <> f.opened THEN f.opened END, CASE WHEN r.p <> 0 AND r.p <> f.opened THEN f.data END
  FROM f JOIN fr r ON r.stream_id = f.stream_id AND r.seq = f.seq + 1)
SELECT stream_id, ep AS pts, hex(ed) AS data FROM f WHERE ed IS NOT NULL
UNION ALL SELECT stream_id, opened, hex(data) FROM f WHERE fin""")
def _(spark, sf_dir):
    rows = _chunks(event_stream(spark, sf_dir)).select(
        "stream_id", "ts", F.col("ts_us").alias("seq"), "event_id", F.col("time").alias("pts"), F.hex("chunk").alias("hex"), "end"
    )
    return _run(spark, jobs.assemble_stream(rows, DELAY, order=("seq", "event_id"))).drop("seq")


@query("x3_cues_stream", f"""WITH {b.TICKS}, c AS (SELECT *, lag(kind) OVER w AS prev, row_number() OVER w AS rn FROM ticks WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
d AS (SELECT *, lead(pts) OVER w AS nx FROM c WHERE rn = 1 OR kind IS DISTINCT FROM prev WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
SELECT stream_id, pts AS start, coalesce(nx, pts + 450000) AS "end", kind AS text FROM d WHERE kind <> 'error'""")
def _(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumns({"text": F.col("kind"), "shown": F.col("kind") != "error"})
    return _run(spark, jobs.cues_stream(rows, DELAY)).drop("event_id")


@query("x7_progress", """SELECT user_id AS stream_id, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_failed,
  arg_max(least(CAST(json_extract(props, '$.k') AS BIGINT), 100), struct_pack(t := ts, e := event_id)) AS percent FROM events GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"),
        "ts",
        "event_id",
        (F.col("event_type") == "error").alias("failed"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    return jobs.progress(rows, "1 day", "k")


@query("x7_progress_stream", """SELECT user_id AS stream_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_failed,
  arg_max(least(CAST(json_extract(props, '$.k') AS BIGINT), 100), struct_pack(t := ts, e := event_id)) AS percent FROM events GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = event_stream(spark, sf_dir, BATCHES).withColumn("failed", F.col("kind") == "error")
    return _run(spark, jobs.progress(_without_marks(rows), "1 hour", "k", DELAY))


@query("x6_stalled", """WITH e AS (SELECT user_id AS stream_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT stream_id, max(ts) AS last_seen, count(*) AS n, max(ts) + INTERVAL 2 HOUR AS stalled_at FROM s GROUP BY stream_id, no""")
def _(spark, sf_dir):
    return _run(spark, jobs.stalled(_without_marks(event_stream(spark, sf_dir, BATCHES)), "2 hours", DELAY))


def _without_marks(rows: DataFrame) -> DataFrame:
    """The events and the row that moves the watermark, whose own window never closes."""
    return rows.filter(F.coalesce(~F.col("end"), F.lit(True)))


@query("x4_scan_vote_stream", f"""WITH {b.TICKS}, f AS (SELECT stream_id, kind <> 'signup' AS interlaced,
  CASE WHEN k % 3 = 0 THEN NULL ELSE stream_id % 2 = 0 OR k = 1 END AS tff FROM ticks),
c AS (SELECT stream_id, count(*) AS n, count(*) FILTER (WHERE interlaced) AS n_interlaced,
  count(*) FILTER (WHERE interlaced AND tff) AS t, count(*) FILTER (WHERE interlaced AND NOT tff) AS b FROM f GROUP BY 1)
SELECT stream_id, n, n_interlaced, CASE WHEN n < 24 THEN NULL WHEN n_interlaced = 0 THEN 'progressive'
  WHEN n_interlaced < 0.7 * n THEN NULL WHEN t > 0 AND b = 0 THEN 'tff' WHEN b > 0 AND t = 0 THEN 'bff' END AS scan FROM c""")
def _(spark, sf_dir):
    frames = event_stream(spark, sf_dir, BATCHES).filter(~F.col("end")).select(
        "stream_id",
        (F.col("kind") != "signup").alias("interlaced"),
        F.when(F.col("k") % 3 != 0, (F.col("stream_id") % 2 == 0) | (F.col("k") == 1)).alias("top_field_first"),
    )
    return _run(spark, jobs.scan_vote_stream(frames, min_share=0.7), "complete")


_EVENT_TAILS = """SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS clip,
  8640 - CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS ve, 2880 AS frame,
  list_transform([0, 1, 2], lambda x: CAST(x * 2880 + CAST(round(value * 100) AS BIGINT) % 40 AS BIGINT)) AS ends, [CAST(0 AS BIGINT), 1, 2] AS offs FROM events"""


@query("x5_drift_stream", f"""WITH RECURSIVE {b.drift_sql(_EVENT_TAILS)}
SELECT track, clip, drift, cut_offset, dropped, dead AS failed FROM kept WHERE i > 0""")
def _(spark, sf_dir):
    # Every event is one clip of its track, with three frames at its end.
    frames = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (i * 2880 + F.col("pts") % 40).cast("long"))
    tails = event_stream(spark, sf_dir).select(
        F.col("stream_id").alias("track"),
        "ts",
        F.col("ts_us").alias("clip"),
        (F.lit(8640) - F.col("k") * 10).alias("video_end"),
        F.lit(2880).cast("long").alias("frame"),
        frames.alias("pts"),
        F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i.cast("long")).alias("offsets"),
        "event_id",
        "end",
    )
    return _run(spark, jobs.drift_stream(tails, delay=DELAY, order=("clip", "event_id")))
