"""The source of the streaming queries: files in order of time, and folds during the stream."""

import os

from compare import oracle_connection
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.bindings import ORACLES, QUERIES, streaming
from discframe.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def test_files_come_in_order_of_time(spark, monkeypatch):
    con = oracle_connection(FOLDER)
    total = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    monkeypatch.setattr(streaming, "SLICE_ROWS", total // 6 + 1, raising=False)
    folders = []
    shared = streaming.shared_folder
    monkeypatch.setattr(streaming, "shared_folder", lambda session: folders.append(f"{shared(session)}/{len(folders)}") or folders[-1])
    got = QUERIES["x1_rebase_stream"](spark, FOLDER)
    rows = sorted(map(tuple, got.select("stream_id", "event_id", "pts", "effective").collect()))
    assert rows == sorted(con.sql(ORACLES["x1_rebase_stream"]).fetchall())
    top = f"{folders[0].removeprefix('file://')}/discframe-streams"
    source = f"{top}/{next(f for f in os.listdir(top) if not f.endswith('-slices'))}"
    files = [f"{source}/{f}" for f in os.listdir(source) if f.endswith(".parquet")]
    last = None
    sizes = []
    for f in sorted(files, key=lambda f: os.stat(f).st_mtime_ns):
        few = spark.read.parquet(f).agg(F.min("ts"), F.max("ts"), F.count("*")).first()
        assert last is None or few[0] > last
        last = few[1]
        sizes.append(few[2])
    assert sum(sizes[:-2]) == total and max(sizes[:-2]) < 2 * streaming.SLICE_ROWS and len(sizes) == 8 and sizes[-1] == 1
    # Rows come out before the end of the stream.
    batches = {r[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert len(batches) > 4


def test_keys_of_a_bucket_are_folded_apart_and_a_call_serves_many(spark, tmp_path):
    """Many keys in few buckets, out of order within the delay, with a key that is null."""
    rows = [(k, i, 1_000_000 * (10 + i)) for k in (*range(40), None) for i in range(30)]
    schema = "stream_id long, event_id long, ts_us long"
    made = spark.createDataFrame(rows, schema).select("*", F.timestamp_micros("ts_us").alias("ts"), (F.col("event_id") * 7 % 11 * 100).alias("pts"), F.lit(False).alias("end"))
    source = f"{tmp_path}/in"
    for low in (0, 10, 20):
        made.filter(F.col("event_id").between(low, low + 9)).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(source)
    last = made.limit(1).select("stream_id", "event_id", "ts_us", F.expr("timestamp'2030-01-01'").alias("ts"), "pts", F.lit(None).cast("boolean").alias("end"))
    last.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = jobs.fold_stream(
        stream, "stream_id", "ts", ["ts_us", "event_id"], ["pts"], ["event_id"],
        lambda state, pts: (((state or (0,))[0] + pts,), ((state or (0,))[0] + pts,)), [("total", T.LongType())], "1 second", buckets=3,
    )
    jobs.run_available(out, str(tmp_path))
    total, want = 0, {}
    for i in range(30):
        total += i * 7 % 11 * 100
        want[i] = total
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 41 * 30 and all(r["total"] == want[r["event_id"]] for r in got)
    # Spark hands over buckets and not keys.
    assert "fold_bucket" in out._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInPandasWithState")[1]
