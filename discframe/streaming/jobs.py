"""Structured Streaming forms of the operators that keep running state.

Recurrences need their rows in order: rows are kept as state, by buckets of keys, until the
watermark has passed them (event-time timeout); what is due is sorted and runs through the
same step function as the batch fold.  Rows later than the watermark are dropped by
Spark and counted in the query progress (``numRowsDroppedByWatermark``), so *delay* is how
far out of order rows may come.

A stream that ends says so: rows with ``end`` set (:func:`closing_rows`) close what a key
still holds open, and a last row whose ``end`` is null moves the watermark past everything.

Plain counts and window roll-ups use built-in streaming aggregation instead, which
combines partially before the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from discframe.operators.aggregate import vote_verdict
from discframe.operators.fold import Step
from discframe.operators.fragments import assemble_step
from discframe.operators.timeline import join_drift_step, rebase_step

#: How far out of order rows may come, unless a job is told otherwise.
DELAY = "10 minutes"


#: Groups that the keys of a fold are dealt over: what Spark hands to Python and keeps as one state.
BUCKETS = 512


class OrderedFold:
    """Per bucket of keys: keep rows, and fold those behind the watermark in order of key and row.

    A row is a JSON text (``_coded``).  The state of a bucket holds what every key of it has
    open and the rows that wait, each as one text, so that a batch costs one call per bucket
    and none per key.  A step may return several outputs per row through *emit*.
    """

    def __init__(self, step: Step, columns: list[str], emit, finish=None):
        self.step, self.columns, self.emit, self.finish = step, columns, emit, finish

    def __call__(self, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, kept = state.get if state.exists else ("{}", "")
        lines = kept.split("\n") if kept else []
        if not state.hasTimedOut:
            for pdf in frames:
                lines += pdf["fold_row"].tolist()
        watermark = state.getCurrentWatermarkMs()
        ready, waiting, earliest = [], [], None
        for line in lines:
            # The event time leads the text.
            ms = int(line[6 : line.index(",")])
            if ms < watermark:
                ready.append(json.loads(line))
            else:
                waiting.append(line)
                earliest = ms if earliest is None else min(earliest, ms)
        if ready:
            states = json.loads(opened)
            produced = self._folded(ready, states)
            opened = json.dumps(states)
            if produced:
                yield pd.DataFrame(produced, columns=["fold_key", *self.columns], dtype=object)
        state.update((opened, "\n".join(waiting)))
        if earliest is not None:
            state.setTimeoutTimestamp(max(earliest, watermark + 1))

    def _folded(self, rows: list[dict], states: dict[str, list]) -> list[tuple]:
        """The outputs of *rows*; *states* holds the open state of each key and is moved on."""
        groups: dict[str, list[dict]] = {}
        for row in rows:
            groups.setdefault(json.dumps(row["key"]), []).append(row)
        produced = []
        for name, group in groups.items():
            state = tuple(states.pop(name)) if name in states else None
            # An end comes after all rows that are due with it.
            for row in sorted(group, key=lambda r: ((False, True, None).index(r["end"]), _values(r["order"]))):
                if row["end"] is None:
                    continue
                carry = _values(row["carry"])
                if row["end"]:
                    closed = self.finish(state) if self.finish and state is not None else None
                    out = self.emit(carry, closed) if closed is not None else []
                    state = None
                else:
                    state, values = self.step(state, *_values(row["read"]))
                    out = self.emit(carry, values)
                produced += [(row["key"], *o) for o in out]
            if state is not None:
                states[name] = state
        return produced


def _values(row: dict) -> list:
    return list(row.values())


def fold_stream(
    df: DataFrame,
    key: str,
    ts: str,
    order: list[str],
    read: list[str],
    carry: list[str],
    step: Step,
    outputs: list[tuple[str, T.DataType]],
    delay: str,
    emit=None,
    finish=None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming fold: *carry* columns of every row plus the step's *outputs*.

    A row whose ``end`` is true (if there is such a column) is not folded: *finish* turns
    the open state into a last output, and the key starts afresh.  Where ``end`` is null the
    row only moves the watermark.  The session's state store is the one ``session.configure`` sets.
    """
    if "end" not in df.columns:
        df = df.withColumn("end", F.lit(False))
    field = {f.name: f for f in df.schema.fields}
    coded = df.withWatermark(ts, delay).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("fold_bucket"), ts, _coded(key, ts, order, read, carry).alias("fold_row")
    )
    names = [*carry, *[n for n, _ in outputs]]
    schema = T.StructType(
        [
            T.StructField("fold_key", field[key].dataType),
            *[T.StructField(c, field[c].dataType) for c in carry],
            *[T.StructField(n, t) for n, t in outputs],
        ]
    )
    fold = OrderedFold(step, names, emit or (lambda passed, out: [(*passed, *out)]), finish)

    def folded(bucket, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from fold(frames, state)

    result = coded.groupBy("fold_bucket").applyInPandasWithState(
        folded, schema, "opened string, waiting string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return result.withColumnRenamed("fold_key", key)


def _coded(key: str, ts: str, order: list[str], read: list[str], carry: list[str]) -> Column:
    """Event time, key, order, step inputs and passed-through columns of a row as one JSON text."""

    def part(columns: list[str]) -> Column:
        return F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])

    fields = [F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(key).alias("key"), F.col("end").alias("end")]
    parts = [part(c).alias(n) for n, c in (("order", order), ("read", read), ("carry", carry))]
    return F.to_json(F.struct(*fields, *parts), {"ignoreNullFields": "false"})


def closing_rows(rows: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The rows that end a finite stream of *rows*: everything but *key*, *ts* and ``end`` is null.

    One row per key just after the last row of all (``end`` true), and one of the greatest
    key, more than *delay* later, which only moves the watermark (``end`` null).
    """
    last = rows.agg(F.max(key).alias("__key"), F.max(ts).alias("__last"))
    after = F.col("__last") + F.expr("INTERVAL 1 SECOND")
    late = after + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 DAY")
    keys = rows.select(F.col(key).alias("__key")).distinct()
    latest = rows.agg(F.max(ts)).first()[0]
    ends = keys.select("__key", (F.lit(latest) + F.expr("INTERVAL 1 SECOND")).alias("__ts"), F.lit(True).alias("__end"))
    moved = last.select("__key", late.alias("__ts"), F.lit(None).cast("boolean").alias("__end"))
    filled = {key: "__key", ts: "__ts", "end": "__end"}
    columns = [F.col(filled[f.name]) if f.name in filled else F.lit(None).cast(f.dataType) for f in rows.schema.fields]
    return ends.unionByName(moved).select(*[c.alias(n) for c, n in zip(columns, rows.columns)])


def rebase_stream(ticks: DataFrame, tolerance: int, delay: str = DELAY, key: str = "stream_id") -> DataFrame:
    """Streaming clock rebase: ``key, event_id, pts, effective``."""
    return fold_stream(
        ticks, key, "ts", ["ts_us", "event_id"], ["pts"], ["event_id", "pts"], rebase_step(tolerance),
        [("effective", T.LongType())], delay,
    )


def assemble_stream(
    fragments: DataFrame, delay: str = DELAY, key: str = "stream_id", order: tuple[str, ...] = ("seq",)
) -> DataFrame:
    """Streaming subpicture assembly from ``key, ts, seq, pts, hex`` rows; the end of a
    stream gives out what is open."""

    def finish(state):
        return tuple(state) if state[1] is not None else None

    def step(state, pts, chunk):
        return assemble_step(state, pts, chunk, False)

    def emit(passed, out):
        return [(*passed, out[0], out[1])] if out[1] is not None else []

    return fold_stream(
        fragments, key, "ts", list(order), ["pts", "hex"], ["seq"], step,
        [("pts", T.LongType()), ("data", T.StringType())], delay, emit, finish,
    )


def cues_step(state, pts, text, shown):
    """State: (content, its start or null).  Output: the cue a change closes."""
    content, start = state if state is not None else (None, None)
    if state is not None and text == content:
        return (content, start), (None, None, None)
    closed = (start, pts, content) if start is not None else (None, None, None)
    return (text, pts if shown else None), closed


def cues_stream(snapshots: DataFrame, delay: str = DELAY, key: str = "stream_id", tail: int = 450_000) -> DataFrame:
    """Streaming display cues: a cue is emitted when the next differing snapshot closes it.

    Snapshots: ``key, ts, ts_us, event_id, pts, text, shown``.  The cue that is open when
    the stream ends lasts *tail*.
    """

    def finish(state):
        content, start = state
        return (start, start + tail, content) if start is not None else None

    def emit(passed, out):
        return [(*passed, *out)] if out[0] is not None else []

    return fold_stream(
        snapshots, key, "ts", ["ts_us", "event_id"], ["pts", "text", "shown"], ["event_id"], cues_step,
        [("start", T.LongType()), ("end", T.LongType()), ("text", T.StringType())], delay, emit, finish,
    )


def scan_vote_stream(frames: DataFrame, key: str = "stream_id", min_frames: int = 24, min_share: float = 0.95) -> DataFrame:
    """Running scan-type vote: plain streaming counts and the verdict over them."""
    counted = frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("interlaced").alias("n_interlaced"),
        F.count_if(F.col("interlaced") & F.col("top_field_first")).alias("_top"),
        F.count_if(F.col("interlaced") & ~F.col("top_field_first")).alias("_bottom"),
    )
    return counted.withColumn("scan", vote_verdict(min_frames, min_share)).drop("_top", "_bottom")


def drift_stream(
    tails: DataFrame, tolerance: float = 0.010, delay: str = DELAY, key: str = "track", order: tuple[str, ...] = ("clip",)
) -> DataFrame:
    """Streaming drift trim: one row per clip join with its cut.

    Tails: ``key, ts, clip, video_end, frame, pts array, offsets array``, in the order of *order*.
    """
    outputs = [
        ("drift", T.LongType()),
        ("cut_offset", T.LongType()),
        ("dropped", T.LongType()),
        ("failed", T.BooleanType()),
    ]
    return fold_stream(
        tails, key, "ts", list(order), ["video_end", "frame", "pts", "offsets"], ["clip"],
        join_drift_step(tolerance * 90_000), outputs, delay,
    )


def stalled(events: DataFrame, silence: str, delay: str = DELAY, key: str = "stream_id") -> DataFrame:
    """Keys that went silent: a session closes *silence* after its last event."""
    sessions = events.withWatermark("ts", delay).groupBy(F.session_window("ts", silence), key)
    return sessions.agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n")).select(
        key, "last_seen", "n", F.col("session_window.end").alias("stalled_at")
    )


def progress(events: DataFrame, window: str, percent: str, delay: str | None = DELAY, key: str = "stream_id") -> DataFrame:
    """Rows, failures and the last reported percentage per key and tumbling window.

    The same code runs on batch and streaming frames.
    """
    timed = events.withWatermark("ts", delay) if events.isStreaming and delay else events
    last = F.max_by(F.least(F.col(percent), F.lit(100)), F.struct("ts", "event_id"))
    return (
        timed.groupBy(F.window("ts", window), key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("failed").alias("n_failed"),
            last.alias("percent"),
        )
        .select(key, F.col("window.start").alias("window_start"), "n", "n_failed", "percent")
    )


def parse_progress(text: Column) -> Column:
    """Last ``Progress: N%`` of a text, at most 100."""
    found = F.regexp_extract_all(text, F.lit(r"Progress:\s*(\d+)%"), 1)
    return F.least(F.get(F.reverse(found), F.lit(0)).cast("int"), F.lit(100))


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Run a stream over everything available and stop; results go to ``<folder>/out``.

    Appended rows use the parquet sink; in complete mode every batch replaces the last.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/out")
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
