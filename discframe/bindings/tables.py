"""Catalog-shaped views of the driver's star schema, and the same views as SQL CTEs.

Disc = customer, title = order, play item / stream / cell = line item, clock samples
= events per user, file manifest = pages per host.  Every Spark function here has a
SQL twin of the same name; oracles are assembled from those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discframe.operators import heavy
from discframe.operators import ordered as o

# Full order of a line item inside its order; (l_orderkey, l_linenumber) repeats.
LINE_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


#: Columns that hold the same keys, for the sketches of heavy ones.
DOMAINS = [
    [("orders", "o_custkey"), ("customer", "c_custkey")],
    [("orders", "o_orderkey"), ("lineitem", "l_orderkey")],
    [("events", "user_id")],
    [("conversations", "conv_id")],
]
_peaks: dict[tuple[str, str], dict[tuple[str, str], int]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table whose key columns carry their peaks (one sketch per table, folder and session)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    domains = [d for d in DOMAINS if any(n == name for n, _ in d)]
    if not domains:
        return df
    # Domains that share tables are sketched together.
    for _ in DOMAINS:
        names = {n for d in domains for n, _ in d}
        domains = [d for d in DOMAINS if any(n in names for n, _ in d)]
    names = {n for d in domains for n, _ in d}
    tag = (spark.sparkContext.applicationId, sf_dir, min(names))
    if tag not in _peaks:
        _peaks[tag] = heavy.peaks({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}, domains)
    return heavy.marked(df, {c: p for (n, c), p in _peaks[tag].items() if n == name})


def spread(df: DataFrame, rows: int = 25_000) -> DataFrame:
    """*df* dealt over tasks of about *rows* rows, for costly work per row.

    A file of few row groups is otherwise read, and worked on, by as few tasks.
    """
    return df.repartition(max(1, -(-df.count() // rows)))


def lines(spark: SparkSession, sf_dir: str, read: list[str] | None = None) -> DataFrame:
    """Line items with a dense 0-based ``pos`` per order; if given, only the *read* columns of the order are wanted.

    Rows that agree in the order up to the last of those are alike in all of them, so the
    rest of the order does not change the result and is not shuffled.
    """
    df, order = table(spark, sf_dir, "lineitem"), LINE_ORDER
    if read is not None:
        order = LINE_ORDER[: max(2, *[LINE_ORDER.index(c) + 1 for c in read])]
        df = df.select("l_orderkey", *order)
    ranked = o.ordered(
        df,
        "l_orderkey",
        order,
        block_on=["l_linenumber", "l_partkey"],
        _rn=o.row_number(),
    )
    return ranked.withColumn("pos", F.col("_rn") - 1).drop("_rn")


def plain_items(spark: SparkSession, sf_dir: str, clips: int = 10) -> DataFrame:
    """The ``items`` without size and part."""
    return lines(spark, sf_dir, ["l_suppkey", "l_quantity"]).select(
        F.col("l_orderkey").alias("title_id"), "pos", (F.col("l_suppkey") % clips).alias("clip_id"), F.col("l_quantity").alias("duration")
    )


def items(spark: SparkSession, sf_dir: str, clips: int = 10) -> DataFrame:
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("title_id"),
        "pos",
        (F.col("l_suppkey") % clips).alias("clip_id"),
        F.col("l_quantity").alias("duration"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"),
        F.col("l_partkey").alias("part_id"),
    )


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp, flag = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("title_id"),
        "pos",
        F.when(flag == "R", "video").when(flag == "A", "audio").otherwise("subtitle").alias("type"),
        F.concat(F.lit("c"), (supp % 5).cast("string")).alias("codec"),
        F.element_at(F.array(*map(F.lit, ["eng", "fre", "ger", "jpn", "und"])), (part % 5 + 1).cast("int")).alias("lang"),
        F.when(supp % 4 != 3, (supp % 4) * 3 + 2).alias("channels"),
        F.when(part % 7 != 0, 256 + supp % 24).alias("pid"),
        (F.col("l_discount") > 0.08).alias("is_default"),
        ((F.col("l_linestatus") == "O") & (F.col("l_discount") < 0.035)).alias("is_forced"),
        (F.col("l_tax") > 0.065).alias("is_commentary"),
        (F.col("l_quantity") > 5).alias("muxable"),
        F.element_at(F.array(*map(F.lit, [480, 1080, 2160])), (supp % 3 + 1).cast("int")).alias("height"),
        ((flag == "R") & (F.col("l_tax") > 0.055)).alias("layer"),
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    ranked = o.ordered(df, "o_custkey", ["o_orderdate", "o_orderkey"], _rn=o.row_number())
    return ranked.select(
        F.col("o_custkey").alias("disc_id"),
        F.col("o_orderkey").alias("title_id"),
        (F.col("_rn") - 1).alias("title_idx"),
        (F.col("o_totalprice") / 50).alias("duration"),
        F.col("o_orderstatus").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock samples of a user in stream order; ``pts`` are whole hundredths of value."""
    df = table(spark, sf_dir, "events")
    ranked = o.ordered(df, "user_id", ["ts", "event_id"], _rn=o.row_number())
    return ranked.select(
        F.col("user_id").alias("stream_id"),
        (F.col("_rn") - 1).alias("seq"),
        F.round(F.col("value") * 100).cast("long").alias("pts"),
        F.col("event_type").alias("kind"),
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("group_id"),
        F.col("url").alias("path"),
        F.length("html").cast("long").alias("size"),
        "page_id",
    )
    tag = (spark.sparkContext.applicationId, sf_dir, "files")
    if tag not in _peaks:
        _peaks[tag] = heavy.peaks({"files": df}, [[("files", "group_id")]])
    return heavy.marked(df, {"group_id": _peaks[tag]["files", "group_id"]})


_LINE_SORT = ", ".join(LINE_ORDER)

LINES = f"""lines AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_SORT}) - 1 AS INTEGER) AS pos
  FROM lineitem)"""

_ITEMS = """items AS (
  SELECT l_orderkey AS title_id, pos, l_suppkey % {clips} AS clip_id, l_quantity AS duration,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_partkey AS part_id
  FROM lines)"""
ITEMS = LINES + ",\n" + _ITEMS.format(clips=10)
ITEMS4 = LINES + ",\n" + _ITEMS.format(clips=4)

_STREAMS = """streams AS (
  SELECT l_orderkey AS title_id, pos,
    CASE l_returnflag WHEN 'R' THEN 'video' WHEN 'A' THEN 'audio' ELSE 'subtitle' END AS type,
    'c' || CAST(l_suppkey % 5 AS VARCHAR) AS codec,
    CASE l_partkey % 5 WHEN 0 THEN 'eng' WHEN 1 THEN 'fre' WHEN 2 THEN 'ger' WHEN 3 THEN 'jpn' ELSE 'und' END AS lang,
    CASE WHEN l_suppkey % 4 <> 3 THEN (l_suppkey % 4) * 3 + 2 END AS channels,
    CASE WHEN l_partkey % 7 <> 0 THEN 256 + l_suppkey % 24 END AS pid,
    l_discount > 0.08 AS is_default,
    l_linestatus = 'O' AND l_discount < 0.035 AS is_forced,
    l_tax > 0.065 AS is_commentary,
    l_quantity > 5 AS muxable,
    CASE l_suppkey % 3 WHEN 0 THEN 480 WHEN 1 THEN 1080 ELSE 2160 END AS height,
    l_returnflag = 'R' AND l_tax > 0.055 AS layer
  FROM lines)"""
STREAMS = LINES + ",\n" + _STREAMS

TITLES = """titles AS (
  SELECT o_custkey AS disc_id, o_orderkey AS title_id,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS title_idx,
    o_totalprice / 50 AS duration, o_orderstatus AS status,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority
  FROM orders)"""

# Everything over orders and line items at once.
CATALOG = ",\n".join([ITEMS, _STREAMS, TITLES])
CATALOG4 = ",\n".join([ITEMS4, _STREAMS, TITLES])

TICKS = """ticks AS (
  SELECT user_id AS stream_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq,
    CAST(round(value * 100) AS BIGINT) AS pts, event_type AS kind, event_id,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)"""

FILES = """files AS (
  SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS group_id, url AS path,
    CAST(length(html) AS BIGINT) AS size, page_id
  FROM pages)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("chain_id"),
        "pos",
        (F.col("l_suppkey") % 3).alias("vob_id"),
        (F.col("l_partkey") % 5).alias("cell_id"),
        (F.col("l_partkey") * 50).alias("first_sector"),
        (F.col("l_partkey") * 50 + F.floor("l_extendedprice")).alias("last_sector"),
        F.col("l_quantity").alias("duration"),
        (F.col("l_suppkey") % 4).alias("block_mode"),
        (F.col("l_partkey") % 8).alias("flags"),
        (F.col("l_tax") < 0.075).alias("is_angle"),
    )


_CELLS = """cells AS (
  SELECT l_orderkey AS chain_id, pos, l_suppkey % 3 AS vob_id, l_partkey % 5 AS cell_id,
    l_partkey * 50 AS first_sector,
    l_partkey * 50 + CAST(floor(l_extendedprice) AS BIGINT) AS last_sector,
    l_quantity AS duration, l_suppkey % 4 AS block_mode, l_partkey % 8 AS flags, l_tax < 0.075 AS is_angle
  FROM lines)"""
CELLS = LINES + ",\n" + _CELLS


def facts_sql(share: float) -> str:
    """CTEs counts, istats and facts over the items, streams and titles CTEs."""
    return f"""counts AS (
  SELECT title_id, count(*) FILTER (WHERE type = 'video') AS n_video,
    count(*) FILTER (WHERE type = 'audio') AS n_audio,
    count(*) FILTER (WHERE type = 'subtitle') AS n_sub,
    count(*) FILTER (WHERE type = 'audio' AND lang <> 'und') AS n_known_audio
  FROM streams GROUP BY title_id),
per_clip AS (
  SELECT title_id, clip_id, count(*) AS n, sum(duration) AS d, CAST(sum(size) AS BIGINT) AS s
  FROM items GROUP BY title_id, clip_id),
istats AS (
  SELECT title_id, CAST(sum(n) AS BIGINT) AS n_items, sum(d) AS runtime, CAST(sum(s) AS BIGINT) AS bytes,
    sum(n) >= 5 AND max(n) >= {share} * sum(n) AS looped
  FROM per_clip GROUP BY title_id),
facts AS (
  SELECT t.*, coalesce(n_video, 0) AS n_video, coalesce(n_audio, 0) AS n_audio, coalesce(n_sub, 0) AS n_sub,
    coalesce(n_known_audio, 0) AS n_known_audio, coalesce(n_items, 0) AS n_items,
    coalesce(bytes, 0) AS bytes, coalesce(looped, false) AS looped, runtime
  FROM titles t LEFT JOIN counts USING (title_id) LEFT JOIN istats USING (title_id))"""


NOTABLE_SQL = """(n_video > 0 AND NOT looped AND CASE
    WHEN duration < {minimum} THEN false
    WHEN duration < {plain} THEN n_audio >= 2 OR n_sub >= 1 OR (n_audio = 1 AND n_known_audio = 1)
    ELSE n_audio > 0 END)"""


def drift_sql(tails: str) -> str:
    """Recursive CTE ``moved`` along the clip joins of *tails*: ``track, i, clip, ve, frame, ends, offs``."""
    return f"""tl AS ({tails}),
kept AS (SELECT track, 0 AS i, CAST(NULL AS BIGINT) AS clip, CAST(0 AS BIGINT) AS state, false AS dead, CAST(NULL AS BIGINT) AS drift, CAST(NULL AS BIGINT) AS cut_offset, CAST(NULL AS BIGINT) AS dropped FROM tl GROUP BY 1
  UNION ALL
  SELECT track, i, clip, state, dead OR abs(state) > frame / 2 + 900, CASE WHEN NOT dead THEN state END,
    CASE WHEN NOT dead AND keep < len(ends) THEN list_min(list_transform(list_filter(list_zip(ends, offs), lambda x: x[1] >= ends[keep + 1]), lambda x: x[2])) END,
    CASE WHEN NOT dead THEN CAST(len(ends) - keep AS BIGINT) END
  FROM (SELECT *, CASE WHEN was THEN before ELSE before + ends[keep] + frame - ve END AS state, was AS dead FROM (
    SELECT tl.track, tl.i, tl.clip, tl.ve, tl.frame, tl.ends, tl.offs, kept.state AS before, kept.dead AS was,
      list_max(list_filter(range(1, len(ends) + 1), lambda k: k = 1 OR abs(kept.state + ends[k - 1] + frame - ve) >= abs(kept.state + ends[k] + frame - ve))) AS keep
    FROM kept JOIN tl ON tl.track = kept.track AND tl.i = kept.i + 1)))"""
