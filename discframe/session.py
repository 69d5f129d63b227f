"""Session settings and the one place that decides where checkpoints go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Rows of one group that a single task handles comfortably.  Groups above it are
# split into ordered blocks (operators.ordered) or folded block by block.
GROUP_ROWS_CONF = "spark.discframe.groupRows"
GROUP_ROWS_DEFAULT = 2_000_000

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming folds keep their state there.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Catalog rows are narrow in a shuffle and wide in a sort: small partitions, and more of them
# the more there is to shuffle, keep what a task sorts in memory.  Settings of the session win.
_PARTITIONS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
}


def small_partitions(spark: SparkSession) -> SparkSession:
    """Let adaptive execution size shuffle partitions for the catalog operators (idempotent)."""
    for name, value in _PARTITIONS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on (idempotent)."""
    for name, value in _RUNTIME.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def session(master: str | None = None, app: str = "discframe") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in _RUNTIME.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(GROUP_ROWS_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, as ``spark.checkpoint.dir`` names it.

    A private folder is made only for a single-machine session where nothing is set, and
    removed when this process ends.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    global _private_folder
    if _private_folder is None:
        _private_folder = tempfile.mkdtemp(prefix="discframe-")
        atexit.register(shutil.rmtree, _private_folder, ignore_errors=True)
    return _private_folder


_private_folder: str | None = None

#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _tables_of(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/discframe-tables/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """*df* written once as a table in the shared folder and read back.

    Later steps start from files any executor can read, so a lost executor costs a
    re-read and not the whole lineage; columnar files also keep sizes known to the
    planner and let later steps prune columns.  The shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = f"{_tables_of(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if _spent:
        _spent[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def cut_result(build: Callable[[], DataFrame]) -> DataFrame:
    """What *build* makes, written once; the tables written on the way there are removed.

    Nothing else may read those afterwards.  Calls nest, so each step of a long job can
    leave one table behind.
    """
    _spent.append([])
    try:
        df = build()
        way = _spent[-1]
        _spent[-1] = []
        out = cut_lineage(df)
        for path in way:
            _remove(df.sparkSession, path)
        kept = _spent[-1]
    finally:
        _spent.pop()
    if _spent:
        _spent[-1] += kept
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes *tables* as ``cut_lineage`` returned them; nothing may read them afterwards."""
    for table in tables:
        _remove(table.sparkSession, table._written_to)


#: The tables written inside each ``cut_result`` that is still building.
_spent: list[list[str]] = []


def drop_tables(spark: SparkSession) -> None:
    """Removes the tables that ``cut_lineage`` wrote for this application.

    Results that were built but not yet read become unreadable: call it when a job is done.
    """
    _remove(spark, _tables_of(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
