"""Run registered queries beside their DuckDB oracles: ``python tests/compare.py SF [name...]``."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).hex()
    return value


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = canonical(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(got)} (no oracle)", took
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = canonical(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    if got == want:
        return True, f"rows={len(got)}", took
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return False, f"rows {len(got)} vs {len(want)}\n   got  {only_got}\n   want {only_want}", took


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from discframe.session import drop_tables

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("SHARED_FOLDER") or tempfile.mkdtemp(prefix="shared-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if "GROUP_ROWS" in os.environ:
        spark.conf.set("spark.discframe.groupRows", os.environ["GROUP_ROWS"])
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            lines = str(error).splitlines()
            ok, note, took = False, f"{type(error).__name__}: " + " | ".join(lines[:6])[:900], 0.0
        if not ok:
            bad.append(name)
        drop_tables(spark)
        print(f"{'ok ' if ok else 'BAD'} {name} {took:.1f}s {note}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
