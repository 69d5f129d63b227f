"""What the corpus operators share: tables, word patterns and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.session import cut_lineage

__all__ = ["cut_lineage", "id_field", "lower_ascii", "map_rows", "one_or_more_words", "read", "spaces", "text_of", "upper_ascii"]

upper_ascii = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
spaces = " \t\n\x0b\x0c\r"
#: One word of a text: a run of anything but ASCII white space.
one_or_more_words = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, upper_ascii, upper_ascii.lower())


def id_field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


def map_rows(
    df: DataFrame, fn: Callable[[dict], Iterable[tuple]], schema: T.StructType, rows: int = 2000
) -> DataFrame:
    """*fn* over each row (as a dict), Arrow batch by Arrow batch.

    Batches are cut to *rows* rows, so long texts do not pile up in one worker.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                out = [x for row in part.to_pylist() for x in fn(row)]
                if out:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*out), target)]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)
