"""Typed catalog tables from parquet, with a required-column check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns each catalog table must carry; more are allowed.
REQUIRED = {
    "titles": {"disc_id", "title_id", "title_idx", "duration"},
    "play_items": {"title_id", "pos", "clip_id", "duration"},
    "streams": {"title_id", "pos", "type", "codec", "lang"},
    "marks": {"title_id", "mark_idx", "t"},
    "chains": {"disc_id", "vts", "pgc", "duration", "n_cells"},
    "cells": {"chain_id", "pos", "cell_id", "duration"},
    "atoms": {"edition_id", "atom_idx", "start", "end", "hidden"},
    "ticks": {"stream_id", "seq", "pts"},
    "files": {"group_id", "path", "size"},
}


def require_columns(df: DataFrame, columns: set[str], what: str) -> DataFrame:
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df


def load_catalog(
    spark: SparkSession, folder: str, tables: dict[str, set[str]] | None = None
) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` for ``folder/<name>.parquet``; checked, nothing read yet."""
    wanted = tables if tables is not None else REQUIRED
    return {
        name: require_columns(spark.read.parquet(f"{folder}/{name}.parquet"), columns, name)
        for name, columns in wanted.items()
    }
