"""Checks and helpers for the bundle of source tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.contract import (
    CATEGORICAL_SOURCES,
    LAB_SOURCE,
    REPRESENTATIONS,
    STAY_ID,
)

Tables = Mapping[str, DataFrame]

# Optional column that keeps the order of the rows in their source file.
ROW_ORDER = "_row_order"
ROW_ORDER_TYPE = "struct<file:string,block:bigint,row:bigint>"


def check_tables(tables: object) -> None:
    if not isinstance(tables, Mapping):
        raise ValueError("tables must map table names to DataFrames")


def check_representation(representation: object) -> None:
    if representation not in REPRESENTATIONS:
        raise ValueError(f"representation must be one of {', '.join(REPRESENTATIONS)}")


def check_minimum(min_events_per_stay: object) -> None:
    whole = isinstance(min_events_per_stay, int) and not isinstance(min_events_per_stay, bool)
    if not whole or min_events_per_stay < 1:
        raise ValueError("min_events_per_stay must be a positive integer")


def require_columns(frame: DataFrame, table: str, columns: Sequence[str] = (STAY_ID,)) -> None:
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"table '{table}' is missing required columns: {', '.join(missing)}")


def column_type(frame: DataFrame, column: str) -> T.DataType:
    return frame.schema[column].dataType


def stay_key() -> Column:
    return F.col(STAY_ID)


def stay_type(tables: Tables) -> str:
    """SQL type of the stay ids; bigint when no table has any."""
    for frame in tables.values():
        if STAY_ID in frame.columns:
            return column_type(frame, STAY_ID).simpleString()
    return "bigint"


def empty_like(tables: Tables, columns: str) -> DataFrame:
    """No rows, with the stay id typed as in the tables."""
    schema = f"{STAY_ID} {stay_type(tables)}, {columns}"
    return SparkSession.active().createDataFrame([], schema)


def covered_by_events(tables: Tables) -> set[str]:
    """Tables whose every row with a stay id yields at least one event row."""
    covered = {
        table
        for table, _, text, _ in CATEGORICAL_SOURCES
        if table in tables and text in tables[table].columns
    }
    table, _, _, value, _ = LAB_SOURCE
    if table in tables and value in tables[table].columns:
        covered.add(table)
    return covered


def source_rows(tables: Tables) -> dict[str, int]:
    """Rows of every table, from one job that reads no column it can avoid."""
    names = [
        frame.select(F.lit(table).alias("table")) for table, frame in tables.items()
    ]
    if not names:
        return {}
    counted = reduce(DataFrame.unionAll, names).groupBy("table").count().collect()
    return {row["table"]: row["count"] for row in counted}


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by name; mixing text and number stay ids is an error.

    Left to itself the union would compare "101" with 101 as equal texts.
    """
    kinds = {isinstance(column_type(frame, STAY_ID), T.StringType) for frame in frames}
    if len(kinds) > 1:
        raise ValueError(f"{STAY_ID} must be text in every table or a number in every table")
    return reduce(DataFrame.unionByName, frames)


def stay_universe(tables: Tables) -> DataFrame:
    """Distinct non-null stay ids over every table of the bundle.

    Tables without a stay column do not take part. The distinct runs map-side
    first, so a hot stay reaches the shuffle once per task.
    """
    check_tables(tables)
    ids = [
        frame.select(STAY_ID).where(stay_key().isNotNull())
        for frame in tables.values()
        if STAY_ID in frame.columns
    ]
    if not ids:
        return SparkSession.active().createDataFrame([], f"{STAY_ID} bigint")
    return union_all(ids).distinct()
