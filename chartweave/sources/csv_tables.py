"""CSV source of the table bundle."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.contract import NULL_CELLS, OUTCOME_FIELDS, SOURCE_TABLES, STAY_ID
from chartweave.operators.tables import ROW_ORDER, ROW_ORDER_TYPE

# Receives the cells of a row that has more fields than the header.
_OVERFLOW = "_overflow"
_TOO_LONG = "has a row with more fields than its header"

# An integer column with gaps is often written as 101.0.
_WHOLE_NUMBER = r"^\s*[+-]?\d+(\.0*)?\s*$"
_ANY_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def table_path(raw_dir: str, table: str) -> str:
    """``<raw_dir>/<table>.csv``; a file, or a folder of part files."""
    return f"{str(raw_dir).rstrip('/')}/{table}.csv"


def _options(multiline: bool) -> dict[str, object]:
    # Quotes inside a quoted cell are doubled, not escaped by a backslash.
    return {"header": True, "quote": '"', "escape": '"', "multiLine": multiline}


def _header(spark: SparkSession, path: str, table: str, multiline: bool) -> list[str]:
    """Column names from the first line; no data is read."""
    try:
        columns = spark.read.options(**_options(multiline)).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no file of table '{table}' at {path}") from error
        raise
    if not columns:
        raise ValueError(f"table '{table}' is empty and has no columns: {path}")
    return columns


def _cell(column: str) -> Column:
    quoted = F.col("`" + column.replace("`", "``") + "`")
    return F.when(~quoted.isin(*NULL_CELLS), quoted)


def scan_table(
    spark: SparkSession, path: str, table: str, *, keep_order: bool, multiline: bool
) -> DataFrame:
    """Lazy scan of one file as text columns, null cells applied.

    A row with too few fields is padded with nulls. A row with too many makes
    the query fail when it is read, whichever columns the query needs.
    """
    columns = _header(spark, path, table, multiline)
    _require_stay(columns, table)
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in (*columns, _OVERFLOW))
    rows = spark.read.options(**_options(multiline)).schema(schema).csv(path)
    too_long = F.raise_error(F.lit(f"table '{table}' {_TOO_LONG}: {path}"))
    stay = F.when(F.col(_OVERFLOW).isNull(), _cell(STAY_ID)).otherwise(too_long.cast("string"))
    selected = [
        stay.alias(STAY_ID) if column == STAY_ID else _cell(column).alias(column)
        for column in columns
    ]
    if keep_order:
        # Rows of one split are numbered in order; splits follow their offset.
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        selected.append(place.cast(ROW_ORDER_TYPE).alias(ROW_ORDER))
    return rows.select(*selected)


def _require_stay(columns: Sequence[str], table: str) -> None:
    if STAY_ID not in columns:
        raise ValueError(f"table '{table}' is missing required columns: {STAY_ID}")


def _matches(column: Column, pattern: str) -> Column:
    """Whether every cell that is not null matches."""
    return F.coalesce(F.bool_and(F.when(column.isNotNull(), column.rlike(pattern))), F.lit(True))


def _typed(tables: dict[str, DataFrame], id_type: str) -> dict[str, DataFrame]:
    """Give the stay ids, and the label columns, the type that all their cells have.

    One job over all tables reads the id columns and the label columns there
    are, and returns one row per table. It also meets every row with too many
    fields.
    """
    profiles = []
    for table, frame in tables.items():
        checks = [F.lit(STAY_ID), _matches(F.col(STAY_ID), _WHOLE_NUMBER)]
        for owner, label in OUTCOME_FIELDS:
            if owner == table and label in frame.columns:
                checks += [F.lit(label), _matches(F.col(label), _ANY_NUMBER)]
        profiles.append(
            frame.agg(F.create_map(*checks).alias("numeric")).select(
                F.lit(table).alias("table"), "numeric"
            )
        )
    if not profiles:
        return {}
    try:
        rows = reduce(DataFrame.unionAll, profiles).collect()
    except PySparkException as error:
        said = re.search(rf"table '[^']*' {_TOO_LONG}: \S+", str(error))
        if said is None:
            raise
        raise ValueError(said[0]) from error
    found = {row["table"]: row["numeric"] for row in rows}
    whole = all(numeric[STAY_ID] for numeric in found.values())
    stay_type = id_type if id_type != "auto" else ("bigint" if whole else "string")
    typed = {}
    for table, frame in tables.items():
        types = {c: "double" for c, numeric in found[table].items() if c != STAY_ID and numeric}
        types[STAY_ID] = stay_type
        typed[table] = _cast(frame, types)
    return typed


def _cast(frame: DataFrame, types: dict[str, str]) -> DataFrame:
    def column(name: str) -> Column:
        quoted = F.col("`" + name.replace("`", "``") + "`")
        wanted = types.get(name, "string")
        if name == ROW_ORDER or wanted == "string":
            return quoted
        cell = F.trim(quoted)
        if wanted == "bigint":
            cell = cell.cast("decimal(38,0)")  # takes 101.0 too
        return cell.cast(wanted).alias(name)

    return frame.select(*[column(name) for name in frame.columns])


def _check_lines(spark: SparkSession, paths: dict[str, str]) -> None:
    """Refuse files that the line-wise reader would damage; one pass over their lines.

    A line with an odd number of quotes begins or ends a cell with a line break. Part
    files whose header differs would be read by position under the first one's names.
    """
    counts = []
    for table, path in paths.items():
        lines = spark.read.text(path)
        first = lines.first()
        quotes = F.length("value") - F.length(F.translate("value", '"', ""))
        counts.append(
            lines.groupBy(F.col("_metadata.file_path").alias("file"))
            .agg(
                F.count_if(quotes % 2 == 1).alias("open"),
                F.count_if(F.col("value") == F.lit(first[0] if first else "")).alias("headers"),
            )
            .groupBy()
            .agg(F.sum("open").alias("open"), F.count_if(F.col("headers") == 0).alias("other"))
            .select(F.lit(table).alias("table"), "open", "other")
        )
    if not counts:
        return
    for row in reduce(DataFrame.unionAll, counts).collect():
        if row["open"]:
            raise ValueError(
                f"table '{row['table']}' has line breaks inside quoted cells; pass multiline=True: "
                f"{paths[row['table']]}"
            )
        if row["other"]:
            raise ValueError(f"part files of table '{row['table']}' differ in header: {paths[row['table']]}")


def load_tables(
    spark: SparkSession,
    raw_dir: str,
    tables: Sequence[str] = SOURCE_TABLES,
    *,
    id_type: str = "auto",
    check_rows: bool = True,
    keep_order: bool = True,
    multiline: bool = False,
) -> dict[str, DataFrame]:
    """Read the named tables lazily, in the order asked for.

    Extra columns and repeated stays are kept. All columns are text but for the
    stay id and for label columns whose every cell is a number.

    id_type     ``auto`` reads the ids once and takes ``bigint`` when all are
                whole numbers, else ``string``; naming the type saves the pass
                when ``check_rows`` is off (a bad id then fails the query).
    check_rows  passes over each table before anything is built, so that a malformed
                row, a line break inside a cell (see multiline) or part files with
                different headers stop the caller early with a ValueError; without it such a row fails the
                query that reads it.
    keep_order  remember the place of patient rows in their file; it decides the
                order of the static tokens of a stay with several patient rows.
    multiline   allow line breaks inside quoted cells. Such files cannot be
                split, so keep it off unless the data needs it.
    """
    if id_type not in ("auto", "bigint", "string"):
        raise ValueError("id_type must be auto, bigint or string")
    names = list(tables)
    unknown = [str(name) for name in names if name not in SOURCE_TABLES]
    if unknown:
        raise ValueError(f"unknown table names: {', '.join(unknown)}")
    loaded = {
        name: scan_table(
            spark,
            table_path(raw_dir, name),
            name,
            keep_order=keep_order and name == "patient",
            multiline=multiline,
        )
        for name in names
    }
    if check_rows and not multiline:
        _check_lines(spark, {name: table_path(raw_dir, name) for name in names})
    if check_rows or id_type == "auto":
        return _typed(loaded, id_type)
    return {name: _cast(frame, {STAY_ID: id_type}) for name, frame in loaded.items()}
