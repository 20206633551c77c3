"""Helpers that several operators of this package use."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartweave.operators.shared_storage import shared_folder, write_through

#: Up to this many keys of a few dozen bytes may be broadcast; more are shuffled.
MAX_BROADCAST_KEYS = 1_000_000

ROW_KEY = ["__file", "__row"]

#: Rows of texts travel to Python in Arrow batches of about so many bytes, or of one row.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send Arrow batches of BATCH_BYTES at most, unless the session asks for less.

    Spark's default of 64 MB, twice a core in the executor and once more in the worker, is memory
    that long texts fill.
    """
    before = spark.conf.get(_BATCH_CONF, None)
    size = int(re.match(r"-?\d+", before or "-1").group())
    if before is None or size <= 0 or not before.rstrip("bB").isdigit() or size > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)


def write_batched(frame: DataFrame, name: str) -> DataFrame:
    """``write_through`` for a table whose tasks send texts to Python."""
    with short_batches(frame.sparkSession):
        return write_through(frame, name)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (case does not matter)."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame) -> DataFrame:
    """All columns of a table as one struct ``row``, so that no name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a file scan, else a copy written to the shared folder."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  analyses the plan
    except AnalysisException:
        return write_through(docs, "rows")
    return docs


def identified(docs: DataFrame) -> DataFrame:
    """Columns __file, __row and row: a stable key for each row, and the row itself.

    The key is the place in the file, so that repeated rows and missing ids stay
    apart and a recomputed task finds the same keys. To get the same keys twice, pass
    a table that ``located`` has returned.
    """
    docs = located(docs)
    place = docs.metadataColumn("_metadata")
    return docs.select(
        F.xxhash64(place["file_path"]).alias("__file"),
        place["row_index"].alias("__row"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )


def restricted(frame: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``frame`` whose key is in ``keys``; the keys are counted before a broadcast."""
    keys = write_through(keys.select(*on).distinct(), "keys")
    return frame.join(hinted(keys), on, "left_semi")


def hinted(table: DataFrame) -> DataFrame:
    """A written table of short rows, to be broadcast if it has few of them."""
    small = table.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    return F.broadcast(table) if small else table


def dropping(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``rows`` whose key is not in ``keys``; the keys are counted before a broadcast."""
    keys = write_batched(keys.select(*on), "dropped")
    return rows.join(hinted(keys), on, "left_anti")


def without_space(text: Column) -> Column:
    """A text (null: empty) without the characters ``[\\x20\\x09-\\x0D]``."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")


def fresh_path(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/chartweave/{name}-{uuid.uuid4().hex}"


__all__ = [
    "BATCH_BYTES",
    "MAX_BROADCAST_KEYS",
    "ROW_KEY",
    "dropping",
    "fresh_path",
    "hinted",
    "identified",
    "located",
    "packed",
    "restricted",
    "short_batches",
    "unused",
    "without_space",
    "write_batched",
    "write_through",
]
