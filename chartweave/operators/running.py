"""Running totals over a global order, without a window over a whole group.

Rows are range-partitioned on group and order and written once. One summary row a range gives
what lies before it; only the rows of one range meet in a window. A group of any size is thus
dealt to as many tasks as it needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.operators.shared_storage import write_through

#: Rows of one range, about.
RANGE_ROWS = 1_000_000
#: Summary rows of ranges that may be broadcast.
MAX_BROADCAST_RANGES = 500_000

_PART = "__part"


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [left[n].eqNullSafe(right[n]) for n in names])


def running_totals(
    rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str]
) -> DataFrame:
    """``rows`` with ``<name>_before`` for each summed column: its total over earlier rows of the group.

    ``order`` has to be total within a group, or the result of ties is arbitrary. Groups may be
    null; so may sums, which then count nothing. Without ``by`` all rows are one group.
    """
    rows = write_through(rows, "unranked")
    parts = max(1, math.ceil(rows.count() / RANGE_ROWS))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    if parts == 1:
        own = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[F.coalesce(F.sum(s).over(own), F.lit(0)).alias(f"{s}_before") for s in sums])
    # The sampled ends of ranges must not change when a task is repeated, so the ranges are written.
    ranged = rows.repartitionByRange(parts, *by, *order).withColumn(_PART, F.spark_partition_id())
    ranged = write_through(ranged, "ranges")
    across = before.partitionBy(*by).orderBy(_PART)
    totals = ranged.groupBy(*by, _PART).agg(*[F.sum(s).alias(s) for s in sums])
    carried = totals.select(
        *by, _PART, *[F.coalesce(F.sum(s).over(across), F.lit(0)).alias(f"__{s}") for s in sums]
    )
    carried = write_through(carried, "carried")
    few = carried.limit(MAX_BROADCAST_RANGES + 1).count() <= MAX_BROADCAST_RANGES
    own = before.partitionBy(*by, _PART).orderBy(*order)
    inside = ranged.select("*", *[F.coalesce(F.sum(s).over(own), F.lit(0)).alias(f"{s}_before") for s in sums])
    joined = inside.join(F.broadcast(carried) if few else carried, _same(inside, carried, [*by, _PART]))
    return joined.select(
        *[inside[c] for c in rows.columns],
        *[(inside[f"{s}_before"] + carried[f"__{s}"]).alias(f"{s}_before") for s in sums],
    )


def dense_ids(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with a bigint column: 0 for the first in order, then 1, and so on."""
    counted = running_totals(rows.withColumn("__one", F.lit(1).cast("bigint")), [], order, ["__one"])
    return counted.withColumnRenamed("__one_before", name).drop("__one")
