"""Who belongs to a cohort, why others don't, and reports without small cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID
from chartweave.functions.labels import outcome_label

#: A stay covers the whole observation window and has so many dynamic events.
MIN_MINUTES, MIN_EVENTS = 1440, 5
ELIGIBLE = "eligible"
RULES = ("missing_id", "unknown_label", "left_early", "few_events")
#: Cells with fewer stays are not shown.
MIN_CELL = 10
OTHER = "OTHER"


def strict_label(status: Column, negative: Sequence[str] = ("alive",), positive: Sequence[str] = ("expired",)) -> Column:
    """0 or 1 by the discharge status alone, without fallbacks; anything else is null."""
    return outcome_label(status, negative=tuple(negative), positive=tuple(positive))


def eligibility(
    stays: DataFrame,
    events: DataFrame,
    ids: Sequence[str] = (STAY_ID, "uniquepid", "hospitalid"),
    label: str = "label",
    minutes: str = "unitdischargeoffset",
    min_minutes: int = MIN_MINUTES,
    min_events: int = MIN_EVENTS,
) -> DataFrame:
    """``stays`` with ``n_events`` and ``rule``: the first rule that a stay breaks, or ``eligible``.

    In this order: an id is missing; the label isn't 0 or 1; the stay ended before ``min_minutes``
    or its end is unknown; it has fewer than ``min_events`` rows in ``events`` (retained dynamic
    events). Events are counted once, before they are joined; stays of ``events`` that ``stays`` lacks
    don't count. Every row of ``stays`` comes back once.
    """
    counts = events.where(F.col(STAY_ID).isNotNull()).groupBy(STAY_ID).agg(F.count(F.lit(1)).alias("n_events"))
    rows = stays.join(counts, STAY_ID, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    missing = F.lit(False)
    for column in ids:
        missing = missing | F.col(column).isNull()
    broken = (
        missing,
        ~F.coalesce(F.col(label).isin(0, 1), F.lit(False)),
        ~F.coalesce(F.col(minutes) >= min_minutes, F.lit(False)),
        F.col("n_events") < min_events,
    )
    rule = F.when(broken[0], RULES[0])
    for name, condition in zip(RULES[1:], broken[1:], strict=True):
        rule = rule.when(condition, name)
    return rows.withColumn("rule", rule.otherwise(F.lit(ELIGIBLE)))


def exclusion_report(judged: DataFrame, label: str = "label") -> DataFrame:
    """``(rule, label, stays)``: how many stays each rule takes out, by label; they add up to all stays."""
    known = F.when(F.col(label).isin(0, 1), F.col(label).cast("string")).otherwise(F.lit("unknown"))
    return judged.groupBy("rule", known.alias("label")).agg(F.count(F.lit(1)).alias("stays"))


def repeated_stays(stays: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(stay, rows, conflicting)`` of stays with several rows; conflicting if these columns differ."""
    facts = F.struct(*columns)
    found = stays.groupBy(STAY_ID).agg(
        F.count(F.lit(1)).alias("rows"), (F.min(facts) != F.max(facts)).alias("conflicting")
    )
    return found.where("rows > 1")


def label_agreement(stays: DataFrame, other: DataFrame, label: str, other_label: str) -> DataFrame:
    """``(label, other_label, stays)``: how two sources of labels agree, as counts alone.

    ``other`` may have several rows a stay; each pair of labels of a stay counts once. Labels other than
    0 and 1, and stays without a row, stand as null.
    """

    def known(frame: DataFrame, column: str, name: str) -> DataFrame:
        return frame.select(STAY_ID, F.when(F.col(column).isin(0, 1), F.col(column).cast("int")).alias(name)).distinct()

    pairs = known(stays, label, "label").join(known(other, other_label, "other_label"), STAY_ID, "left")
    return pairs.groupBy("label", "other_label").agg(F.count(F.lit(1)).alias("stays"))


def table_profile(events: DataFrame, time: str = "event_time") -> DataFrame:
    """One row: rows, stays, rows per stay (median, 95th percentile, most), rows before admission.

    Percentiles are values that occur (nearest rank from below); rows without a stay count as rows only.
    """
    by_stay = events.groupBy(STAY_ID).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(time) < 0).alias("negative")
    )
    own = F.col(STAY_ID).isNotNull()
    # Stays are merged by their number of rows, so the percentiles see few rows.
    sizes = by_stay.groupBy(F.when(own, F.col("rows")).alias("size")).agg(
        F.count_if(own).alias("stays"), F.sum("rows").alias("rows"), F.sum("negative").alias("negative")
    )

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0)).cast("bigint")

    gathered = sizes.agg(
        zero(F.sum("rows")).alias("rows"),
        zero(F.sum("stays")).alias("stays"),
        zero(F.sum("negative")).alias("negative_offsets"),
        F.sort_array(F.collect_list(F.when(F.col("size").isNotNull(), F.struct("size", "stays")))).alias("sizes"),
    )

    def rank(share: float) -> Column:
        """The size at which so large a share of the stays is reached."""
        reached = F.aggregate(
            "sizes",
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("size")),
            lambda s, x: F.struct(
                (s["seen"] + x["stays"]).alias("seen"),
                F.when(s["seen"] < F.col("stays") * F.lit(share), x["size"]).otherwise(s["size"]).alias("size"),
            ),
        )
        return reached["size"]

    return gathered.select(
        "rows",
        "stays",
        rank(0.5).alias("median_rows"),
        rank(0.95).alias("p95_rows"),
        F.array_max("sizes")["size"].alias("max_rows"),
        "negative_offsets",
    )


def suppress_small_cells(
    counts: DataFrame, by: Sequence[str], cell: str, n: str = "stays", minimum: int = MIN_CELL
) -> DataFrame:
    """``(*by, cell, n, cells)`` of a report in which no cell below ``minimum`` can be worked out.

    Within each ``by`` group, cells below the minimum are merged into ``OTHER``, and with them the
    next smallest (ties by name) until ``OTHER`` has at least two cells and the minimum; the group's total
    is unchanged, so it gives nothing back. If even the whole group is below the minimum, or its only
    cell is, its count is null. ``cells`` says how many cells a row stands for. A group without a
    small cell is unchanged. Cells of 0 are small; a cell that is called OTHER merges first.
    """
    wide = Window.partitionBy(*by)
    order = wide.orderBy((F.col(cell) != OTHER).cast("int"), n, cell)
    named = counts.withColumn(cell, F.coalesce(F.col(cell).cast("string"), F.lit("unknown")))
    named = named.groupBy(*by, cell).agg(F.sum(n).alias(n))
    ranked = named.select(
        *by,
        cell,
        n,
        (F.min(n).over(wide) < minimum).alias("__small"),
        F.row_number().over(order).alias("__place"),
        F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    merged = F.col("__small") & ((F.col(n) < minimum) | (F.col("__before") < minimum) | (F.col("__place") <= 2))
    name = F.when(merged, F.lit(OTHER)).otherwise(F.col(cell))
    grouped = ranked.groupBy(*by, name.alias(cell)).agg(F.sum(n).alias(n), F.count(F.lit(1)).alias("cells"))
    return grouped.withColumn(n, F.when(F.col(n) >= minimum, F.col(n)))
