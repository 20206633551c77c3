"""Numeric events: long lab rows, unpivoted vitals, quartile fit and transform."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.contract import (
    LAB_SOURCE,
    QUARTILE_PROBABILITIES,
    STAY_ID,
    VITAL_FAMILY,
    VITAL_OFFSET,
    VITAL_TABLES,
)
from chartweave.functions.numbers import event_time, finite_number, quartile_bin
from chartweave.functions.text import build_token, normalize_name, normalize_text
from chartweave.operators.shared_storage import write_through
from chartweave.operators.tables import (
    ROW_ORDER,
    Tables,
    check_tables,
    column_type,
    empty_like,
    require_columns,
    source_rows,
    stay_key,
    union_all,
)

# Values of one measurement that a single task may sort (24 MB of doubles); above
# it the fit first narrows every quartile to a small interval.
MAX_RANKED_ROWS = 3_000_000
# Rows of the threshold table that may be broadcast (about 100 bytes each).
MAX_BROADCAST_MEASUREMENTS = 100_000
# Copies of a threshold row when the table is too large to broadcast.
THRESHOLD_SALTS = 64
# Half width, in probability, of the interval that the sketch proposes.
_BRACKET = 0.001
_SKETCH_ACCURACY = 2_000

_EDGES = ("p25", "p50", "p75")


def vital_columns(frame: DataFrame) -> list[str]:
    """Measured columns of a wide table: all but ids and offsets."""
    return [
        column
        for column in frame.columns
        if column not in (STAY_ID, VITAL_OFFSET, ROW_ORDER)
        and not column.casefold().endswith(("id", "offset"))
    ]


def lab_rows(tables: Tables) -> DataFrame | None:
    """``(stay, measurement, value, event_time)`` of the long numeric source."""
    table, family, name, value, offset = LAB_SOURCE
    frame = tables.get(table)
    if frame is None:
        return None
    require_columns(frame, table)
    if value not in frame.columns:
        return None
    part = normalize_text(F.col(name)) if name in frame.columns else F.lit(None).cast("string")
    minutes = (
        event_time(F.col(offset), column_type(frame, offset))
        if offset in frame.columns
        else F.lit(None).cast("double")
    )
    return frame.where(stay_key().isNotNull()).select(
        STAY_ID,
        build_token(family, part).alias("measurement"),
        finite_number(F.col(value), column_type(frame, value)).alias("value"),
        minutes.alias("event_time"),
    )


def vital_rows(tables: Tables, table: str, *, sparse: bool = False) -> DataFrame | None:
    """Unpivot of one wide table: one row per stay, instant and measured column.

    ``sparse`` leaves out unusable cells, but for the first cell of every row,
    which keeps the stay.
    """
    frame = tables.get(table)
    if frame is None:
        return None
    require_columns(frame, table)
    columns = vital_columns(frame)
    if not columns:
        return None
    minutes = (
        event_time(F.col(VITAL_OFFSET), column_type(frame, VITAL_OFFSET))
        if VITAL_OFFSET in frame.columns
        else F.lit(None).cast("double")
    )
    cells = []
    for position, column in enumerate(columns):
        part = normalize_name(column)
        name = F.lit(None).cast("string") if part is None else build_token(VITAL_FAMILY, part)
        quoted = F.col("`" + column.replace("`", "``") + "`")
        cells.append(
            F.struct(
                name.alias("measurement"),
                finite_number(quoted, column_type(frame, column)).alias("value"),
                F.lit(position == 0).alias("opens"),
            )
        )
    rows = frame.where(stay_key().isNotNull()).select(
        STAY_ID, minutes.alias("event_time"), F.inline(F.array(*cells))
    )
    if sparse:
        usable = F.col("measurement").isNotNull() & F.col("value").isNotNull()
        rows = rows.where(usable | F.col("opens"))
    return rows.select(STAY_ID, "measurement", "value", "event_time")


def measurement_rows(tables: Tables, *, sparse: bool = False) -> DataFrame:
    """Every candidate value; null measurement or value marks an unusable one."""
    check_tables(tables)
    vitals = [vital_rows(tables, table, sparse=sparse) for table in VITAL_TABLES]
    rows = [lab_rows(tables), *vitals]
    present = [frame for frame in rows if frame is not None]
    if not present:
        return empty_like(tables, "measurement string, value double, event_time double")
    return union_all(present)


def _usable(measurements: DataFrame) -> DataFrame:
    return measurements.select("measurement", "value").where(
        F.col("measurement").isNotNull() & F.col("value").isNotNull()
    )


def _between(lower: Column, upper: Column, fraction: Column) -> Column:
    """Linear interpolation, taken from the nearer end."""
    step = upper - lower
    return F.when(fraction < 0.5, lower + step * fraction).otherwise(
        upper - step * (1 - fraction)
    )


def _ranks(total: Column) -> list[tuple[Column, Column, Column]]:
    """Lower rank, upper rank and fraction of every quartile edge."""
    ranks = []
    for probability in QUARTILE_PROBABILITIES:
        place = (total - 1) * F.lit(probability)
        lower = F.floor(place)
        ranks.append((lower, F.ceil(place), place - lower))
    return ranks


def _thresholds_by_rank(values: DataFrame) -> DataFrame:
    """Exact edges of measurements of checked size: sort the values, look up the ranks."""
    ordered = values.groupBy("measurement").agg(
        F.sort_array(F.collect_list("value")).alias("ordered")
    )
    picks = []
    for edge, (lower, upper, fraction) in zip(_EDGES, _ranks(F.size("ordered"))):
        picks += [
            F.get("ordered", lower).alias(f"{edge}_lower"),
            F.get("ordered", upper).alias(f"{edge}_upper"),
            fraction.alias(f"{edge}_fraction"),
        ]
    return ordered.select("measurement", *picks).select("measurement", *_interpolated())


def _interpolated() -> list[Column]:
    return [
        _between(
            F.col(f"{edge}_lower"), F.col(f"{edge}_upper"), F.col(f"{edge}_fraction")
        ).alias(edge)
        for edge in _EDGES
    ]


def _thresholds_by_interval(values: DataFrame, measurements: int) -> DataFrame:
    """Exact edges of measurements with any number of distinct values.

    A sketch proposes a narrow interval around each quartile; the six ends cut
    the number line into seven intervals. Exact counts say which interval holds
    each wanted rank, and only the values of those intervals are ranked. A bad
    proposal makes an interval larger, never the result wrong. No step brings a
    whole measurement to one task: sketches, counts and value counts all merge
    map-side, and the last window sees one interval of one measurement.
    """
    ends = [p + side * _BRACKET for p in QUARTILE_PROBABILITIES for side in (-1, 1)]
    proposed = values.groupBy("measurement").agg(
        F.percentile_approx("value", ends, _SKETCH_ACCURACY).alias("ends"),
        F.count("*").alias("total"),
    )
    value = F.col("value")
    interval = F.when(value < F.col("ends")[0], 0)
    for index in range(1, 6):
        end = F.col("ends")[index]
        interval = interval.when(value <= end if index % 2 else value < end, index)
    placed = join_thresholds(values, proposed, measurements).select(
        "measurement", "value", interval.otherwise(6).alias("interval")
    )

    sizes = placed.groupBy("measurement").agg(
        *[F.count_if(F.col("interval") == i).alias(f"n{i}") for i in range(7)]
    )
    starts = [F.lit(0).cast("bigint")]
    for i in range(7):
        starts.append(starts[-1] + F.col(f"n{i}"))
    total = starts[7]

    def holder(rank: Column) -> Column:
        """Interval that holds a rank, and the rank inside it."""
        found = F.lit(None)
        for i in reversed(range(7)):
            here = F.struct(F.lit(i).alias("interval"), (rank - starts[i]).alias("rank"))
            found = F.when(rank >= starts[i], here) if i == 6 else F.when(
                (rank >= starts[i]) & (rank < starts[i + 1]), here
            ).otherwise(found)
        return found

    wanted = []
    for edge, (lower, upper, fraction) in zip(_EDGES, _ranks(total)):
        wanted += [
            holder(lower).alias(f"{edge}_lower_at"),
            holder(upper).alias(f"{edge}_upper_at"),
            fraction.alias(f"{edge}_fraction"),
        ]
    places = [f"{edge}_{end}" for edge in _EDGES for end in ("lower", "upper")]
    targets = sizes.select("measurement", *wanted)

    needed = F.array(*[F.col(f"{place}_at.interval") for place in places])
    kept = join_thresholds(
        placed, targets.select("measurement", needed.alias("needed")), measurements
    ).where(F.array_contains("needed", F.col("interval")))
    counts = kept.groupBy("measurement", "interval", "value").agg(F.count("*").alias("copies"))
    running = (
        Window.partitionBy("measurement", "interval")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counts.select(
        "measurement",
        "interval",
        "value",
        F.sum("copies").over(running).alias("last"),
        (F.sum("copies").over(running) - F.col("copies")).alias("first"),
    )
    picks = []
    for place in places:
        at = F.col(f"{place}_at")
        inside = (
            (F.col("interval") == at["interval"])
            & (F.col("first") <= at["rank"])
            & (at["rank"] < F.col("last"))
        )
        picks.append(F.max(F.when(inside, F.col("value"))).alias(place))
    fractions = [F.max(f"{edge}_fraction").alias(f"{edge}_fraction") for edge in _EDGES]
    return (
        join_thresholds(ranked, targets, measurements)
        .groupBy("measurement")
        .agg(*picks, *fractions)
        .select("measurement", *_interpolated())
    )


def join_thresholds(rows: DataFrame, lookup: DataFrame, measurements: int) -> DataFrame:
    """Left join of value rows with a per-measurement table of known size.

    A small table is broadcast. A larger one is repeated ``THRESHOLD_SALTS``
    times and joined on a salted key, which splits a hot measurement.
    """
    if measurements <= MAX_BROADCAST_MEASUREMENTS:
        return rows.join(F.broadcast(lookup), "measurement", "left")
    # The input split takes part, so that copies of one row spread as well.
    row_hash = F.xxhash64(F.spark_partition_id(), *[F.col(column) for column in rows.columns])
    salt = F.pmod(row_hash, F.lit(THRESHOLD_SALTS))
    copies = F.explode(F.sequence(F.lit(0), F.lit(THRESHOLD_SALTS - 1)))
    return (
        rows.withColumn("_salt", salt.cast("int"))
        .join(lookup.withColumn("_salt", copies), ["measurement", "_salt"], "left")
        .drop("_salt")
    )


def fit_values(values: DataFrame, max_ranked_rows: int = MAX_RANKED_ROWS) -> DataFrame:
    """Quartile edges of a ``(measurement, value)`` table without nulls.

    One action measures the largest group and picks the way; both ways are exact
    and interpolate linearly between neighbouring values.
    """
    sizes = values.groupBy("measurement").agg(F.count("*").alias("rows"))
    largest, measurements = sizes.agg(F.max("rows"), F.count("*")).first()
    if (largest or 0) <= max_ranked_rows:
        return _thresholds_by_rank(values)
    return _thresholds_by_interval(values, measurements)


def candidate_rows(tables: Tables, rows: Mapping[str, int]) -> int:
    """How many values the numeric sources can supply at most."""
    vitals = sum(
        rows.get(table, 0) * len(vital_columns(tables[table]))
        for table in VITAL_TABLES
        if table in tables
    )
    return rows.get(LAB_SOURCE[0], 0) + vitals


def fit_numeric_bins(
    tables: Tables,
    max_ranked_rows: int = MAX_RANKED_ROWS,
    rows: Mapping[str, int] | None = None,
) -> DataFrame:
    """Quartile thresholds per measurement: ``(measurement, p25, p50, p75)``.

    The fit looks at every usable row of every stay, before de-duplication.
    ``rows`` are the counts of ``source_rows`` when the caller has them; if all
    values together fit the sort, the groups need no measuring.
    """
    values = _usable(measurement_rows(tables))
    if rows is None:
        numeric = (LAB_SOURCE[0], *VITAL_TABLES)
        rows = source_rows({name: tables[name] for name in numeric if name in tables})
    if candidate_rows(tables, rows) <= max_ranked_rows:
        return _thresholds_by_rank(values)
    return fit_values(values, max_ranked_rows)


def hold_thresholds(thresholds: DataFrame) -> tuple[DataFrame, int]:
    """Write a fitted table to the shared folder and count it.

    The table is small next to the data it took to fit. Written, it is fixed,
    a lost executor does not cost another fit, and later plans do not carry the
    fit along. A measurement may stand in one row only. Its exact count decides between the broadcast and the salted join.
    """
    held = write_through(thresholds.select("measurement", *_EDGES), "thresholds")
    count, names = held.agg(F.count(F.lit(1)), F.count_distinct("measurement")).first()
    if held.where("measurement IS NULL").limit(1).count() or names != count:
        raise ValueError("thresholds need one row for each measurement")
    return held, count


def classify_measurements(
    measurements: DataFrame, thresholds: DataFrame, threshold_count: int
) -> DataFrame:
    """Add the token and, where there is none, the reason of the first failed test."""
    joined = join_thresholds(measurements, thresholds, threshold_count)
    reason = (
        F.when(F.col("measurement").isNull(), F.lit("missing_measurement"))
        .when(F.col("value").isNull(), F.lit("nonnumeric_value"))
        .when(F.col("p25").isNull(), F.lit("unfitted_measurement"))
    )
    label = quartile_bin(F.col("value"), F.col("p25"), F.col("p50"), F.col("p75"))
    return joined.select(
        STAY_ID,
        "measurement",
        "event_time",
        reason.alias("reason"),
        build_token(F.col("measurement"), label).alias("token"),
    )


def numeric_counters(classified: DataFrame) -> DataFrame:
    """One row of counters; repeats of an event count as candidates only.

    Grouping by the whole event spreads a hot stay or measurement, and each kind
    of skipped row is a single group that merges map-side.
    """
    used = F.col("reason").isNull()
    groups = classified.groupBy(
        "reason",
        F.when(used, F.col(STAY_ID)).alias("stay"),
        F.when(used, F.col("token")).alias("token"),
        F.when(used, F.col("event_time")).alias("event_time"),
    ).agg(F.count("*").alias("rows"))

    def skipped(reason: str) -> Column:
        rows = F.sum(F.when(F.col("reason") == reason, F.col("rows")))
        return F.coalesce(rows, F.lit(0)).alias(f"skipped_{reason}")

    return groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("candidate_values"),
        F.count_if(used).alias("emitted_events"),
        skipped("missing_measurement"),
        skipped("nonnumeric_value"),
        skipped("unfitted_measurement"),
    )


def extract_numeric_events(
    tables: Tables, thresholds: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Distinct numeric events ``(stay, token, event_time)`` and their counters."""
    check_tables(tables)
    if not isinstance(thresholds, DataFrame):
        raise ValueError("thresholds must be a DataFrame of measurement, p25, p50, p75")
    require_columns(thresholds, "thresholds", ("measurement", *_EDGES))
    held, count = hold_thresholds(thresholds)
    classified = classify_measurements(measurement_rows(tables), held, count)
    events = (
        classified.where(F.col("reason").isNull())
        .select(STAY_ID, "token", "event_time")
        .distinct()
    )
    return events, numeric_counters(classified)
