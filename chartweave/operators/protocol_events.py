"""The 24-hour protocol's own tokens: static context, sources with reasons, supported quartiles, order and gaps.

Every source row is kept with the reason that leaves it out (null: none), so that one table gives both
the events and the report on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.contract import (
    CATEGORICAL_SOURCES,
    FAMILY_ORDER,
    LAB_SOURCE,
    PROTOCOL_GAPS,
    PROTOCOL_STATIC,
    STAY_ID,
)
from chartweave.functions.numbers import event_time, finite_number
from chartweave.functions.text import age_group, build_token, spaced_text, token_family
from chartweave.operators.numeric import classify_measurements, fit_values, hold_thresholds
from chartweave.operators.protocol import WINDOW
from chartweave.operators.shared_storage import write_through
from chartweave.operators.tables import Tables, column_type, require_columns, union_all

#: Fixed value: measurements need so many values among training stays.
MIN_SUPPORT = 50
#: Supported measurements up to this many are broadcast; more are joined.
MAX_BROADCAST_NAMES = 100_000
KEPT = "kept"
DENSITIES = ("low", "medium", "high")


def static_tokens(patients: DataFrame) -> DataFrame:
    """``(stay, field, token)``: four tokens of each stay, ``UNKNOWN`` where a value is missing.

    Of several rows of a stay the first known value in text order counts. Rows without a stay give
    nothing; a missing column is unknown.
    """
    require_columns(patients, "patient")
    known = {c: age_group(F.col(c)) if c == "age" else spaced_text(F.col(c)) for c, _ in PROTOCOL_STATIC if c in patients.columns}
    rows = patients.where(F.col(STAY_ID).isNotNull()).select(
        STAY_ID, *[known.get(c, F.lit(None).cast("string")).alias(name) for c, name in PROTOCOL_STATIC]
    )
    names = [name for _, name in PROTOCOL_STATIC]
    stays = rows.groupBy(STAY_ID).agg(*[F.coalesce(F.min(n), F.lit("UNKNOWN")).alias(n) for n in names])
    tokens = [F.struct(F.lit(i).alias("field"), build_token("STATIC", n, F.col(n)).alias("token")) for i, n in enumerate(names)]
    return stays.select(STAY_ID, F.inline(F.array(*tokens)))


def _minutes(frame: DataFrame, offset: str) -> Column:
    if offset not in frame.columns:
        return F.lit(None).cast("double")
    return event_time(F.col(offset), column_type(frame, offset))


def _reason(tests: Sequence[tuple[str, Column]], window: tuple[int, int]) -> Column:
    """The first reason against a row of columns stay and event_time."""
    reason = F.when(F.col(STAY_ID).isNull(), "missing_stay")
    for name, fails in tests:
        reason = reason.when(fails, name)
    reason = reason.when(F.col("event_time").isNull(), "no_time")
    return reason.when(~F.col("event_time").between(*window), "outside_window")


def categorical_rows(tables: Tables, window: tuple[int, int] = WINDOW) -> DataFrame | None:
    """``(stay, source, token, event_time, reason)`` of every row of the four text sources.

    A medication without a usable name is known by its ``drughiclseqno`` instead. Reasons, the first
    that holds: missing_stay, unusable_text, no_time, outside_window. Times are whole minutes. None without a source.
    """
    frames = []
    for table, family, text, offset in CATEGORICAL_SOURCES:
        frame = tables.get(table)
        if frame is None:
            continue
        require_columns(frame, table)
        token = build_token(family, spaced_text(F.col(text))) if text in frame.columns else F.lit(None).cast("string")
        if family == "MED" and "drughiclseqno" in frame.columns:
            number = finite_number(F.col("drughiclseqno"), column_type(frame, "drughiclseqno"))
            token = F.coalesce(token, build_token(family, "HICL", number.cast("bigint").cast("string")))
        rows = frame.select(STAY_ID, F.lit(table).alias("source"), token.alias("token"), _minutes(frame, offset).alias("event_time"))
        frames.append(rows.withColumn("reason", _reason([("unusable_text", F.col("token").isNull())], window)))
    if not frames:
        return None
    return union_all(frames).withColumn("event_time", F.floor("event_time").cast("double"))


def lab_values(lab: DataFrame, order: Sequence[str] = (), window: tuple[int, int] = WINDOW) -> DataFrame:
    """``(stay, source, measurement, value, event_time, reason, *order)`` of every lab row.

    Reasons: missing_stay, unusable_name, nonnumeric_value, no_time, outside_window. ``order`` are
    columns that give the source's order, carried for ``protocol.last_per_minute``.
    """
    table, family, name, value, offset = LAB_SOURCE
    require_columns(lab, table, (STAY_ID, name, value))
    rows = lab.select(
        STAY_ID,
        F.lit(table).alias("source"),
        build_token(family, spaced_text(F.col(name))).alias("measurement"),
        finite_number(F.col(value), column_type(lab, value)).alias("value"),
        _minutes(lab, offset).alias("event_time"),
        *order,
    )
    tests = [("unusable_name", F.col("measurement").isNull()), ("nonnumeric_value", F.col("value").isNull())]
    rows = rows.withColumn("reason", _reason(tests, window))
    return rows.select(STAY_ID, "source", "measurement", "value", "event_time", "reason", *order)


def supported_bins(measurements: DataFrame, training: DataFrame, minimum: int = MIN_SUPPORT) -> DataFrame:
    """``(measurement, p25, p50, p75, support)`` fitted on training stays alone.

    ``training`` holds their ids, repeats allowed. Measurements with fewer than ``minimum`` values there
    have no row. Rows without a name or value take no part.
    """
    usable = measurements.where(F.col("measurement").isNotNull() & F.col("value").isNotNull())
    stays = training.select(STAY_ID).distinct()
    values = write_through(usable.join(stays, STAY_ID, "left_semi").select("measurement", "value"), "training-values")
    support = values.groupBy("measurement").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= minimum)
    support = write_through(support, "support")
    few = support.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES
    names = F.broadcast(support) if few else support
    fitted = fit_values(values.join(names.select("measurement"), "measurement", "left_semi"))
    return fitted.join(names, "measurement").select("measurement", "p25", "p50", "p75", "support")


def binned(measurements: DataFrame, bins: DataFrame) -> DataFrame:
    """``(stay, token, event_time, reason)`` of usable measurements; low_support where no bin was fitted."""
    held, count = hold_thresholds(bins)
    rows = classify_measurements(measurements, held, count)
    reason = F.when(F.col("reason") == "unfitted_measurement", "low_support").otherwise(F.col("reason"))
    return rows.select(STAY_ID, "token", "event_time", reason.alias("reason"))


def coverage_report(*sources: DataFrame) -> DataFrame:
    """``(source, reason, rows)``: rows that each source keeps (``kept``) and loses, by reason; they add up to all rows."""
    rows = reduce(DataFrame.unionByName, [s.select("source", "reason") for s in sources])
    return rows.groupBy("source", F.coalesce("reason", F.lit(KEPT)).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def _gap(minutes: Column) -> Column:
    """``TIME_GAP::<bucket>`` between two different minutes, null without one before."""
    bucket = F.when(minutes.isNull(), F.lit(None).cast("string"))
    for upper, name in PROTOCOL_GAPS:
        bucket = bucket.otherwise(F.lit(name)) if upper is None else bucket.when(minutes <= upper, F.lit(name))
    return build_token("TIME_GAP", bucket)


def ordered_events(events: DataFrame) -> DataFrame:
    """``(stay, position, token, event_time)``: distinct events in order, with gap tokens, from position 0.

    Order: minute, family, token. Copies within a minute count once. A gap token stands before the first
    event of each minute but a stay's first one. Families outside the protocol follow the others.
    Rows without stay, token or time give nothing.

    No task needs the events of a stay: minutes are counted first, and a window over a stay sees one
    row a minute, one over a minute its different tokens.
    """
    known = [F.col(c).isNotNull() for c in (STAY_ID, "token", "event_time")]
    minute = F.floor("event_time").cast("double").alias("event_time")
    rows = events.where(known[0] & known[1] & known[2]).select(STAY_ID, "token", minute).distinct()
    along = Window.partitionBy(STAY_ID).orderBy("event_time")
    minutes = (
        rows.groupBy(STAY_ID, "event_time")
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("gap", _gap(F.col("event_time") - F.lag("event_time").over(along)))
        .withColumn("tokens", F.col("events") + F.col("gap").isNotNull().cast("int"))
    )
    before = F.sum("tokens").over(along.rowsBetween(Window.unboundedPreceding, -1))
    minutes = minutes.select(STAY_ID, "event_time", "gap", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.array_position(F.array(*[F.lit(f) for f in FAMILY_ORDER]), token_family(F.col("token")))
    family = F.when(place > 0, place).otherwise(len(FAMILY_ORDER) + 1)
    within = Window.partitionBy(STAY_ID, "event_time").orderBy(family, "token")
    placed = rows.withColumn("rank", F.row_number().over(within)).join(minutes, [STAY_ID, "event_time"])
    position = F.col("start") + F.col("gap").isNotNull().cast("int") + F.col("rank") - 1
    gaps = minutes.where("gap IS NOT NULL").select(STAY_ID, F.col("start").alias("position"), F.col("gap").alias("token"), "event_time")
    return placed.select(STAY_ID, position.alias("position"), "token", "event_time").unionByName(gaps)


def protocol_positions(static: DataFrame, events: DataFrame) -> DataFrame:
    """Streams in long form: static tokens at minute 0 first, then the ordered events of the same stays.

    Stays without static tokens are no members of the cohort and have no stream.
    """
    first = static.select(STAY_ID, F.col("field").cast("bigint").alias("position"), "token", F.lit(0.0).alias("event_time"))
    later = ordered_events(events.join(static.select(STAY_ID).distinct(), STAY_ID, "left_semi"))
    return first.unionByName(later.withColumn("position", F.col("position") + len(PROTOCOL_STATIC)))


def density_cohorts(stays: DataFrame, events: DataFrame, names: Sequence[str] = DENSITIES) -> DataFrame:
    """``(stay, n_events, density)``: strata of stays by their number of events.

    The cuts are exact percentiles over all stays (thirds, for three names), interpolated; a stay at a cut is in the
    lower stratum. Stays without events count with 0. Only the cuts reach the driver.
    """
    counts = events.where(F.col(STAY_ID).isNotNull()).groupBy(STAY_ID).agg(F.count(F.lit(1)).alias("n_events"))
    rows = stays.select(STAY_ID).where(F.col(STAY_ID).isNotNull()).distinct().join(counts, STAY_ID, "left")
    rows = write_through(rows.select(STAY_ID, F.coalesce("n_events", F.lit(0)).alias("n_events")), "densities")
    sizes = rows.groupBy("n_events").agg(F.count(F.lit(1)).alias("stays"))
    shares = [F.lit(i / len(names)) for i in range(1, len(names))]
    cuts = sizes.agg(F.percentile("n_events", F.array(*shares), F.col("stays"))).first()[0] if shares else []
    density = F.lit(names[-1])
    for name, cut in reversed(list(zip(names[:-1], cuts or [], strict=False))):
        density = F.when(F.col("n_events") <= F.lit(cut), F.lit(name)).otherwise(density)
    return rows.withColumn("density", density)
