"""Per-stay sequences: one exchange by stay, then work inside the row.

All facts about a stay (clinical events, static tokens, label masks, the mere
existence of a row) form one long table. It is shuffled once by stay; there the
events are collected as a set, which de-duplicates them, sorted, and completed
with gap tokens. Outcomes, the universe of stays and the lengths fall out of
the same aggregation, so no join follows.

A stay whose events would not fit in a row is taken out beforehand: its
distinct events are range-partitioned by stay, time and token, and what a stay
has in a range is cut into rows. Nothing is dropped, capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID, VITAL_TABLES
from chartweave.functions.labels import decided_label, deciding_state
from chartweave.functions.numbers import gap_token
from chartweave.operators.categorical import clinical_rows, static_events, static_rows
from chartweave.operators.long_streams import LEAST_RANGE
from chartweave.operators.numeric import classify_measurements, measurement_rows, vital_columns
from chartweave.operators.outcomes import LabelRules, label_masks
from chartweave.operators.shared_storage import write_through
from chartweave.operators.tables import (
    ROW_ORDER,
    Tables,
    covered_by_events,
    source_rows,
    stay_key,
    union_all,
)

# A stay is one row at every size, unless a caller asks for rows of bounded size.
MAX_ROW_EVENTS: int | None = None
# Events of one range of hot stays, and the most that a row of theirs may have.
RANGE_EVENTS = 100_000
# Rows of a table about hot stays (ids, ranges) that may be broadcast.
MAX_BROADCAST_ROWS = 500_000

# Sort key of an event without a time: after every finite one.
_NO_TIME = float("inf")

# One row per stay, or per piece of a hot stay:
#   state      deciding label state of the stay
#   chunk      number of the piece, 0 for ordinary stays
#   chunks     pieces of the stay
#   start      tokens of the stay before this row
#   n_events   tokens of the whole stay
#   events     array of (token, event_time)
SEQUENCE_COLUMNS = (STAY_ID, "state", "chunk", "chunks", "start", "n_events", "events")


@dataclass(frozen=True)
class HotStays:
    """Stays that need more than one row, with the sizes that bound the work."""

    ids: DataFrame
    count: int
    values: int


def values_per_row(tables: Tables) -> dict[str, int]:
    """Source values that one row of each table with stay ids holds."""
    return {
        table: len(vital_columns(frame)) if table in VITAL_TABLES else 1
        for table, frame in tables.items()
        if STAY_ID in frame.columns
    }


def find_hot_stays(
    tables: Tables,
    max_row_events: int | None = MAX_ROW_EVENTS,
    rows: Mapping[str, int] | None = None,
) -> HotStays | None:
    """Stays with more source values than a row may hold, or None; None without a limit.

    When all tables together hold no more than that, nothing needs counting.
    Otherwise the id columns are read and counted map-side. At most (all values
    / ``max_row_events``) stays can qualify, which bounds the list.
    """
    if max_row_events is None:
        return None
    values = values_per_row(tables)
    rows = source_rows(tables) if rows is None else rows
    if sum(rows.get(table, 0) * n for table, n in values.items()) <= max_row_events:
        return None
    loads = union_all(
        [
            tables[table].where(stay_key().isNotNull()).select(STAY_ID, F.lit(n).alias("n"))
            for table, n in values.items()
        ]
    )
    hot = loads.groupBy(STAY_ID).agg(F.sum("n").alias("n")).where(F.col("n") > max_row_events)
    count, total = hot.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return None
    return HotStays(write_through(hot.select(STAY_ID), "hot-stays"), count, total)


def event_rows(tables: Tables, thresholds: DataFrame, threshold_count: int) -> DataFrame:
    """``(stay, moment, token)`` of all clinical sources, one row per source value.

    A null token only says that the stay exists.
    """
    measurements = measurement_rows(tables, sparse=True)
    numeric = classify_measurements(measurements, thresholds, threshold_count)
    sources = [frame.select(STAY_ID, "token", "event_time") for frame in clinical_rows(tables)]
    sources.append(numeric.select(STAY_ID, "token", "event_time"))
    return union_all(sources).select(
        STAY_ID, F.coalesce("event_time", F.lit(_NO_TIME)).alias("moment"), "token"
    )


def label_rows(tables: Tables, rules: LabelRules) -> DataFrame:
    """``(stay, mask)`` of the label tables and of all that supply no event rows."""
    masks = label_masks(tables, rules)
    with_events = covered_by_events(tables) | {
        table for table in VITAL_TABLES if table in tables and vital_columns(tables[table])
    }
    return union_all(
        [
            frame.where(stay_key().isNotNull()).select(
                STAY_ID, masks.get(table, F.lit(None).cast("int")).alias("mask")
            )
            for table, frame in tables.items()
            if STAY_ID in frame.columns and (table in masks or table not in with_events)
        ]
    )


def context_rows(tables: Tables) -> DataFrame | None:
    """``(stay, context)``: static tokens with the key that orders them."""
    patient = tables.get("patient")
    if patient is None:
        return None
    if ROW_ORDER in patient.columns:
        # The first occurrence of a token decides its place.
        rows = static_events(tables)
        return rows and rows.select(
            STAY_ID, F.struct("row_order", "field", "token").alias("context")
        )
    rows = static_rows(tables)
    return rows and rows.select(STAY_ID, F.struct("field", "token").alias("context"))


def about_rows(labels: DataFrame, context: DataFrame | None) -> DataFrame:
    """``(stay, mask[, context])``: all that is known of a stay but its events."""
    if context is None:
        return labels
    return labels.unionByName(context, allowMissingColumns=True)


def fact_rows(events: DataFrame, about: DataFrame) -> DataFrame:
    """One long table ``(stay, event, mask[, context])``."""
    event = F.when(F.col("token").isNotNull(), F.struct("moment", "token"))
    timed = events.select(STAY_ID, event.alias("event"))
    return timed.unionByName(about, allowMissingColumns=True)


def _timed(token: Column, moment: Column) -> Column:
    return F.struct(token.alias("token"), F.nullif(moment, F.lit(_NO_TIME)).alias("event_time"))


def _with_gaps(events: Column, carried: Column | None = None) -> Column:
    """Put a gap token, at the later time, between events of different time.

    ``carried`` is the last time before the first event. Events without a time
    come last and have no gap before them.
    """

    def expand(event: Column, index: Column) -> Column:
        moment = event["moment"]
        before = F.get(events, index - 1)["moment"]
        if carried is not None:
            before = F.when(index == 0, carried).otherwise(before)
        apart = (before < moment) & (moment < _NO_TIME)
        own = _timed(event["token"], moment)
        gap = _timed(gap_token(moment - before), moment)
        return F.when(apart, F.array(gap, own)).otherwise(F.array(own))

    return F.flatten(F.transform(events, expand))


def _without_gaps(events: Column) -> Column:
    return F.transform(events, lambda event: _timed(event["token"], event["moment"]))


def _static_prefix(context: Column) -> Column:
    return F.transform(context, lambda part: _timed(part["token"], F.lit(_NO_TIME)))


def ordinary_sequences(facts: DataFrame, with_gaps: bool, fields: int) -> DataFrame:
    """Sequences of stays that fit in a row: the single exchange of the build."""
    with_context = "context" in facts.columns
    collected = [
        F.sort_array(F.collect_set("event")).alias("timeline"),
        F.bit_or("mask").alias("mask"),
    ]
    if with_context:
        collected.append(F.sort_array(F.collect_set("context")).alias("context"))
    stays = facts.repartition(STAY_ID).groupBy(STAY_ID).agg(*collected)
    timeline = F.col("timeline")
    events = _with_gaps(timeline) if with_gaps else _without_gaps(timeline)
    if with_context:
        events = F.concat(_static_prefix(F.col("context")), events)
    return stays.select(
        STAY_ID,
        deciding_state(F.col("mask"), fields).alias("state"),
        F.lit(0).alias("chunk"),
        F.lit(1).alias("chunks"),
        events.alias("events"),
    ).select(
        STAY_ID,
        "state",
        "chunk",
        "chunks",
        F.lit(0).cast("bigint").alias("start"),
        F.size("events").cast("bigint").alias("n_events"),
        "events",
    )


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= MAX_BROADCAST_ROWS else frame


def _joined_tables(tables: Tables, ids: DataFrame, how: str) -> dict[str, DataFrame]:
    """The rows of the stays in ``ids``, or of all others; tables without stay ids stay as they are."""
    return {
        table: frame.join(ids, STAY_ID, how) if STAY_ID in frame.columns else frame
        for table, frame in tables.items()
    }


def hot_sequences(
    events: DataFrame,
    about: DataFrame,
    hot: HotStays,
    max_row_events: int,
    with_gaps: bool,
    fields: int,
) -> DataFrame:
    """Sequences of hot stays, each split into pieces of ordered events.

    ``events`` and ``about`` are those of hot stays alone.

    The distinct events are hashed on stay, time and token together (copies
    merge map-side), then range-partitioned on the same columns, so that any
    stay, instant or null time splits evenly. The ranges are written once; from
    there on they are plain data. What crosses a range (the last time before
    it, the pieces before it, the length of the stay) comes from one summary row
    a stay and range. The number of ranges follows the values of all hot stays,
    never the size of a row: a range holds many stays, and cuts what it has of
    each into pieces.
    """
    piece_events = min(RANGE_EVENTS, max(1, max_row_events // 2))
    usual = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(
        2, math.ceil(hot.values / RANGE_EVENTS), min(usual, math.ceil(hot.values / LEAST_RANGE))
    )
    small_rows = ranges + hot.count
    # Counted in the groups: a filter on the token would build it once more, for every row.
    distinct = (
        events.groupBy(STAY_ID, "moment", "token")
        .agg(F.count("token").alias("usable"))
        .where(F.col("usable") > 0)
        .drop("usable")
    )
    ranged = write_through(
        distinct.repartitionByRange(ranges, STAY_ID, "moment", "token").withColumn(
            "part", F.spark_partition_id()
        ),
        "hot-ranges",
    )

    finite = F.when(F.col("moment") < _NO_TIME, F.col("moment"))
    by_part = Window.partitionBy(STAY_ID).orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy(STAY_ID, "part")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct(finite).alias("instants"),
            F.min(finite).alias("first_moment"),
            F.max(finite).alias("last_moment"),
        )
        .withColumn("carried", F.max("last_moment").over(before))
    )
    opened = F.coalesce((F.col("carried") < F.col("first_moment")).cast("int"), F.lit(0))
    gaps = F.greatest(F.col("instants") - 1 + opened, F.lit(0)) if with_gaps else F.lit(0)
    stay = Window.partitionBy(STAY_ID)
    length = F.col("rows") + gaps
    pieces = F.ceil(length / piece_events)
    parts = parts.select(
        STAY_ID,
        "part",
        "carried",
        F.coalesce(F.sum(pieces).over(before), F.lit(0)).cast("int").alias("chunk"),
        F.sum(pieces).over(stay).cast("int").alias("chunks"),
        F.coalesce(F.sum(length).over(before), F.lit(0)).alias("earlier"),
        F.sum(length).over(stay).alias("dynamic_events"),
    )

    timelines = ranged.groupBy(STAY_ID, "part").agg(
        F.sort_array(F.collect_list(F.struct("moment", "token"))).alias("timeline")
    )
    with_context = "context" in about.columns
    known = [F.bit_or("mask").alias("mask")]
    if with_context:
        known.append(F.sort_array(F.collect_set("context")).alias("context"))
    known_rows = about.groupBy(STAY_ID).agg(*known)
    stays = hot.ids.join(known_rows, STAY_ID, "left")
    if with_context:
        no_context = F.array().cast(stays.schema["context"].dataType)
        stays = stays.withColumn("context", F.coalesce("context", no_context))
    rows = timelines.join(_small(parts, small_rows), [STAY_ID, "part"]).join(
        # A hot stay may have no event at all; it still counts.
        _small(stays, hot.count),
        STAY_ID,
        "right",
    )
    timeline = F.coalesce("timeline", F.array().cast(timelines.schema["timeline"].dataType))
    rows = rows.withColumn("timeline", timeline)
    events = (
        _with_gaps(F.col("timeline"), F.col("carried"))
        if with_gaps
        else _without_gaps(F.col("timeline"))
    )
    rows = rows.withColumn("events", events)
    starts = F.sequence(F.lit(0), F.greatest(F.size("events") - 1, F.lit(0)), F.lit(piece_events))
    pieces = F.transform(starts, lambda at: F.slice(F.col("events"), at + 1, piece_events))
    about_stay = ["mask", "chunks", "dynamic_events", *(["context"] if with_context else [])]
    rows = rows.select(
        STAY_ID,
        *about_stay,
        F.coalesce("chunk", F.lit(0)).alias("first_chunk"),
        "earlier",
        F.posexplode(pieces).alias("piece", "events"),
    ).withColumn("chunk", F.col("first_chunk") + F.col("piece"))
    prefix = F.size("context") if with_context else F.lit(0)
    events = F.col("events")
    if with_context:
        static = F.when(F.col("chunk") == 0, _static_prefix(F.col("context"))).otherwise(
            F.array().cast("array<struct<token:string,event_time:double>>")
        )
        events = F.concat(static, events)
    start = F.col("earlier") + F.col("piece") * F.lit(piece_events) + prefix
    return rows.select(
        STAY_ID,
        deciding_state(F.col("mask"), fields).alias("state"),
        "chunk",
        F.coalesce("chunks", F.lit(1)).alias("chunks"),
        F.when(F.col("chunk") > 0, start).otherwise(F.lit(0)).alias("start"),
        (F.coalesce("dynamic_events", F.lit(0)) + prefix).alias("n_events"),
        events.alias("events"),
    )


def stay_sequences(
    tables: Tables,
    thresholds: DataFrame,
    threshold_count: int,
    *,
    with_gaps: bool,
    with_static: bool,
    rules: LabelRules,
    max_row_events: int | None = MAX_ROW_EVENTS,
    rows: Mapping[str, int] | None = None,
) -> DataFrame:
    """Rows of ``SEQUENCE_COLUMNS`` for every stay of every table."""
    fields = len(rules.fields)

    def rows_of(some: Tables) -> tuple[DataFrame, DataFrame]:
        context = context_rows(some) if with_static else None
        return event_rows(some, thresholds, threshold_count), about_rows(label_rows(some, rules), context)

    hot = find_hot_stays(tables, max_row_events, rows)
    if hot is None:
        return ordinary_sequences(fact_rows(*rows_of(tables)), with_gaps, fields)
    # Rows are dealt before tokens are built, so that no token is built twice.
    ids = _small(hot.ids, hot.count)
    ordinary = fact_rows(*rows_of(_joined_tables(tables, ids, "left_anti")))
    return ordinary_sequences(ordinary, with_gaps, fields).unionByName(
        hot_sequences(
            *rows_of(_joined_tables(tables, ids, "left_semi")), hot, max_row_events, with_gaps, fields
        )
    )


def kept_sequences(sequences: DataFrame, min_events_per_stay: int) -> DataFrame:
    """Sequences of labelled stays with enough tokens, gap and static ones counted."""
    return (
        sequences.withColumn("mortality", decided_label(F.col("state")).cast("int"))
        .where(F.col("mortality").isNotNull())
        .where(F.col("n_events") >= min_events_per_stay)
    )
