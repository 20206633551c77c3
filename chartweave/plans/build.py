"""From source tables to event streams, outcomes and statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID
from chartweave.operators.long_streams import LEAST_RANGE, RANGE_VALUES, LongStreams, long_streams
from chartweave.operators.numeric import MAX_RANKED_ROWS, fit_numeric_bins, hold_thresholds
from chartweave.operators.outcomes import DEFAULT_RULES, LabelRules, label_masks
from chartweave.operators.sequences import (
    MAX_ROW_EVENTS,
    about_rows,
    context_rows,
    event_rows,
    kept_sequences,
    label_rows,
    stay_sequences,
    values_per_row,
)
from chartweave.operators.shared_storage import write_through
from chartweave.operators.statistics import event_statistics
from chartweave.operators.tables import (
    Tables,
    check_minimum,
    check_representation,
    check_tables,
    source_rows,
)


# Metadata of a stream that is one range of a longer one.
RANGE_KEYS = ("chunk", "chunks", "start")


@dataclass(frozen=True)
class StreamBuild:
    """Per-stay sequences and the three results that derive from them."""

    sequences: DataFrame
    representation: str
    min_events_per_stay: int

    @property
    def streams(self) -> DataFrame:
        return streams_from_sequences(
            kept_sequences(self.sequences, self.min_events_per_stay), self.representation
        )

    @property
    def outcomes(self) -> DataFrame:
        """``(stay, mortality)``, one row per stream."""
        kept = kept_sequences(self.sequences, self.min_events_per_stay)
        return kept.where(F.col("chunk") == 0).select(STAY_ID, "mortality")

    @property
    def statistics(self) -> DataFrame:
        return event_statistics(self.sequences, self.min_events_per_stay)


def streams_from_sequences(kept: DataFrame, representation: str) -> DataFrame:
    """Streams with parallel token and time arrays.

    A stay that spans several rows says so in its metadata; metadata of all
    others is empty.
    """
    no_metadata = F.create_map().cast("map<string,string>")
    range_metadata = F.create_map(
        *[part for c in RANGE_KEYS for part in (F.lit(c), F.col(c).cast("string"))]
    )
    return kept.select(
        STAY_ID,
        F.col("events.token").alias("events"),
        F.lit(representation).alias("representation"),
        F.col("events.event_time").alias("event_times"),
        F.when(F.col("chunks") > 1, range_metadata).otherwise(no_metadata).alias("metadata"),
    )


def stream_positions(streams: DataFrame) -> DataFrame:
    """Long form ``(stay, position, token, event_time)``; positions start at 0."""
    start = F.try_element_at("metadata", F.lit("start")).cast("bigint")
    return streams.select(
        STAY_ID,
        F.coalesce(start, F.lit(0)).alias("start"),
        F.posexplode(F.arrays_zip("events", "event_times")).alias("offset", "pair"),
    ).select(
        STAY_ID,
        (F.col("start") + F.col("offset")).alias("position"),
        F.col("pair.events").alias("token"),
        F.col("pair.event_times").alias("event_time"),
    )


def plan_event_streams(
    tables: Tables,
    representation: str,
    min_events_per_stay: int,
    *,
    rules: LabelRules = DEFAULT_RULES,
    thresholds: DataFrame | None = None,
    max_row_events: int | None = MAX_ROW_EVENTS,
    max_ranked_rows: int = MAX_RANKED_ROWS,
) -> StreamBuild:
    """Fit (unless thresholds are given) and describe the sequences.

    A few small actions run here, because their results choose the plan: the
    row counts of the tables; the fit, whose table is counted before it may be
    broadcast; and, in tables large enough to have any, the search for stays
    that do not fit in a row.
    """
    check_tables(tables)
    check_representation(representation)
    check_minimum(min_events_per_stay)
    label_masks(tables, rules)  # fails early when there is no label field
    rows = source_rows(tables)
    if thresholds is None:
        thresholds = fit_numeric_bins(tables, max_ranked_rows, rows)
    held, count = hold_thresholds(thresholds)
    sequences = stay_sequences(
        tables,
        held,
        count,
        with_gaps=representation != "basic",
        with_static=representation == "timegap_static",
        rules=rules,
        max_row_events=max_row_events,
        rows=rows,
    )
    return StreamBuild(sequences, representation, min_events_per_stay)


def plan_long_streams(
    tables: Tables,
    representation: str,
    min_events_per_stay: int,
    *,
    rules: LabelRules = DEFAULT_RULES,
    thresholds: DataFrame | None = None,
    max_ranked_rows: int = MAX_RANKED_ROWS,
    range_values: int = RANGE_VALUES,
) -> LongStreams:
    """Positions, outcomes and statistics without an array per stay, whatever its size.

    As ``plan_event_streams`` it fits unless thresholds are given. The number of ranges follows the
    source values of all tables; smaller tables use the session's shuffle partitions.
    """
    check_tables(tables)
    check_representation(representation)
    check_minimum(min_events_per_stay)
    label_masks(tables, rules)  # fails early when there is no label field
    rows = source_rows(tables)
    if thresholds is None:
        thresholds = fit_numeric_bins(tables, max_ranked_rows, rows)
    held, count = hold_thresholds(thresholds)
    values = sum(rows.get(table, 0) * n for table, n in values_per_row(tables).items())
    usual = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-values // range_values), min(usual, -(-values // LEAST_RANGE)))
    context = context_rows(tables) if representation == "timegap_static" else None
    return long_streams(
        event_rows(tables, held, count),
        about_rows(label_rows(tables, rules), context),
        with_gaps=representation != "basic",
        fields=len(rules.fields),
        min_events_per_stay=min_events_per_stay,
        ranges=ranges,
    )


def build_event_streams(
    tables: Tables, representation: str, min_events_per_stay: int, **options: object
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Streams, aligned outcomes and one row of statistics; see ``plan_event_streams``.

    The sequences are written once to the shared folder, and the three read them. There is
    one stream and one outcome per kept stay, unless ``max_row_events`` asks for bounded rows.
    """
    build = plan_event_streams(tables, representation, min_events_per_stay, **options)
    build = replace(build, sequences=write_through(build.sequences, "sequences"))
    return build.streams, build.outcomes, build.statistics
