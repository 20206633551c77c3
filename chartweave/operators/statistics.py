"""Summary statistics of built sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.contract import EVENT_FAMILIES, STAY_ID
from chartweave.functions.labels import decided_label
from chartweave.functions.text import token_family


def _kept(min_events_per_stay: int) -> Column:
    labelled = decided_label(F.col("state")).isNotNull()
    return labelled & (F.col("n_events") >= min_events_per_stay)


def event_statistics(sequences: DataFrame, min_events_per_stay: int) -> DataFrame:
    """One row: stays total, kept and skipped, lengths, tokens per family.

    A single pass over the sequences reduces them to counts per family and
    length; every field, the exact median included, comes from those counts.
    """
    kept = _kept(min_events_per_stay)
    tokens = F.when(kept, F.col("events.token"))
    opened = sequences.select(
        kept.alias("kept"),
        "n_events",
        (F.col("chunk") == 0).alias("opens"),
        F.posexplode_outer(tokens).alias("position", "token"),
    )
    # A stay is counted at the first token of its first row.
    first = F.col("opens") & F.coalesce(F.col("position") == 0, F.lit(True))
    counts = opened.groupBy(
        token_family(F.col("token")).alias("family"),
        "kept",
        first.alias("first"),
        F.when(first & F.col("kept"), F.col("n_events")).alias("length"),
    ).agg(F.count("*").alias("rows"))
    return statistics_from_counts(counts)


def statistics_from_counts(counts: DataFrame) -> DataFrame:
    """The one row of statistics from counted ``(family, kept, first, length, rows)``.

    ``first`` marks what counts a stay; ``length`` is set there if the stay is kept.
    """
    rows = F.col("rows")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0))

    lengths = F.when(F.col("length").isNotNull(), rows).otherwise(F.lit(0))
    families = []
    for family in EVENT_FAMILIES:
        families += [F.lit(family), total(F.col("family") == family)]
    return counts.agg(
        total(F.col("first")).alias("total_stays"),
        total(F.col("first") & F.col("kept")).alias("kept_stays"),
        total(F.col("first") & ~F.col("kept")).alias("skipped_stays"),
        F.coalesce(F.min("length"), F.lit(0)).alias("min_sequence_length"),
        F.coalesce(F.max("length"), F.lit(0)).alias("max_sequence_length"),
        F.coalesce(F.percentile("length", F.lit(0.5), lengths), F.lit(0.0)).alias(
            "median_sequence_length"
        ),
        F.create_map(*families).alias("token_family_counts"),
    )


def family_counts(statistics: DataFrame) -> DataFrame:
    """The family map of the statistics as one row per family."""
    return statistics.select(F.explode("token_family_counts").alias("family", "tokens"))


def exclusions(sequences: DataFrame, min_events_per_stay: int) -> DataFrame:
    """``(stay, reason)`` of the stays that the minimum or a missing label removes."""
    state = F.col("state")
    reason = (
        F.when(state.isNull(), F.lit("unavailable_label"))
        .when(state == 3, F.lit("conflicting_label"))
        .when(F.col("n_events") < min_events_per_stay, F.lit("too_few_events"))
    )
    return (
        sequences.where(F.col("chunk") == 0)
        .select(STAY_ID, reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )
