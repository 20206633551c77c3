"""Streams in long form: one row per position of a stay, built without an array per stay.

The distinct events and static tokens of all stays are range-partitioned on stay, time and
token, so a stay of any size is dealt to as many tasks as it needs. What crosses a range (the last
time before it, the positions taken so far) comes from one summary row per stay and range; windows
see the rows of one stay in one range only. Lengths, outcomes and statistics derive from the summary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.contract import EVENT_FAMILIES, STAY_ID
from chartweave.functions.labels import decided_label, deciding_state
from chartweave.functions.numbers import gap_token
from chartweave.functions.text import token_family
from chartweave.operators.shared_storage import write_through
from chartweave.operators.statistics import statistics_from_counts

#: Source values of one range, about.
RANGE_VALUES = 1_000_000
#: Below that a range isn't worth a task.
LEAST_RANGE = 10_000

# Sort keys of static tokens and of events without a time, around all finite times.
_STATIC, _NO_TIME = float("-inf"), float("inf")


@dataclass(frozen=True)
class LongStreams:
    """Written rows and summaries of all stays; the results derive from them.

    ranged: stay, moment, context, token, part, distinct; a null token only says that the stay exists.
    parts: stay, part, carried (last time before), earlier (positions before), gaps and length (of the part),
        and for each family the tokens of the part, gap tokens apart.
    stays: stay, state, n_events, for every stay of every table.
    """

    ranged: DataFrame
    parts: DataFrame
    stays: DataFrame
    with_gaps: bool
    min_events_per_stay: int

    @property
    def kept(self) -> DataFrame:
        """``(stay, mortality, n_events)`` of labelled stays with enough tokens."""
        label = decided_label(F.col("state")).cast("int")
        stays = self.stays.select(STAY_ID, label.alias("mortality"), "n_events")
        return stays.where(F.col("mortality").isNotNull() & (F.col("n_events") >= self.min_events_per_stay))

    @property
    def outcomes(self) -> DataFrame:
        """``(stay, mortality)`` of kept stays."""
        return self.kept.select(STAY_ID, "mortality")

    @property
    def positions(self) -> DataFrame:
        """``(stay, position, token, event_time)`` of kept stays; positions start at 0."""
        kept = self.parts.join(self.kept.select(STAY_ID), STAY_ID, "left_semi")
        rows = self.ranged.where(F.col("token").isNotNull()).join(kept, [STAY_ID, "part"])
        own = Window.partitionBy(STAY_ID, "part").orderBy("moment", "context", "token")
        moment = F.col("moment")
        timed = (moment > _STATIC) & (moment < _NO_TIME)
        time = F.when(timed, moment)
        rows = rows.withColumn("row", F.row_number().over(own) - 1)
        if not self.with_gaps:
            place = (F.col("earlier") + F.col("row")).alias("position")
            return rows.select(STAY_ID, place, "token", time.alias("event_time"))
        previous = F.lag(time).over(own)
        rows = rows.withColumn("before", F.coalesce(previous, F.col("carried")))
        rows = rows.withColumn("apart", F.coalesce(timed & (F.col("before") < moment), F.lit(False)))
        gaps = F.sum(F.col("apart").cast("bigint")).over(own.rowsBetween(Window.unboundedPreceding, 0))
        place = F.col("earlier") + F.col("row") + gaps
        rows = rows.select(
            STAY_ID, place.alias("position"), "token", time.alias("event_time"), "before", "apart"
        )
        gap = F.struct(
            (F.col("position") - 1).alias("position"),
            gap_token(F.col("event_time") - F.col("before")).alias("token"),
            "event_time",
        )
        event = F.struct("position", "token", "event_time")
        both = F.when(F.col("apart"), F.array(gap, event)).otherwise(F.array(event))
        return rows.select(STAY_ID, F.explode(both).alias("event")).select(STAY_ID, "event.*")

    @property
    def statistics(self) -> DataFrame:
        """One row, as ``event_statistics`` gives it."""
        # All tokens are counted by the summary, so no row is read again.
        kept_parts = self.parts.join(self.kept.select(STAY_ID), STAY_ID, "left_semi")
        counted = kept_parts.agg(*[F.sum(c).alias(c) for c in (*EVENT_FAMILIES, "gaps")])
        own = [F.struct(F.lit(f).alias("family"), F.col(f).alias("rows")) for f in EVENT_FAMILIES]
        gap_family = token_family(gap_token(F.lit(1.0))).alias("family")
        families = F.array(*own, F.struct(gap_family, F.col("gaps").alias("rows")))
        tokens = counted.select(F.inline(families)).select(
            "family",
            F.lit(True).alias("kept"),
            F.lit(False).alias("first"),
            F.lit(None).cast("bigint").alias("length"),
            "rows",
        )
        kept = F.coalesce(
            decided_label(F.col("state")).isNotNull() & (F.col("n_events") >= self.min_events_per_stay),
            F.lit(False),
        )
        stays = (
            self.stays.groupBy(kept.alias("kept"), F.when(kept, F.col("n_events")).alias("length"))
            .agg(F.count("*").alias("rows"))
            .select(F.lit(None).cast("string").alias("family"), "kept", F.lit(True).alias("first"), "length", "rows")
        )
        return statistics_from_counts(tokens.unionByName(stays))


def long_streams(
    events: DataFrame, about: DataFrame, *, with_gaps: bool, fields: int, min_events_per_stay: int, ranges: int
) -> LongStreams:
    """``events`` as ``event_rows``, ``about`` as ``about_rows`` give them, in ``ranges`` ranges.

    Two tables are written: the distinct rows in their ranges, whose sampled ends must not
    change when a task is repeated, and one summary row per stay and range.
    """
    columns = [STAY_ID, "moment", "token"]
    rows = events.select(*columns)
    if "context" in about.columns:
        static = about.where(F.col("context").isNotNull()).select(
            STAY_ID, F.lit(_STATIC).alias("moment"), F.col("context.token").alias("token"), "context"
        )
        rows = rows.unionByName(static, allowMissingColumns=True)
    else:
        rows = rows.withColumn("context", F.lit(None).cast("string"))
    order = [STAY_ID, "moment", "context", "token"]
    ranged = rows.distinct().repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    ranged = write_through(ranged, "stream-ranges")

    finite = F.when((F.col("moment") > _STATIC) & (F.col("moment") < _NO_TIME), F.col("moment"))
    finite = F.when(F.col("token").isNotNull(), finite)
    by_part = Window.partitionBy(STAY_ID).orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    family = F.col("family")
    parts = (
        ranged.withColumn("family", token_family(F.col("token")))
        .groupBy(STAY_ID, "part", finite.alias("instant"))
        .agg(F.count("token").alias("rows"), *[F.count_if(family == f).alias(f) for f in EVENT_FAMILIES])
        .groupBy(STAY_ID, "part")
        .agg(
            F.sum("rows").alias("rows"),
            F.count("instant").alias("instants"),
            F.min("instant").alias("first"),
            F.max("instant").alias("last"),
            *[F.sum(f).alias(f) for f in EVENT_FAMILIES],
        )
        .withColumn("carried", F.max("last").over(before))
    )
    opened = F.coalesce((F.col("carried") < F.col("first")).cast("int"), F.lit(0))
    gaps = F.greatest(F.col("instants") - 1 + opened, F.lit(0)) if with_gaps else F.lit(0)
    parts = parts.withColumn("gaps", gaps.cast("bigint")).withColumn("length", F.col("rows") + F.col("gaps"))
    earlier = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("earlier")
    parts = parts.select(STAY_ID, "part", "carried", earlier, "gaps", "length", *EVENT_FAMILIES)
    parts = write_through(parts, "stream-parts")

    # Every stay of every table: those with rows, and those that only the label tables know.
    known = parts.select(STAY_ID, F.lit(None).cast("int").alias("mask"), "length").unionByName(
        about.select(STAY_ID, F.col("mask").cast("int").alias("mask")), allowMissingColumns=True
    )
    stays = known.groupBy(STAY_ID).agg(
        F.bit_or("mask").alias("mask"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_events")
    )
    stays = stays.select(STAY_ID, deciding_state(F.col("mask"), fields).alias("state"), "n_events")
    return LongStreams(ranged, parts, stays, with_gaps, min_events_per_stay)
