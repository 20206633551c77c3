"""Events and sequences of the 24-hour protocol: windows, hourly medians, last values, the length cap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.contract import GAP_BUCKETS, STAY_ID, TOKEN_SEPARATOR
from chartweave.functions.text import token_family

#: The observation window and bucket in minutes, the vitals used, the longest sequence.
WINDOW = (0, 1440)
BUCKET = 60
VITALS = (
    "VITAL::TEMPERATURE",
    "VITAL::SAO2",
    "VITAL::HEARTRATE",
    "VITAL::RESPIRATION",
    "VITAL::NONINVASIVESYSTOLIC",
    "VITAL::NONINVASIVEDIASTOLIC",
    "VITAL::NONINVASIVEMEAN",
)
MAX_TOKENS = 256


def within_window(events: DataFrame, time: str = "event_time", window: tuple[int, int] = WINDOW) -> DataFrame:
    """Events from the first to the last minute of the window, both included; no time, no event."""
    return events.where(F.col(time).between(*window))


def hourly_medians(
    measurements: DataFrame,
    variables: Sequence[str] | None = VITALS,
    bucket: int = BUCKET,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """``(stay, measurement, value, event_time)``: one median per stay, variable and bucket of time.

    Buckets start at the window's first minute; a median stands at the last whole minute of its bucket, or
    at the window's last minute if that comes first. Values without a time, outside the window, null
    or not finite take no part, nor do other variables (None: all take part). Of an even number of
    values it is the mean of the middle two. Buckets without a value give nothing.
    """
    infinity = float("inf")
    rows = within_window(measurements, window=window).where(
        F.col("measurement").isNotNull()
        & (F.col("value") < infinity)  # NaN is above it
        & (F.col("value") > -infinity)
    )
    if variables is not None:
        rows = rows.where(F.col("measurement").isin(*variables))
    first, last = window
    number = F.floor((F.col("event_time") - first) / bucket)
    # The middle values from below and from above; equal values merge before the shuffle.
    low = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)")
    high = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)")
    medians = rows.groupBy(STAY_ID, "measurement", number.alias("bucket")).agg(low.alias("low"), high.alias("high"))
    end = F.least((F.col("bucket") + 1) * bucket - 1 + first, F.lit(last))
    return medians.select(
        STAY_ID, "measurement", ((F.col("low") + F.col("high")) / 2).alias("value"), end.cast("double").alias("event_time")
    )


def last_per_minute(measurements: DataFrame, order: Sequence[str]) -> DataFrame:
    """``(stay, measurement, value, event_time)``: the last usable value of each whole minute.

    ``order`` names columns that give the order of the source (file and row, or a running id); they
    have to be total within a minute, and are all that decides, so splitting a file changes nothing.
    Rows without measurement, value or time take no part. Copies merge before the shuffle.
    """
    usable = [F.col(c).isNotNull() for c in ("measurement", "value", "event_time")]
    rows = measurements.where(usable[0] & usable[1] & usable[2])
    minute = F.floor("event_time").alias("minute")
    last = F.max_by(F.struct("value", "event_time"), F.struct(*order)).alias("last")
    return rows.groupBy(STAY_ID, "measurement", minute).agg(last).select(STAY_ID, "measurement", "last.*")


def _spread(kept: int, size: int) -> list[int]:
    """Evenly spread ranks from the first to the last."""
    return [i * (size - 1) // max(kept - 1, 1) for i in range(kept)]


def _gap(before: float | None, time: float | None) -> str | None:
    """The gap token between two events; none between equal times, or without a time."""
    if before is None or time is None or time <= before:
        return None
    names = [name for upper, name in GAP_BUCKETS if upper is None or time - before <= upper]
    return f"TIME_GAP{TOKEN_SEPARATOR}{names[0]}"


def capped_events(
    events: list[str], times: list[float | None], max_tokens: int, with_gaps: bool
) -> tuple[list[str], list[float | None]]:
    """The tokens and times of one stream that stay under the cap; see ``cap_streams``."""
    family = [token.split(TOKEN_SEPARATOR)[0] for token in events]
    static = [i for i, name in enumerate(family) if name == "STATIC"]
    dynamic = [i for i, name in enumerate(family) if name not in ("STATIC", "TIME_GAP")]
    ends = min(2, len(dynamic))
    kept = max(ends, min(len(dynamic), max_tokens - len(static)))
    while True:
        chosen = [dynamic[r] for r in _spread(kept, len(dynamic))]
        gaps = [None, *[_gap(times[a], times[b]) if with_gaps else None for a, b in zip(chosen, chosen[1:])]]
        excess = len(static) + kept + sum(gap is not None for gap in gaps) - max_tokens
        if excess <= 0 or kept <= ends:
            break
        kept = max(ends, kept - excess)
    tokens, moments = [events[i] for i in static], [times[i] for i in static]
    for i, gap in zip(chosen, gaps):
        tokens += [gap, events[i]] if gap else [events[i]]
        moments += [times[i]] * (2 if gap else 1)
    return tokens, moments


def _capped(max_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events, times = batch.column("events"), batch.column("event_times")
            if any(int(n or 0) > max_tokens for n in events.value_lengths().to_pylist()):
                rows = [
                    capped_events(e, t, max_tokens, r != "basic") if e is not None and len(e) > max_tokens else (e, t)
                    for e, t, r in zip(events.to_pylist(), times.to_pylist(), batch.column("representation").to_pylist())
                ]
                for place, name in enumerate(("events", "event_times")):
                    at = batch.schema.get_field_index(name)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array([r[place] for r in rows], batch.schema.field(at).type))
            yield batch

    return run


def cap_streams(streams: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Streams of at most ``max_tokens`` tokens, static and gap tokens counted; shorter ones unchanged.

    All static tokens stay, and the first and last dynamic one. The dynamic ones between are chosen
    evenly over their ranks; gap tokens are made anew from the times that are left. As long as that is too
    long, as many dynamic tokens fewer are chosen, again evenly over all. If the static tokens leave
    no room, the stream keeps them and its two ends, though that is longer.

    The choice is a loop inside the row, over a stream that is one row already. Streams are rows with arrays ``events`` and ``event_times``, those of ``basic`` without gaps. A stay
    that is split over several rows is refused: its ranges can't be chosen one by one.
    """
    split = F.coalesce(F.try_element_at("metadata", F.lit("chunks")).cast("int"), F.lit(1)) > 1
    events = F.when(split, F.raise_error(F.lit("a stay in several rows can't be capped"))).otherwise(F.col("events"))
    rows = streams.withColumn("events", events.cast("array<string>"))
    return rows.mapInArrow(_capped(max_tokens), rows.schema)


def retained_families(original: DataFrame, capped: DataFrame) -> DataFrame:
    """``(family, original, retained)``: tokens of each family before and after the cap."""

    def counts(streams: DataFrame, name: str) -> DataFrame:
        tokens = streams.select(F.explode("events").alias("token"))
        return tokens.groupBy(token_family(F.col("token")).alias("family")).agg(F.count(F.lit(1)).alias(name))

    joined = counts(original, "original").join(counts(capped, "retained"), "family", "left")
    return joined.fillna(0, ["retained"])
