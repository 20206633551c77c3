"""Streams, outcomes and statistics as files: JSON lines, CSV, JSON.

A sink is a folder of part files that replaces what was there. Whole times are
written as ``60.0``, which JSON readers take for the same number as ``60``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID
from chartweave.operators.quality import broken_rules, stream_rules

_REQUIRED = (STAY_ID, "events", "representation")
_CORRUPT = "_corrupt"
# Kinds of problem, per file, that an error message names.
_REPORTED = 10


def _stay_order() -> Column:
    """Stays sort by the text of their id, so "1001" comes before "101"."""
    return F.col(STAY_ID).cast("string")


def stream_json(streams: DataFrame) -> Column:
    """One JSON object per stream: keys in alphabetical order, nulls kept."""
    keys = sorted((STAY_ID, "events", "representation", "event_times", "metadata"))
    return F.to_json(F.struct(*[F.col(key) for key in keys]), {"ignoreNullFields": "false"})


def write_event_streams_jsonl(
    streams: DataFrame, path: str, *, min_events_per_stay: int = 1, ordered: bool = True
) -> None:
    """Write streams as JSON lines; an invalid stream fails the write.

    The rules are tested in the same pass that writes. ``ordered`` sorts the
    output by stay over all part files, which costs a range exchange.
    """
    line = stream_json(streams)
    for rule, holds, _ in stream_rules(streams, min_events_per_stay):
        failed = F.raise_error(F.lit(f"invalid event stream: {rule}")).cast("string")
        line = F.when(F.coalesce(holds, F.lit(False)), line).otherwise(failed)
    if ordered:
        chunk = F.coalesce(F.try_element_at("metadata", F.lit("chunk")).cast("int"), F.lit(0))
        streams = streams.orderBy(_stay_order(), chunk)
    streams.select(line.alias("value")).write.mode("overwrite").text(path)


def streams_from_records(records: DataFrame) -> DataFrame:
    """Streams from rows with at least the required fields; defaults filled in."""
    missing = sorted(set(_REQUIRED) - set(records.columns))
    if missing:
        raise ValueError(f"serialized event stream is missing: {', '.join(missing)}")
    times = F.col("event_times") if "event_times" in records.columns else F.lit(None)
    metadata = F.col("metadata") if "metadata" in records.columns else F.lit(None)
    return records.select(
        STAY_ID,
        "events",
        "representation",
        times.cast("array<double>").alias("event_times"),
        F.coalesce(
            metadata.cast("map<string,string>"), F.create_map().cast("map<string,string>")
        ).alias("metadata"),
    )


def read_event_streams_jsonl(
    spark: SparkSession, path: str, id_type: str = "bigint"
) -> DataFrame:
    """Read streams and insist on every line; blank lines are skipped.

    One pass counts the lines that are no record or break a rule, per file; the
    streams themselves are read lazily.
    """
    schema = (
        f"{STAY_ID} {id_type}, events array<string>, representation string, "
        f"event_times array<double>, metadata map<string,string>, {_CORRUPT} string"
    )
    lines = (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(
            F.col("_metadata.file_name").alias("file"),
            F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT}).alias("record"),
        )
    )
    records = lines.select("file", "record.*")
    rules = [("json", F.col(_CORRUPT).isNull(), F.lit(None))]
    rules += [
        (name, F.col(_CORRUPT).isNotNull() | holds, detail)
        for name, holds, detail in stream_rules(records)
    ]
    broken = (
        records.select("file", F.inline(broken_rules(rules)))
        .groupBy("file", "rule")
        .count()
        .orderBy("file", "rule")
        .limit(_REPORTED + 1)
        .collect()
    )
    if broken:
        places = ", ".join(f"{row['file']}: {row['rule']} ({row['count']})" for row in broken[:_REPORTED])
        places += ", and more" if len(broken) > _REPORTED else ""
        raise ValueError(f"invalid event streams in {path}: {places}")
    return streams_from_records(records)


def write_outcomes_csv(outcomes: DataFrame, path: str, *, ordered: bool = True) -> None:
    """``patientunitstayid,mortality`` with a header, also when there is no row."""
    rows = outcomes.select(STAY_ID, "mortality")
    if ordered:
        rows = rows.orderBy(_stay_order())
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_statistics_json(statistics: DataFrame, path: str) -> None:
    """One JSON object with keys in alphabetical order, the family map included."""
    ordered_map = F.map_from_entries(F.sort_array(F.map_entries("token_family_counts")))
    columns = [
        ordered_map.alias(c) if c == "token_family_counts" else F.col(c)
        for c in sorted(statistics.columns)
    ]
    statistics.select(*columns).coalesce(1).write.mode("overwrite").json(path)
