"""The preparation job: CSV tables in, three artifacts out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from chartweave.contract import (
    DEFAULT_MIN_EVENTS,
    DEFAULT_REPRESENTATION,
    OUTCOMES_ARTIFACT,
    STATS_ARTIFACT,
    STREAMS_ARTIFACT,
)
from chartweave.operators.quality import require_valid, statistics_violations
from chartweave.operators.shared_storage import write_through
from chartweave.operators.tables import check_minimum, check_representation
from chartweave.plans.build import plan_event_streams
from chartweave.sources.csv_tables import load_tables
from chartweave.sources.stream_files import (
    write_event_streams_jsonl,
    write_outcomes_csv,
    write_statistics_json,
)


def prepare_streams(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    representation: str = DEFAULT_REPRESENTATION,
    min_events_per_stay: int = DEFAULT_MIN_EVENTS,
    *,
    ordered: bool = True,
    **load_options: object,
) -> tuple[int, int]:
    """Build all artifacts under ``out_dir``; returns (kept, skipped) stays.

    The sequences are computed once, into the shared folder; the artifacts are
    written from there. Nothing under ``out_dir`` changes before loading and
    building have succeeded.
    """
    check_representation(representation)
    check_minimum(min_events_per_stay)
    tables = load_tables(spark, raw_dir, **load_options)
    build = plan_event_streams(tables, representation, min_events_per_stay)
    build = replace(build, sequences=write_through(build.sequences, "sequences"))
    statistics = write_through(build.statistics, "statistics")
    require_valid(statistics_violations(statistics), "statistics")

    out = str(out_dir).rstrip("/")
    write_event_streams_jsonl(
        build.streams, f"{out}/{STREAMS_ARTIFACT}", ordered=ordered
    )
    write_outcomes_csv(build.outcomes, f"{out}/{OUTCOMES_ARTIFACT}", ordered=ordered)
    write_statistics_json(statistics, f"{out}/{STATS_ARTIFACT}")
    counts = statistics.select("kept_stays", "skipped_stays").first()
    return counts["kept_stays"], counts["skipped_stays"]
