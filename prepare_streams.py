"""Prepare event streams from CSV tables: spark-submit prepare_streams.py --help"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from chartweave.contract import DEFAULT_MIN_EVENTS, DEFAULT_REPRESENTATION, REPRESENTATIONS
from chartweave.operators.tables import check_minimum
from chartweave.plans.prepare import prepare_streams


def arguments(argv: list[str] | None) -> argparse.Namespace:
    command = argparse.ArgumentParser(description=__doc__)
    for folder in ("--raw_dir", "--out_dir"):
        command.add_argument(folder, required=True)
    command.add_argument("--representation", default=DEFAULT_REPRESENTATION, choices=REPRESENTATIONS)
    command.add_argument("--min_events_per_stay", default=DEFAULT_MIN_EVENTS, type=int)
    command.add_argument("--unordered", action="store_true", help="don't sort the artifacts by stay")
    command.add_argument("--multiline", action="store_true", help="quoted cells may hold line breaks; files can't be split then")
    command.add_argument("--id_type", default="auto", choices=("auto", "bigint", "string"))
    command.add_argument("--skip_row_checks", action="store_true", help="malformed rows fail the job when they are read")
    return command.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """Runs the job and prints its counts as a JSON line; 2 if the input can't be used."""
    given = arguments(argv)
    try:
        check_minimum(given.min_events_per_stay)
        spark = SparkSession.builder.appName("prepare-streams").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        kept, skipped = prepare_streams(
            spark,
            given.raw_dir,
            given.out_dir,
            given.representation,
            given.min_events_per_stay,
            ordered=not given.unordered,
            multiline=given.multiline,
            id_type=given.id_type,
            check_rows=not given.skip_row_checks,
        )
    except (OSError, ValueError) as problem:
        print(f"prepare_streams: {problem}", file=sys.stderr)
        return 2
    print(json.dumps({"streams": kept, "skipped_stays": skipped}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
