"""Event sequences per ICU stay, built on Spark DataFrames."""

from chartweave.contract import EVENT_FAMILIES, REPRESENTATIONS, SOURCE_TABLES, STAY_ID
from chartweave.functions.labels import outcome_label
from chartweave.functions.numbers import event_time, finite_number, gap_token, quartile_bin
from chartweave.functions.text import age_bin, gender_part, normalize_text, token_family
from chartweave.operators.categorical import extract_categorical_events
from chartweave.operators.numeric import extract_numeric_events, fit_numeric_bins
from chartweave.operators.outcomes import LabelRules, extract_outcomes
from chartweave.operators.quality import (
    outcome_violations,
    require_safe_features,
    require_valid,
    statistics_violations,
    stream_violations,
    token_violations,
)
from chartweave.operators.tables import stay_universe
from chartweave.plans.build import build_event_streams, plan_event_streams
from chartweave.plans.prepare import prepare_streams
from chartweave.sources.csv_tables import load_tables, table_path
from chartweave.sources.stream_files import (
    read_event_streams_jsonl,
    streams_from_records,
    write_event_streams_jsonl,
    write_outcomes_csv,
    write_statistics_json,
)

__all__ = [
    "EVENT_FAMILIES",
    "LabelRules",
    "REPRESENTATIONS",
    "SOURCE_TABLES",
    "STAY_ID",
    "age_bin",
    "build_event_streams",
    "event_time",
    "extract_categorical_events",
    "extract_numeric_events",
    "extract_outcomes",
    "finite_number",
    "fit_numeric_bins",
    "gap_token",
    "gender_part",
    "load_tables",
    "normalize_text",
    "outcome_label",
    "outcome_violations",
    "plan_event_streams",
    "prepare_streams",
    "quartile_bin",
    "read_event_streams_jsonl",
    "require_safe_features",
    "require_valid",
    "statistics_violations",
    "stay_universe",
    "stream_violations",
    "streams_from_records",
    "table_path",
    "token_family",
    "token_violations",
    "write_event_streams_jsonl",
    "write_outcomes_csv",
    "write_statistics_json",
]
