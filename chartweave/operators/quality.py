"""Whole-table constraint checks.

Every check returns the rows that break a rule as ``(stay, rule, detail)``;
``require_valid`` turns them into an error. All are narrow: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.contract import (
    EVENT_FAMILIES,
    PROHIBITED_FEATURE_FRAGMENTS,
    REPRESENTATIONS,
    STAY_ID,
)
from chartweave.functions.text import strip_text
from chartweave.operators.tables import check_minimum, column_type


def valid_stay_id(stay: Column, data_type: T.DataType) -> Column:
    """A positive whole number or a text that is not blank."""
    if isinstance(data_type, T.IntegralType):
        valid = stay > 0
    elif isinstance(data_type, T.StringType):
        valid = strip_text(stay) != ""
    else:
        valid = F.lit(False)
    return F.coalesce(valid, F.lit(False))


def valid_token(token: Column) -> Column:
    """``FAMILY::VALUE`` with a known family and a value that is not empty."""
    families = "|".join(EVENT_FAMILIES)
    return F.coalesce(token.rlike(rf"\A(?:{families})::(?s:.)+\z"), F.lit(False))


def broken_rules(rules: Iterable[tuple[str, Column, Column]]) -> Column:
    """Array of ``(rule, detail)`` for the rules whose condition is not true."""
    entries = [
        F.when(
            ~F.coalesce(holds, F.lit(False)),
            F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")),
        )
        for rule, holds, detail in rules
    ]
    return F.filter(F.array(*entries), lambda entry: entry.isNotNull())


def stream_rules(
    streams: DataFrame, min_events_per_stay: int = 1
) -> list[tuple[str, Column, Column]]:
    """The rules of a stream: name, condition that must hold, detail."""
    check_minimum(min_events_per_stay)
    stay, events, times = F.col(STAY_ID), F.col("events"), F.col("event_times")
    size = F.coalesce(F.size(events), F.lit(0))
    known = F.filter(times, lambda time: time.isNotNull())
    same_length = times.isNull() | (F.size(times) == F.size(events))
    ordered = times.isNull() | (F.sort_array(known) == known)
    return [
        ("stay_id", valid_stay_id(stay, column_type(streams, STAY_ID)), stay),
        ("min_events", size >= min_events_per_stay, size),
        (
            "token",
            events.isNull() | F.forall(events, valid_token),
            F.array_join(
                F.filter(events, lambda token: ~valid_token(token)), ", ", "null"
            ),
        ),
        (
            "representation",
            F.col("representation").isin(*REPRESENTATIONS),
            F.col("representation"),
        ),
        ("event_times_length", same_length, F.size(times)),
        ("event_times_order", ordered, F.size(known)),
    ]


def stream_violations(streams: DataFrame, min_events_per_stay: int = 1) -> DataFrame:
    """Broken stream rules, one row each."""
    broken = broken_rules(stream_rules(streams, min_events_per_stay))
    return streams.select(STAY_ID, F.inline(broken))


def token_violations(tokens: DataFrame) -> DataFrame:
    """Rows of a ``(stay, token)`` table whose token is malformed."""
    rules = [("token", valid_token(F.col("token")), F.col("token"))]
    return tokens.select(STAY_ID, F.inline(broken_rules(rules)))


def outcome_violations(outcomes: DataFrame) -> DataFrame:
    """Rows of a ``(stay, mortality)`` table with a bad id or label."""
    stay, label = F.col(STAY_ID), F.col("mortality")
    binary = (
        label.isin(0, 1)
        if isinstance(column_type(outcomes, "mortality"), T.NumericType)
        else F.lit(False)
    )
    rules = [
        ("stay_id", valid_stay_id(stay, column_type(outcomes, STAY_ID)), stay),
        ("mortality", binary, label),
    ]
    return outcomes.select(STAY_ID, F.inline(broken_rules(rules)))


def statistics_violations(statistics: DataFrame) -> DataFrame:
    """Broken rules ``(rule, detail)`` of a statistics table."""
    column = F.col
    counts = (
        "total_stays",
        "kept_stays",
        "skipped_stays",
        "min_sequence_length",
        "max_sequence_length",
    )
    rules = [(name, column(name) >= 0, column(name)) for name in counts]
    families = column("token_family_counts")
    expected = F.sort_array(F.array(*[F.lit(family) for family in EVENT_FAMILIES]))
    rules += [
        (
            "stays_add_up",
            column("total_stays") == column("kept_stays") + column("skipped_stays"),
            column("total_stays"),
        ),
        (
            "lengths_in_order",
            column("min_sequence_length") <= column("max_sequence_length"),
            column("min_sequence_length"),
        ),
        (
            "median_sequence_length",
            (column("median_sequence_length") >= 0) & ~F.isnan("median_sequence_length"),
            column("median_sequence_length"),
        ),
        (
            "families",
            F.sort_array(F.map_keys(families)) == expected,
            F.array_join(F.map_keys(families), ", "),
        ),
        (
            "family_counts",
            F.forall(F.map_values(families), lambda n: F.coalesce(n >= 0, F.lit(False))),
            F.array_join(F.map_values(families).cast("array<string>"), ", ", "null"),
        ),
    ]
    return statistics.select(F.inline(broken_rules(rules)))


def require_valid(violations: DataFrame, what: str) -> None:
    """Raise with the number of violations per rule; names no stay."""
    counts = violations.groupBy("rule").count().orderBy("rule").collect()
    if counts:
        summary = ", ".join(f"{row['rule']} ({row['count']})" for row in counts)
        raise ValueError(f"invalid {what}: {summary}")


def is_prohibited_feature(name: Column, exact: bool = False) -> Column:
    """Whether a feature name gives the outcome away.

    A name is compared in lower case without ``_`` and ``-``. By default any
    prohibited fragment inside it counts, which also hits innocent names such
    as ``closed_flag``; ``exact`` asks for the whole name.
    """
    plain = F.lower(F.translate(name, "_-", ""))
    fragments = [fragment.replace("_", "") for fragment in PROHIBITED_FEATURE_FRAGMENTS]
    if exact:
        return plain.isin(*fragments)
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | plain.contains(fragment)
    return hit


def prohibited_features(columns: Iterable[str], exact: bool = False) -> list[str]:
    """The same rule for column names, before a plan is built."""
    fragments = [fragment.replace("_", "") for fragment in PROHIBITED_FEATURE_FRAGMENTS]

    def hit(name: str) -> bool:
        plain = name.replace("_", "").replace("-", "").lower()
        return plain in fragments if exact else any(part in plain for part in fragments)

    return [name for name in columns if hit(name)]


def require_safe_features(columns: Iterable[str], exact: bool = False) -> None:
    found = prohibited_features(columns, exact)
    if found:
        raise ValueError(f"prohibited feature columns: {', '.join(found)}")
