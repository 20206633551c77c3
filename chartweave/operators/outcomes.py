"""Binary outcomes from several label fields with precedence and conflicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.contract import NEGATIVE_LABELS, OUTCOME_FIELDS, POSITIVE_LABELS, STAY_ID
from chartweave.functions.labels import (
    decided_label,
    deciding_state,
    label_mask,
    outcome_label,
)
from chartweave.operators.tables import (
    Tables,
    check_tables,
    column_type,
    require_columns,
    stay_key,
    union_all,
)


@dataclass(frozen=True)
class LabelRules:
    """Which fields hold labels, in order of precedence, and which words count."""

    fields: Sequence[tuple[str, str]] = OUTCOME_FIELDS
    negative: Sequence[str] = NEGATIVE_LABELS
    positive: Sequence[str] = POSITIVE_LABELS


DEFAULT_RULES = LabelRules()


def label_masks(tables: Tables, rules: LabelRules = DEFAULT_RULES) -> dict[str, Column]:
    """Label mask of a row, for every table that supplies at least one field."""
    available = [
        (rank, table, field)
        for rank, (table, field) in enumerate(rules.fields)
        if table in tables and field in tables[table].columns
    ]
    if not available:
        raise ValueError("no table supplies a mortality or discharge-status label field")
    masks: dict[str, list[tuple[int, Column]]] = {}
    for rank, table, field in available:
        frame = tables[table]
        require_columns(frame, table)
        label = outcome_label(
            F.col(field), column_type(frame, field), rules.negative, rules.positive
        )
        masks.setdefault(table, []).append((rank, label))
    return {table: label_mask(labels) for table, labels in masks.items()}


def mask_rows(tables: Tables, rules: LabelRules = DEFAULT_RULES) -> DataFrame:
    """``(stay, mask)``, one row per row of the tables that supply labels."""
    return union_all(
        [
            tables[table].where(stay_key().isNotNull()).select(STAY_ID, mask.alias("mask"))
            for table, mask in label_masks(tables, rules).items()
        ]
    )


def outcome_states(tables: Tables, rules: LabelRules = DEFAULT_RULES) -> DataFrame:
    """``(stay, state)`` for every candidate stay; see ``deciding_state``.

    All fields of all tables meet in a single ``bit_or``: one exchange, merged
    map-side to one integer per stay and task, and no join between the fields.
    """
    check_tables(tables)
    merged = mask_rows(tables, rules).groupBy(STAY_ID).agg(F.bit_or("mask").alias("mask"))
    return merged.select(
        STAY_ID, deciding_state(F.col("mask"), len(rules.fields)).alias("state")
    )


def outcomes_from_states(states: DataFrame) -> DataFrame:
    return states.select(
        STAY_ID, decided_label(F.col("state")).cast("int").alias("mortality")
    ).where(F.col("mortality").isNotNull())


def outcome_counters(states: DataFrame) -> DataFrame:
    """One row: candidate, labelled, unavailable and conflicting stays."""
    state = F.col("state")
    return states.agg(
        F.count("*").alias("candidate_stays"),
        F.count_if(state.isin(1, 2)).alias("labelled_stays"),
        F.count_if(state.isNull()).alias("unavailable_labels"),
        F.count_if(state == 3).alias("conflicting_labels"),
    )


def extract_outcomes(
    tables: Tables, rules: LabelRules = DEFAULT_RULES
) -> tuple[DataFrame, DataFrame]:
    """Outcomes ``(stay, mortality)`` and the one-row exclusion counters.

    A stay without a usable label, or with a conflict in the first field that
    has one, is left out. Rows carry no order; sort by the stay id at a sink.
    """
    states = outcome_states(tables, rules)
    return outcomes_from_states(states), outcome_counters(states)


def excluded_stays(tables: Tables, rules: LabelRules = DEFAULT_RULES) -> DataFrame:
    """``(stay, reason)`` of the candidates without an outcome."""
    state = F.col("state")
    return (
        outcome_states(tables, rules)
        .where(state.isNull() | (state == 3))
        .select(
            STAY_ID,
            F.when(state == 3, F.lit("conflicting_labels"))
            .otherwise(F.lit("unavailable_labels"))
            .alias("reason"),
        )
    )
