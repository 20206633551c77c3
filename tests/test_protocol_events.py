"""Tokens of the protocol against brute force: text rules, reasons, support, order and gaps, strata."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chartweave.contract import FAMILY_ORDER, STAY_ID
from chartweave.functions.text import age_group, spaced_text
from chartweave.operators import metrics, protocol_events


def test_text_and_age(spark):
    texts = [("  a \t\n b/c\u00a0d ", "A_B/C_D"), ("N/A", None), (" \u2003 ", None), (None, None), ("Other", None), ("x::y", "X::Y")]
    ages = [("17", "0_17"), ("18", "18_39"), ("39.5", "18_39"), (" > 89", "80_PLUS"), ("80", "80_PLUS"), ("79", "60_79"), ("-1", None), ("?", None), (None, None)]
    for rows, use in ((texts, spaced_text), (ages, age_group)):
        found = spark.createDataFrame(rows, "x string, want string").select(use(F.col("x")).alias("got"), "want").collect()
        assert all(r.got == r.want for r in found), found


def test_static_tokens(spark):
    rows = [(1, "> 89", None, "x"), (1, "85", "F", "y"), (None, "30", "M", "z"), (2, None, "other", "A  b")]
    found = protocol_events.static_tokens(spark.createDataFrame(rows, f"{STAY_ID} long, age string, gender string, unittype string"))
    tokens = [(r[STAY_ID], r.field, r.token.removeprefix("STATIC::")) for r in found.collect()]
    assert sorted(tokens) == [
        (1, 0, "AGE_BIN::80_PLUS"), (1, 1, "GENDER::F"), (1, 2, "UNIT_ADMIT_SOURCE::UNKNOWN"), (1, 3, "UNIT_TYPE::X"),
        (2, 0, "AGE_BIN::UNKNOWN"), (2, 1, "GENDER::UNKNOWN"), (2, 2, "UNIT_ADMIT_SOURCE::UNKNOWN"), (2, 3, "UNIT_TYPE::A_B"),
    ]


def test_reasons_and_medication_ids(spark):
    rows = [
        (1, " heparin  flush", 7, "10.9"), (1, None, 12, "1440"), (1, "none", None, "5"), (1, "x", 1, "?"),
        (1, "x", 1, "1440.5"), (1, "x", 1, "-1"), (None, None, None, None),
    ]
    drugs = spark.createDataFrame(rows, f"{STAY_ID} long, drugname string, drughiclseqno int, drugstartoffset string")
    labs = spark.createDataFrame([(1, "k", "1e999", "3"), (1, " ", "4", "3"), (1, "k", "4", "3")], f"{STAY_ID} long, labname string, labresult string, labresultoffset string")
    judged = protocol_events.categorical_rows({"medication": drugs})
    found = Counter((r.token, r.event_time, r.reason) for r in judged.collect())
    assert found == Counter([
        ("MED::HEPARIN_FLUSH", 10, None), ("MED::HICL::12", 1440, None), (None, 5, "unusable_text"), ("MED::X", None, "no_time"),
        ("MED::X", 1440, "outside_window"), ("MED::X", -1, "outside_window"), (None, None, "missing_stay"),
    ])
    report = protocol_events.coverage_report(judged, protocol_events.lab_values(labs))
    assert {(r.source, r.reason): r.rows for r in report.collect()} == {
        ("medication", "kept"): 2, ("medication", "unusable_text"): 1, ("medication", "no_time"): 1, ("medication", "outside_window"): 2,
        ("medication", "missing_stay"): 1, ("lab", "nonnumeric_value"): 1, ("lab", "unusable_name"): 1, ("lab", "kept"): 1,
    }
    assert protocol_events.categorical_rows({}) is None


@pytest.mark.parametrize("few", [100_000, 0])
def test_support_is_counted_on_training_stays(spark, monkeypatch, few):
    monkeypatch.setattr(protocol_events, "MAX_BROADCAST_NAMES", few)
    rows = [(s, "LAB::A", float(s), 0.0) for s in range(20)] + [(s, "LAB::B", 1.0, 0.0) for s in range(10, 20)] + [(1, None, 1.0, 0.0), (1, "LAB::A", None, 0.0)]
    values = spark.createDataFrame(rows, f"{STAY_ID} long, measurement string, value double, event_time double")
    training = spark.createDataFrame([(s,) for s in (*range(11), 3)], f"{STAY_ID} long")
    bins = protocol_events.supported_bins(values, training, minimum=11)
    assert [tuple(r) for r in bins.collect()] == [("LAB::A", 2.5, 5.0, 7.5, 11)]
    found = Counter((r.token, r.reason) for r in protocol_events.binned(values.where("value IS NOT NULL AND measurement IS NOT NULL"), bins).collect())
    assert found == Counter({("LAB::A::Q1", None): 3, ("LAB::A::Q2", None): 3, ("LAB::A::Q3", None): 2, ("LAB::A::Q4", None): 12, (None, "low_support"): 10})


def brute_order(rows):
    """Positions of one stay's distinct (token, minute) pairs, gap tokens included."""
    def rank(token):
        family = token.split("::")[0]
        return FAMILY_ORDER.index(family) if family in FAMILY_ORDER else len(FAMILY_ORDER)

    out, before = [], None
    for minute, _, token in sorted({(m, rank(t), t) for t, m in rows}):
        if before is not None and minute > before:
            gap = minute - before
            names = [n for top, n in ((15, "0_15M"), (60, "16_60M"), (180, "61_180M"), (360, "181_360M")) if gap <= top]
            out.append((f"TIME_GAP::{(names or ['GT_360M'])[0]}", minute))
        out.append((token, minute))
        before = minute
    return [(i, *x) for i, x in enumerate(out)]


def test_order_and_gaps(spark):
    """One stay has a third of all rows; copies, ties in a minute, nulls, and a family of its own."""
    dice = random.Random(5)
    rows = []
    for _ in range(900):
        token = f"{dice.choice([*FAMILY_ORDER, 'NOTE'])}::T{dice.randrange(4)}"
        rows.append((dice.choice([1, 1, 2, 3, 4, None]), dice.choice([token] * 9 + [None]), dice.choice([None, *range(0, 1441, 97), 3.5, 3.9, 19, 64])))
    frame = spark.createDataFrame([(a, b, None if c is None else float(c)) for a, b, c in rows], f"{STAY_ID} long, token string, event_time double")
    want = defaultdict(list)
    for a, b, c in rows:
        if None not in (a, b, c):
            want[a].append((b, int(c)))
    found = defaultdict(list)
    for r in protocol_events.ordered_events(frame.repartition(5)).collect():
        found[r[STAY_ID]].append((r.position, r.token, r.event_time))
    assert {k: sorted(v) for k, v in found.items()} == {k: brute_order(v) for k, v in want.items()}
    static = spark.createDataFrame([(2, f, f"STATIC::{f}") for f in range(4)], f"{STAY_ID} long, field int, token string")
    whole = sorted((r.position, r.token, r.event_time) for r in protocol_events.protocol_positions(static, frame).collect())
    assert whole == [(f, f"STATIC::{f}", 0.0) for f in range(4)] + [(p + 4, t, m) for p, t, m in brute_order(want[2])]
    assert protocol_events.ordered_events(frame.limit(0)).count() == 0


def test_density_and_summary(spark):
    stays = spark.createDataFrame([(s,) for s in (*range(9), 8, None)], f"{STAY_ID} long")
    events = spark.createDataFrame([(s,) for s in range(9) for _ in range(s)] + [(99,), (None,)], f"{STAY_ID} long")
    found = {r[STAY_ID]: (r.n_events, r.density) for r in protocol_events.density_cohorts(stays, events).collect()}
    assert found == {s: (s, "low" if s <= 8 / 3 else "medium" if s <= 16 / 3 else "high") for s in range(9)}
    assert protocol_events.density_cohorts(stays.limit(0), events).count() == 0
    rows = [("a", 1, 1, 0.9), ("a", 1, 0, 0.1), ("a", 2, None, 0.5), (None, None, 1, None)]
    summary = metrics.result_summary(spark.createDataFrame(rows, "fold string, patient long, label int, score double"), "patient", by=["fold"])
    kept = {r.fold: (r.patients, r.stays, r.positive_stays, r.negative_stays, r.auroc, r.note) for r in summary.collect()}
    assert kept == {"a": (2, 3, 1, 1, 1.0, None), None: (0, 1, 1, 0, None, "one class")}
