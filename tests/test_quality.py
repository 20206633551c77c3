"""Constraint checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chartweave import (
    EVENT_FAMILIES,
    outcome_violations,
    require_safe_features,
    require_valid,
    statistics_violations,
    stream_violations,
    token_violations,
)
from chartweave.operators.quality import is_prohibited_feature, prohibited_features

STREAM = (
    "patientunitstayid string, events array<string>, event_times array<double>, "
    "representation string, metadata map<string,string>"
)
GOOD = ("stay-1", ["STATIC::GENDER::F", "DX::SEPSIS", "LAB::CREATININE::Q2"], [None, 10.0, 10.0], "timegap_static", {"a": "b"})


def rules(spark, minimum=1, **changes):
    names = [part.split()[0] for part in STREAM.split(", ")]
    row = tuple(changes.get(n, v) for n, v in zip(names, GOOD))
    frame = spark.createDataFrame([row], STREAM)
    return [r["rule"] for r in stream_violations(frame, minimum).collect()]


def test_valid_stream(spark):
    assert rules(spark) == []
    assert rules(spark, event_times=None) == []


@pytest.mark.parametrize(
    "changes, minimum, rule",
    [
        ({"patientunitstayid": ""}, 1, "stay_id"),
        ({"patientunitstayid": " \t"}, 1, "stay_id"),
        ({"patientunitstayid": None}, 1, "stay_id"),
        ({"events": ["STATIC::GENDER::F"], "event_times": [None]}, 2, "min_events"),
        ({"events": None, "event_times": None}, 1, "min_events"),
        ({"events": ["UNKNOWN::VALUE"], "event_times": None}, 1, "token"),
        ({"events": ["DX::SEPSIS", None], "event_times": None}, 1, "token"),
        ({"events": ["DX::SEPSIS", "42"], "event_times": None}, 1, "token"),
        ({"events": ["DX::"], "event_times": None}, 1, "token"),
        ({"events": ["DX:SEPSIS"], "event_times": None}, 1, "token"),
        ({"event_times": [None, 20.0, 10.0]}, 1, "event_times_order"),
        ({"event_times": [1.0, 2.0]}, 1, "event_times_length"),
        ({"representation": "raw"}, 1, "representation"),
        ({"representation": None}, 1, "representation"),
    ],
)
def test_broken_streams(spark, changes, minimum, rule):
    assert rules(spark, minimum, **changes) == [rule]


def test_numeric_stay_ids(spark):
    schema = STREAM.replace("patientunitstayid string", "patientunitstayid bigint")
    rows = [(i, *GOOD[1:]) for i in (0, -1, 5)]
    bad = stream_violations(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["detail"] for r in bad) == ["-1", "0"]


def test_tokens_and_outcomes(spark):
    tokens = spark.createDataFrame(
        [(1, "DX::A\nB"), (1, "DX::"), (1, None), (1, "dx::A")], "patientunitstayid long, token string"
    )
    assert token_violations(tokens).count() == 3
    outcomes = spark.createDataFrame(
        [(1, 0), (2, 1), (3, None), (4, 2), (0, 1)], "patientunitstayid long, mortality int"
    )
    got = sorted((r["patientunitstayid"], r["rule"]) for r in outcome_violations(outcomes).collect())
    assert got == [(0, "stay_id"), (3, "mortality"), (4, "mortality")]
    booleans = spark.createDataFrame([(1, True)], "patientunitstayid long, mortality boolean")
    assert outcome_violations(booleans).count() == 1


def statistics(spark, **changes):
    row = {
        "total_stays": 3,
        "kept_stays": 2,
        "skipped_stays": 1,
        "min_sequence_length": 2,
        "max_sequence_length": 4,
        "median_sequence_length": 3.0,
        "token_family_counts": dict.fromkeys(EVENT_FAMILIES, 0),
    }
    row.update(changes)
    schema = (
        "total_stays long, kept_stays long, skipped_stays long, min_sequence_length long, "
        "max_sequence_length long, median_sequence_length double, token_family_counts map<string,long>"
    )
    frame = spark.createDataFrame([tuple(row.values())], schema)
    return [r["rule"] for r in statistics_violations(frame).collect()]


def test_statistics(spark):
    assert statistics(spark) == []
    assert statistics(spark, skipped_stays=0) == ["stays_add_up"]
    assert statistics(spark, skipped_stays=-1, total_stays=1) == ["skipped_stays"]
    assert statistics(spark, min_sequence_length=5) == ["lengths_in_order"]
    assert statistics(spark, median_sequence_length=-1.0) == ["median_sequence_length"]
    assert statistics(spark, token_family_counts={"DX": 1}) == ["families"]
    counts = dict.fromkeys(EVENT_FAMILIES, 0) | {"DX": -1}
    assert statistics(spark, token_family_counts=counts) == ["family_counts"]


def test_require_valid_names_rules_but_no_stay(spark):
    frame = spark.createDataFrame([("secret", "token", "x")] * 2, "patientunitstayid string, rule string, detail string")
    with pytest.raises(ValueError, match=r"token \(2\)") as error:
        require_valid(frame, "streams")
    assert "secret" not in str(error.value)
    require_valid(frame.limit(0), "streams")


def test_prohibited_features(spark):
    names = ["age", "apache_iv_score", "Unit-Discharge_Offset", "closed_flag", "length_of_stay", "heartrate"]
    assert prohibited_features(names) == names[1:5]
    assert prohibited_features(names, exact=True) == ["length_of_stay"]
    with pytest.raises(ValueError, match="closed_flag"):
        require_safe_features(names)
    require_safe_features(["age", "gender"])
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    for exact in (False, True):
        got = [r["n"] for r in frame.where(is_prohibited_feature(F.col("n"), exact)).collect()]
        assert got == prohibited_features(names, exact)
