"""Outcome precedence, conflicts and counters."""

from __future__ import annotations

import random

import pytest

from chartweave import LabelRules, extract_outcomes
from chartweave.contract import OUTCOME_FIELDS

PATIENT = "patientunitstayid long, hospitaldischargestatus string, unitdischargestatus string"
APACHE = "patientunitstayid long, actualhospitalmortality string, actualicumortality string"


def run(spark, patient=None, apache=None):
    tables = {}
    if patient is not None:
        tables["patient"] = spark.createDataFrame(patient, PATIENT)
    if apache is not None:
        tables["apachePatientResult"] = spark.createDataFrame(apache, APACHE)
    outcomes, counters = extract_outcomes(tables)
    return dict(map(tuple, outcomes.collect())), tuple(counters.first())


def test_primary_field_and_types(spark):
    labels, _ = run(spark, [(101, "Alive", None), (102, "EXPIRED", None)])
    assert labels == {101: 0, 102: 1}
    tables = {
        "patient": spark.createDataFrame([(101,), (102,)], "patientunitstayid long"),
        "apachePatientResult": spark.createDataFrame(
            [(101, 0), (102, 1)], "patientunitstayid long, actualhospitalmortality long"
        ),
    }
    outcomes, _ = extract_outcomes(tables)
    assert outcomes.schema["mortality"].dataType.simpleString() == "int"
    assert dict(map(tuple, outcomes.collect())) == {101: 0, 102: 1}


def test_precedence_and_fallbacks(spark):
    assert run(spark, [(101, "Alive", "Expired")])[0] == {101: 0}
    assert run(spark, [(101, None, "alive"), (102, None, "dead")])[0] == {101: 0, 102: 1}
    assert run(spark, [(101, None, None)], [(101, "expired", None)])[0] == {101: 1}


def test_unusable_labels(spark):
    labels, counters = run(spark, [(101, None, None), (102, "Unknown", None), (103, "2", None)])
    assert labels == {} and counters == (3, 0, 3, 0)


def test_conflicts(spark):
    rows = [(101, "Alive", None), (101, "Expired", None), (102, "Alive", None), (102, "alive", None)]
    labels, counters = run(spark, rows)
    assert labels == {102: 0} and counters == (2, 1, 0, 1)
    # A conflict hides the later fields; one after the decision does not matter.
    labels, _ = run(
        spark,
        [(1, "Alive", None), (1, "Expired", None), (2, "Alive", None)],
        [(1, "1", None), (2, "1", None), (2, "0", None)],
    )
    assert labels == {2: 0}


def test_candidates_come_from_label_tables_only(spark):
    tables = {
        "patient": spark.createDataFrame([(1,), (2,)], "patientunitstayid long"),
        "apachePatientResult": spark.createDataFrame([(1, "0", None), (None, "1", None)], APACHE),
    }
    _, counters = extract_outcomes(tables)
    assert tuple(counters.first()) == (1, 1, 0, 0)


def test_errors(spark):
    with pytest.raises(ValueError, match="label field"):
        extract_outcomes({"patient": spark.createDataFrame([(1,)], "patientunitstayid long")})
    with pytest.raises(ValueError, match="patient.*patientunitstayid"):
        extract_outcomes({"patient": spark.createDataFrame([("x",)], "hospitaldischargestatus string")})
    with pytest.raises(ValueError, match="tables"):
        extract_outcomes(None)


def test_other_fields_and_words(spark):
    rules = LabelRules(fields=(("orders", "status"),), negative=("o",), positive=("f",))
    orders = spark.createDataFrame([(1, "F"), (2, "O"), (3, "P")], "patientunitstayid long, status string")
    outcomes, _ = extract_outcomes({"orders": orders}, rules)
    assert dict(map(tuple, outcomes.collect())) == {1: 1, 2: 0}


def test_brute_force(spark):
    rng = random.Random(3)
    words = ["Alive", "Expired", "1", "0", None, "Unknown", None]
    data = {
        name: [(rng.randrange(40), rng.choice(words), rng.choice(words)) for _ in range(120)]
        for name in ("patient", "apachePatientResult")
    }
    columns = {"patient": PATIENT, "apachePatientResult": APACHE}
    names = {t: [c.split()[0] for c in columns[t].split(", ")] for t in columns}
    value = {"Alive": 0, "0": 0, "Expired": 1, "1": 1}
    stays = {row[0] for rows in data.values() for row in rows}
    want, conflicts = {}, set()
    for stay in stays:
        for table, field in OUTCOME_FIELDS:
            index = names[table].index(field)
            found = {value[r[index]] for r in data[table] if r[0] == stay and r[index] in value}
            if len(found) == 2:
                conflicts.add(stay)
            if found:
                break
        if len(found) == 1:
            want[stay] = found.pop()
    got, counters = run(spark, data["patient"], data["apachePatientResult"])
    assert got == want
    assert counters == (len(stays), len(want), len(stays - set(want) - conflicts), len(conflicts))
