"""Registered queries against their SQL twins, on the smallest data."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks import queries as registered
from checks.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


# Queries of the training-data subpackage have their own tests beside it.
OWN = list(registered.queries())


def test_every_query_has_a_twin():
    assert set(OWN) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, connection, name):
    problem = compare(
        spark, connection, name, contract.queries()[name], contract.oracle_sql()[name], SF_DIR
    )
    assert not problem, problem


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0
    assert frame.columns == [
        "patientunitstayid",
        "representation",
        "events_text",
        "times_text",
        "n_events",
    ]
