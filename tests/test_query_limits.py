"""Registered queries on own small tables, each beside its twin."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from checks import oracle, queries as registered
from checks.compare import canonical


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four users: about 130, 250 and 30 tokens, and one without a label."""
    path = str(tmp_path_factory.mktemp("own"))
    tables = {
        "customer": (
            [(i, 100.0 * i, i, "BUILDING") for i in range(4)],
            "c_custkey bigint, c_acctbal double, c_nationkey int, c_mktsegment string",
        ),
        "labels": ([(i, 1, 0) for i in range(3)], "doc_id bigint, quality int, toxic int"),
        "events": (
            [
                (
                    1000 * user + k,
                    dt.datetime(2024, 1, 15) + dt.timedelta(minutes=7 * k),
                    user,
                    ["error", "purchase", "signup", "view"][k % 4],
                    float(k + 1),
                    f'{{"k": {k}}}',
                )
                for user, size in ((0, 42), (1, 82), (2, 8), (3, 60))
                for k in range(size)
            ],
            "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def connection(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in ("customer", "labels", "events"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return connection


def both(spark, connection, folder, name):
    frame = registered.queries()[name](spark, folder)
    result = connection.execute(oracle.oracle_sql()[name])
    twin = canonical([c[0] for c in result.description], result.fetchall())
    assert canonical(frame.columns, [tuple(row) for row in frame.collect()]) == twin
    return frame


def test_minimum_length_keeps_every_stay_of_100_tokens(spark, connection, folder):
    found = both(spark, connection, folder, "min_length_filter")
    lengths = {row["patientunitstayid"]: row["n_events"] for row in found.collect()}
    assert set(lengths) == {1, 2}
    assert 100 <= lengths[1] < 190 <= lengths[2]
