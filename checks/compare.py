"""Run registered queries beside their SQL twins and compare whole results.

python -m checks.compare [scale-folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns sorted by name, sorted; numbers must agree to the last digit."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value: object) -> object:
        if isinstance(value, bool) or value is None:
            return str(value)
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value)
        return str(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, connection, name: str, query, sql: str | None, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    frame = query(spark, sf_dir)
    got = canonical(frame.columns, [tuple(row) for row in frame.collect()])
    if sql is None:
        return "" if got else "no rows"
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    want = canonical(columns, result.fetchall())
    if not want:
        return "the twin has no rows"
    if got == want:
        return ""
    extra = [row for row in got if row not in set(want)][:3]
    lost = [row for row in want if row not in set(got)][:3]
    return f"{len(got)} rows != {len(want)}; only Spark {extra}; only SQL {lost}"[:3000]


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("checks")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(arguments: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from checks import oracle, queries

    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    twins = oracle.oracle_sql()
    registered = queries.queries()
    names = arguments[1:] or list(registered)
    spark, connection = session(), duck(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, connection, name, registered[name], twins.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.2f}s {problem}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
