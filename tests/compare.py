"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, build, sql: str | None, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = build(spark, folder)
    names, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(rows)} rows, {took:.1f}s"
    result = connection.execute(sql)
    other_names, other_rows = rows_of([d[0] for d in result.description], result.fetchall())
    if names != other_names:
        return False, f"columns {names} / {other_names}"
    if rows != other_rows:
        pairs = [(a, b) for a, b in zip(rows, other_rows) if a != b][:2]
        return False, f"{len(rows)} / {len(other_rows)} rows, first differences {pairs}"
    return True, f"{len(rows)} rows, {took:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry_module

    from claimspark.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(folder), entry_module.oracle_sql()
    chosen = sys.argv[1:]
    bad = 0
    for name, build in entry_module.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        try:
            ok, message = compare(spark, connection, build, sql.get(name), folder)
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print("OK  " if ok else "FAIL", name, message, flush=True)
    print("failed:", bad)
