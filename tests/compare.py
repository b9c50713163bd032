"""Run queries next to their SQL and compare all rows. ``python tests/compare.py DIR [NAME ...]`` prints a report."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from starcast.session import intermediates, local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sql_engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    engine = duckdb.connect()
    for table in TABLES:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return engine


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(float(value) + 0.0) if isinstance(value, (int, float)) else str(value)


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


# Spark type of each SQL type that the queries may return.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}


def difference(spark, engine, name: str, sf_dir: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    with intermediates(spark):
        df = entry.queries()[name](spark, sf_dir)
        rows = [tuple(row) for row in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    result = engine.execute(sql)
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    types = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in result.description}
    other = {c: (kind, types[c]) for c, kind in df.dtypes if kind != types[c]}
    if other:
        return f"types {other}"
    if len(rows) != len(expected):
        return f"{len(rows)} and {len(expected)} rows"
    ours, theirs = sorted_rows(df.columns, rows), sorted_rows(columns, expected)
    wrong = [pair for pair in zip(ours, theirs) if pair[0] != pair[1]]
    return f"{len(wrong)} of {len(rows)} rows, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    session = local_session(8)
    duck = sql_engine(sys.argv[1])
    names = sys.argv[2:] or list(entry.queries())
    failed = 0
    for query in names:
        start = time.time()
        try:
            found = difference(session, duck, query, sys.argv[1])
        except Exception as error:  # report and go on with the next query
            found = "".join(traceback.format_exception_only(error))[:600]
        failed += found is not None
        checked = "sql " if query in entry.oracle_sql() else "rows"
        print(f"{checked} {'ok  ' if found is None else 'FAIL'} {time.time() - start:6.1f}s {query} {found or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
