"""Compare a registered query with its SQL."""

import os

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(value):
    if value is None or value != value:
        return None
    return round(value, 9) if isinstance(value, float) else bytes(value) if isinstance(value, bytearray) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(_cell(r[k]) for k in order)) for r in rows)


def assert_same(spark, query, sql: str, folder: str) -> int:
    frame, answer = query(spark, folder), connection(folder).sql(sql)
    assert sorted(frame.columns) == sorted(answer.columns)
    got, want = rows_of(frame.columns, frame.collect()), rows_of(answer.columns, answer.fetchall())
    assert got == want
    return len(got)
