"""Runs DuckDB SQL over a folder of tables and compares the rows with a DataFrame's."""

import os
import tempfile

import duckdb


def views(folder):
    con = duckdb.connect()
    con.sql(f"SET temp_directory = '{tempfile.gettempdir()}/duckdb-{os.getpid()}'")
    for p in os.listdir(folder):
        path = f"{folder}/{p}"
        con.sql(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


def assert_same(df, sql, folder):
    rel = views(folder).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
