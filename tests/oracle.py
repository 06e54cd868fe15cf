"""Runs a registered query and its DuckDB SQL over one folder of tables and compares the rows."""

import datetime
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9) if math.isfinite(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def expected(sql, sf_dir):
    with duckdb.connect() as con:
        con.execute("SET TimeZone='UTC'")
        for name in TABLES:
            path = f"{sf_dir}/{name}.parquet"
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            if glob.glob(files):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
        got = con.execute(sql)
        columns = [x[0] for x in got.description]
        return sorted(columns), rows_of(columns, got.fetchall())


def actual(spark, query, sf_dir):
    df = query(spark, sf_dir)
    return sorted(df.columns), rows_of(df.columns, df.collect())


def check(spark, query, sql, sf_dir):
    columns, rows = actual(spark, query, sf_dir)
    want_columns, want_rows = expected(sql, sf_dir)
    assert columns == want_columns
    assert len(rows) == len(want_rows), (len(rows), len(want_rows))
    different = [(a, b) for a, b in zip(rows, want_rows) if a != b]
    assert not different, different[:3]
