"""Rows of a query against rows of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "__float__"):
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    key = lambda r: [(x is None, str(type(x)), x) for x in r]
    return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=key)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(db, sql):
    found = db.sql(sql)
    return rows_of(found.columns, found.fetchall())


def differences(a, b):
    """What is wrong, or an empty list; rounded numbers may differ by one unit of the last digit."""
    if a[0] != b[0]:
        return [f"columns {a[0]} and {b[0]}"]
    if len(a[1]) != len(b[1]):
        return [f"{len(a[1])} and {len(b[1])} rows"]
    close = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.1e-5))
    return [f"{x} and {y}" for x, y in zip(a[1], b[1], strict=True) if not all(map(close, x, y))][:3]
