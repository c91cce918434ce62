"""Spark results against DuckDB's, as sets of rows."""

import math
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return float(f"{float(x):.9g}") + 0.0
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(cell(r[i]) for i in order) for r in rows]


def differences(df, con, sql):
    """Rows that only one side has, after pairing floats that agree to 6 digits."""
    ours = rows_of(df.columns, df.collect())
    theirs = con.execute(sql).df()
    names = list(theirs.columns)
    assert sorted(names) == sorted(df.columns)
    other = rows_of(names, theirs.astype(object).values.tolist())
    a, z = Counter(ours), Counter(other)
    left, right = list((a - z).elements()), list((z - a).elements())
    key = lambda r: tuple((x is None, str(x)) if not isinstance(x, float) else (False, f"{x:.4g}") for x in r)
    left, right = sorted(left, key=key), sorted(right, key=key)
    if len(left) != len(right):
        return left[:3], right[:3]
    close = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)))
    return [(p, q) for p, q in zip(left, right, strict=True) if not all(map(close, p, q))][:3]
