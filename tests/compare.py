"""Results of a query and of its SQL twin, side by side."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(v)
    return v


def rows(df):
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def same(found, told):
    assert sorted(found.columns) == sorted(told.columns)
    a, b = rows(found), rows(told)
    assert a == b, (len(a), len(b), [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2])
