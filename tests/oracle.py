"""Compare a query with its SQL twin."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None or isinstance(v, bool):
        return str(v)
    try:
        f = float(v)
        return "None" if math.isnan(f) else f"{f + 0.0:.6g}" if abs(f) > 1e-9 else "0"
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)
