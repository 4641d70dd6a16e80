"""Holds a query's rows against its SQL in DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, bool) or not hasattr(x, "item"):
        return x
    return x.item()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(cell(r[i])) for i in order) for r in rows)


def compare(spark, query, sql, sf_dir):
    """Differences as text; empty if rows and columns agree."""
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    want = rows_of(names, want.fetchall())
    df = query(spark, str(sf_dir))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    a, b = set(got[1]), set(want[1])
    return f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
