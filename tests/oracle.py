"""Runs a query in Spark and its statement in DuckDB and compares the rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def compare(df, con, sql):
    """None if equal, else what differs."""
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; {got[:2]} {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, {bad[0]}" if bad else None
