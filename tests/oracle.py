"""Compare a named query with its SQL in DuckDB: columns, row count, values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(_norm, v))
    return v


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    if got == want:
        return None
    return (f"rows {sum(got.values())} vs {sum(want.values())}; "
            f"only spark {list((got - want).items())[:2]}; only sql {list((want - got).items())[:2]}")
