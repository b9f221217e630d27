"""Compare a registered query with its SQL check in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, repr(round(v, 6)))
    # Whole numbers, booleans, dates and text differ by type as well.
    return (2, f"{type(v).__name__} {v}")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in rows])


def difference(df, con, sql) -> str | None:
    """None if both results hold the same rows under the same names."""
    res = con.sql(sql)
    theirs_cols, theirs = res.columns, res.fetchall()
    ours_cols, ours = df.columns, [tuple(r) for r in df.collect()]
    if sorted(ours_cols) != sorted(theirs_cols):
        return f"columns {sorted(ours_cols)} / {sorted(theirs_cols)}"
    a, b = rows_of(ours_cols, ours), rows_of(theirs_cols, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(ours_cols)}: {x} / {y}"
    return None if a else "both empty"
