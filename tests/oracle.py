"""Run a query and its SQL, and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    key = lambda r: tuple((x is None, str(type(x)) if x is None else "", str(x)) for x in r)
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


def same(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differs(df, con, sql: str) -> str:
    """'' if both have the same rows."""
    got = df.collect()
    columns, mine = rows_of(df.columns, got)
    res = con.execute(sql)
    theirs_columns, theirs = rows_of([c[0] for c in res.description], res.fetchall())
    if columns != theirs_columns:
        return f"columns {columns} and {theirs_columns}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    for a, b in zip(mine, theirs):
        if not all(same(x, y) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return ""
