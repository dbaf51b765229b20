"""Run a query and its SQL over the same files and compare all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows),
                  key=lambda t: tuple("" if v is None else v for v in t))


def differences(df, con, sql: str) -> str | None:
    """None when both sides agree, else the first differing rows."""
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    ours = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    want = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "INTEGER": "int",
            "BOOLEAN": "boolean"}
    bad = [(c, t, types[c]) for c, t in df.dtypes if want.get(types[c]) != t]
    if bad:
        return f"types {bad}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}; ours {ours[:2]} theirs {theirs[:2]}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[:3]}" if wrong else None
