"""Registry of queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL if there is one."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def nudge(digits: int) -> float:
    """Small shift before rounding: a mean of cents may lie exactly between two rounded
    values, where the order of summation would decide the result."""
    return float(f"1.7e-{digits + 3}")


def r(col: Column | str, name: str, digits: int = 4) -> Column:
    """Rounded double under a name, without a negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(name)


def day(col: Column | str, name: str = "ts") -> Column:
    return F.date_format(col, "yyyy-MM-dd").alias(name)


def big(col: Column | str, name: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("long").alias(name)


def rs(expr: str, name: str, digits: int = 4) -> str:
    """SQL text of :func:`r`."""
    return f"round(CAST({expr} AS DOUBLE) + {nudge(digits)}, {digits}) + 0.0 AS {name}"


def days(expr: str, name: str = "ts") -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"


def bigs(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def least_squares(name: str, rows: str, width: int) -> str:
    """SQL of ``name(k, beta)``: least squares per ``k`` over ``rows(k, x, y)``, x a list of ``width`` numbers.

    The normal equations are solved by Gauss-Jordan steps in a recursive query; a list of CTEs for WITH RECURSIVE.
    """
    return f"""{name}_g AS (SELECT k, i, j, sum(z[i] * z[j]) AS g FROM (SELECT k, list_append(x, y) AS z FROM {rows}),
    range(1, {width + 1}) a(i), range(1, {width + 2}) b(j) GROUP BY ALL),
    {name}_r AS (SELECT k, i, list(g ORDER BY j) AS r FROM {name}_g GROUP BY ALL),
    {name}_s AS (SELECT k, 0 AS step, list(r ORDER BY i) AS m FROM {name}_r GROUP BY k),
    {name}_j AS (SELECT * FROM {name}_s UNION ALL SELECT k, step + 1, list_transform(m, lambda row, i: CASE WHEN i = step + 1
    THEN list_transform(row, lambda x: x / row[step + 1]) ELSE list_transform(row, lambda x, j: x - row[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END)
    FROM {name}_j WHERE step < len(m)),
    {name} AS (SELECT k, list_transform(m, lambda row: row[-1]) AS beta FROM {name}_j WHERE step = len(m))"""
