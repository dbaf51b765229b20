"""Filters and guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import Series, attach


def filter_equals(df: DataFrame, col: str, value: object, required: bool = False) -> DataFrame:
    """Rows with ``col == value``; when ``required``, an empty result raises (one short job)."""
    kept = df.filter(F.col(col) == F.lit(value))
    if required and kept.isEmpty():
        raise ValueError(f"no rows with {col} = {value!r}")
    return kept


def keep_keys(df: DataFrame, keys: DataFrame, key: str | Sequence[str], bounded: bool = False,
              spread: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is in ``keys``.

    ``bounded`` says that ``keys`` was cut by a limit, and so may be broadcast. For
    other key sets, ``spread`` columns split the rows of a hot key.
    """
    on = [key] if isinstance(key, str) else list(key)
    members = keys.select(*on)
    if bounded:
        return df.join(F.broadcast(members), on, "left_semi")
    return attach(df, members, on, spread, how="left_semi") if spread else df.join(members, on, "left_semi")


def top_ranked(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of a total order, with their ``rank``."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(*order)))


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in ``cols`` (default all)."""
    return df.na.drop(subset=list(cols) if cols else None)


def drop_gap_sequences(seq: DataFrame, features: Sequence[str], steps: str = "steps",
                       label: str = "label") -> DataFrame:
    """Sequences without a missing value in any step or in the label."""
    gap = F.exists(steps, lambda x: reduce(or_, [x[c].isNull() for c in features]))
    return seq.filter(~gap & F.col(label).isNotNull())


def series_status(df: DataFrame, s: Series, n: int) -> DataFrame:
    """One row per series: its length, and whether it has more than ``n`` rows."""
    return df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "status", F.when(F.col("n") > n, "ok").otherwise("too_short"))


def min_length(df: DataFrame, s: Series, n: int) -> DataFrame:
    """Rows of series longer than ``n`` rows."""
    ok = series_status(df, s, n).filter("status = 'ok'")
    return keep_keys(df, ok, s.keys, spread=s.order)


def head_rows(df: DataFrame, s: Series, n: int) -> DataFrame:
    """First ``n`` rows of each series; Spark cuts each key to ``n`` before the shuffle."""
    return df.withColumn("_r", F.row_number().over(s.window())).filter(F.col("_r") <= n).drop("_r")
