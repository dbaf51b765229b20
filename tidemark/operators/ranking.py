"""Sorts, limits, best rows and random key samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_by_time(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Output order by key and time. Operators carry their own order and do not need it."""
    return df.orderBy(*keys, ts)


def top_k(df: DataFrame, score: Column | str, k: int, by: Sequence[str] = (),
          ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest score, per group if ``by`` is given."""
    value = F.col(score) if isinstance(score, str) else score
    order = [value.desc(), *[F.col(t) for t in ties]]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(
        F.col("_r") <= k).drop("_r")


def best_rows(df: DataFrame, by: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the smallest score per group, ties by the given columns.

    A struct minimum, so that each task sends on one row per group.
    """
    rest = [c for c in df.columns if c not in {*by, score, *ties}]
    row = F.min(F.struct(score, *ties, *rest)).alias("_b")
    return df.groupBy(*by).agg(row).select(*by, "_b.*").select(*df.columns)


def sample_keys(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` random distinct keys, the same ones for the same seed however rows are partitioned."""
    return df.select(key).distinct().orderBy(
        F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key).limit(k)


def grid(ranges: dict[str, Sequence], base: DataFrame) -> DataFrame:
    """Every combination of the ranges beside each row of ``base``, by nested explodes."""
    out = base
    for name, values in ranges.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def concat_frames(*frames: DataFrame) -> DataFrame:
    """Rows of several frames, matched by column name."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out
