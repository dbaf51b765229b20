"""Scaling with population statistics, fitted per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Series, attach


def _fit_rows(df: DataFrame, fit_on: str) -> DataFrame:
    if fit_on == "all":
        return df
    if fit_on == "train":
        return df.filter("split = 'train'")
    raise ValueError(f"unknown fit_on {fit_on!r}")


def standard_params(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                    fit_on: str = "all") -> DataFrame:
    return _fit_rows(df, fit_on).groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_std_{c}") for c in cols])


def standard_scale(df: DataFrame, s: Series, cols: Sequence[str], fit_on: str = "all") -> DataFrame:
    """(x - mean) / population std per series; a constant column becomes 0."""
    if not cols:
        return df
    out = attach(df, standard_params(df, s.keys, cols, fit_on), s.keys, s.order)
    return out.withColumns({
        c: F.when(F.col(f"_std_{c}") == 0, F.col(c) - F.col(f"_mean_{c}")).otherwise(
            (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}")) for c in cols}).select(*df.columns)


def minmax_params(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  fit_on: str = "all") -> DataFrame:
    return _fit_rows(df, fit_on).groupBy(*keys).agg(
        *[F.min(c).alias(f"_min_{c}") for c in cols], *[F.max(c).alias(f"_max_{c}") for c in cols])


def minmax_scale(df: DataFrame, s: Series, cols: Sequence[str], fit_on: str = "all") -> DataFrame:
    """(x - min) / (max - min) per series; a constant column becomes 0."""
    out = attach(df, minmax_params(df, s.keys, cols, fit_on), s.keys, s.order)
    return out.withColumns({
        c: F.when(F.col(f"_max_{c}") == F.col(f"_min_{c}"), F.col(c) - F.col(f"_min_{c}")).otherwise(
            (F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}")))
        for c in cols}).select(*df.columns)


def minmax_inverse(df: DataFrame, params: DataFrame, s: Series, target: str,
                   cols: Sequence[str]) -> DataFrame:
    """Scaled ``cols`` back to the units of ``target``, with the parameters it was scaled by."""
    low, high = F.col(f"_min_{target}"), F.col(f"_max_{target}")
    own = params.select(*s.keys, f"_min_{target}", f"_max_{target}")
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return attach(df, own, s.keys, s.order).withColumns(
        {c: F.col(c) * width + low for c in cols}).select(*df.columns)
