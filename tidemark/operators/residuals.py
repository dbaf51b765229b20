"""Diagnostics of model residuals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import join_keys, Series, autocorrelation


def chi2_tail(q: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution for whole degrees of freedom."""
    half = q / 2
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    for i in range(1, (dof - 1) // 2 + 1):
        total += math.exp(-half) * half ** (i - 0.5) / math.gamma(i + 0.5)
    return total


@F.pandas_udf(T.DoubleType())
def _chi2_tails(q: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, int(b)) if pd.notna(a) and pd.notna(b) and b > 0 else None
                      for a, b in zip(q, dof, strict=True)], dtype="float64")


def ljung_box(df: DataFrame, s: Series, col: str, max_lag: int = 10) -> DataFrame:
    """Q over lags 1..h with h = min(max_lag, n // 5), and its p-value; ``df`` has ``rn``."""
    acf = autocorrelation(df, s, col, max_lag).withColumn(
        "h", F.least(F.lit(max_lag), F.floor(F.col("n") / 5)).cast("int"))
    q = F.sum(F.when(F.col("lag") <= F.col("h"), F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))))
    out = acf.groupBy(*s.keys).agg(
        F.max("n").alias("n"), F.max("h").alias("h"),
        (F.max("n") * (F.max("n") + 2) * q).alias("lb_stat"))
    return out.withColumn("lb_pvalue", _chi2_tails("lb_stat", "h"))


def jarque_bera(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Normality statistic n/6 (S^2 + K^2/4) and its p-value exp(-JB/2)."""
    out = df.groupBy(*keys).agg(
        F.count(col).alias("n"), F.skewness(col).alias("skewness"), F.kurtosis(col).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return out.withColumn("jb_stat", jb).withColumn("jb_pvalue", F.exp(-F.col("jb_stat") / 2))


def residual_moments(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Mean, sample std, population skewness and excess kurtosis."""
    return df.groupBy(*keys).agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.skewness(col).alias("skewness"), F.kurtosis(col).alias("kurtosis"))


def residual_diagnostics(df: DataFrame, s: Series, col: str) -> DataFrame:
    """Ljung-Box and Jarque-Bera p-values with the moments, one row per series."""
    lb = ljung_box(df, s, col).select(*s.keys, "lb_stat", "lb_pvalue")
    jb = jarque_bera(df, s.keys, col).select(*s.keys, "jb_stat", "jb_pvalue")
    return join_keys(join_keys(residual_moments(df, s.keys, col), jb, s.keys), lb, s.keys, "left")
