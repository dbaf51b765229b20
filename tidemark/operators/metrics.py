"""Forecast and class metrics from rows of actual and predicted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_ratio
from tidemark.operators.aggregates import unpivot_row
from tidemark.operators.ordered import Series, keyed, positions


def regression_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    """n, MSE, RMSE, MAE, R2 (0 for constant actuals) and element-wise MAPE in one aggregate."""
    y, p = F.col(actual), F.col(predicted)
    err = y - p
    known = df.filter(y.isNotNull() & p.isNotNull())
    spread = F.col("_var") * F.col("n")
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"), F.var_pop(y).alias("_var"),
        F.min(y).alias("_lo"), F.max(y).alias("_hi"),
        (F.avg(F.abs(safe_ratio(err, y))) * 100).alias("mape")
    ).select(
        *by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
        F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(
            1 - F.try_divide(F.col("_sse"), spread)).alias("r2"), "mape")


def accuracy(df: DataFrame, by: Sequence[str] = (), actual: str = "actual",
             predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def fold_summary(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of each metric over the folds: ``(by, metric, mean, std)``."""
    tall = unpivot_row(metrics, names, by, name="metric", value="_v")
    return tall.groupBy(*by, "metric").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))


def mae_percent(fold_metrics: DataFrame, data: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """Mean fold MAE as a percentage of the mean target."""
    mae = fold_metrics.groupBy(*by).agg(F.avg("mae").alias("avg_mae"))
    means = data.groupBy(*by).agg(F.avg(target).alias("target_mean"))
    return mae.join(means, list(by)).withColumn(
        "mae_percent", F.try_divide(F.col("avg_mae"), F.col("target_mean")) * 100)


def batch_mean_loss(df: DataFrame, s: Series, loss: str, size: int = 1000) -> DataFrame:
    """Mean over batch means in series order; the last row never enters.

    An unequal last batch counts fully.
    """
    rows = positions(df, s).filter("rn < n")
    batches = rows.groupBy(*s.keys, F.floor((F.col("rn") - 1) / size).alias("_b")).agg(
        F.avg(loss).alias("_m"))
    return batches.groupBy(*s.keys).agg(F.avg("_m").alias("loss"), F.count(F.lit(1)).alias("batches"))


def actual_range(df: DataFrame, by: Sequence[str] = (), actual: str = "actual") -> DataFrame:
    return df.groupBy(*by).agg(F.min(actual).alias("min_actual"), F.max(actual).alias("max_actual"))


def split_counts(df: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Rows per split (and class), with their percentage of the series."""
    df, on = keyed(df, by)
    counts = df.groupBy(*on, "split", *extra).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy(*on).agg(F.sum("rows").alias("_rows"))
    return counts.join(totals, on).select(
        *by, "split", *extra, "rows", (F.col("rows") / F.col("_rows") * 100).alias("percent"))
