"""Summaries of Shapley values held as rows ``(keys, row id, feature[, lag], phi)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import attach
from tidemark.operators.ranking import top_k
from tidemark.sources.shared import as_table


def shapley_linear(rows: DataFrame, coefficients: DataFrame, background: DataFrame,
                   on: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Exact Shapley values of a linear model: ``beta * (value - background mean)``.

    ``rows`` and ``background`` hold ``value`` per ``on`` (keys, feature, lag);
    ``coefficients`` holds ``beta``. ``spread`` columns tell explained rows apart.
    """
    means = background.groupBy(*on).agg(F.avg("value").alias("base"))
    params = coefficients.join(means, list(on))
    return attach(rows, params, on, spread, how="inner").withColumn(
        "phi", F.col("beta") * (F.col("value") - F.col("base")))


def attribution_summary(phi: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, population std and mean absolute value of phi per feature (and lag)."""
    return phi.groupBy(*by).agg(
        F.avg("phi").alias("mean_phi"), F.stddev_pop("phi").alias("std_phi"),
        F.avg(F.abs("phi")).alias("mean_abs_phi"))


def attribution_by_feature(phi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Importance of an input column: mean over its lags of the mean absolute phi."""
    by_lag = phi.groupBy(*keys, "feature", "lag").agg(F.avg(F.abs("phi")).alias("_m"))
    return by_lag.groupBy(*keys, "feature").agg(F.avg("_m").alias("importance"))


def attribution_by_lag(phi: DataFrame, keys: Sequence[str] = (), n: int = 5) -> DataFrame:
    """Mean absolute phi per lag of the ``n`` most important features; lag 0 is the latest step."""
    by_lag = phi.groupBy(*keys, "feature", "lag").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    # from here on one row per feature and lag
    mean = F.avg("mean_abs_phi").over(Window.partitionBy(*keys, "feature"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("_mean"), "feature"))
    return by_lag.withColumn("_mean", mean).withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_mean", "_rank")


def explain_row(phi: DataFrame, base: DataFrame, row: dict[str, object], keys: Sequence[str] = ()) -> DataFrame:
    """Base value and the parts of one row's prediction, largest first.

    ``base`` has the expected output ``base_value`` per key.
    """
    picked = phi
    for c, v in row.items():
        picked = picked.filter(F.col(c) == F.lit(v))
    out = picked.join(base, list(keys)) if keys else picked.withColumn(
        "base_value", base.select("base_value").scalar())
    return out.orderBy(F.abs("phi").desc())


def dependence(phi: DataFrame, keys: Sequence[str] = (), n: int = 3) -> DataFrame:
    """Feature value against phi for the ``n`` features with the largest mean absolute phi."""
    # written once, as it is read twice
    phi = as_table(phi, "attribution")
    means = phi.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("_m"))
    top = top_k(means, "_m", n, by=keys, ties=["feature"])
    return phi.join(top.select(*keys, "feature"), [*keys, "feature"], "left_semi")


def wide_attribution(phi: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per explained row with a column ``SHAP_<feature>`` each."""
    return phi.groupBy(*ids).agg(*[
        F.max(F.when(F.col("feature") == f, F.col("phi"))).alias(f"SHAP_{f}") for f in features])
