"""Regressors and classifiers on flattened windows of many series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.aggregates import problem_type
from tidemark.operators.folds import cut_point
from tidemark.operators.gram import gramian, solve
from tidemark.operators.metrics import batch_mean_loss, regression_metrics
from tidemark.operators.ordered import Series, attach, framed, join_keys
from tidemark.operators.scaling import minmax_inverse, minmax_params, minmax_scale, standard_scale
from tidemark.sources.shared import as_table


def window_vectors(df: DataFrame, s: Series, features: Sequence[str], target: str, length: int,
                   keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample: ``features`` (length x features values, oldest step first), ``label``,
    ``sample``; rows with a missing value in any step or in the label are dropped.

    ``df`` has ``rn`` and ``n``. Built from lag columns, so no arrays of structs are made.
    """
    def made(w: WindowSpec) -> dict[str, Column]:
        return {f"_{c}_{h}": F.lag(F.col(c).cast("double"), h).over(w)
                for h in range(length, 0, -1) for c in features}

    wide = framed(df, s, length, 0, made).filter(F.col("rn") > length)
    inputs = [f"_{c}_{h}" for h in range(length, 0, -1) for c in features]
    out = wide.na.drop(subset=[*inputs, target]).withColumns({
        "features": array_to_vector(F.array(*inputs)), "label": F.col(target).cast("double"),
        "sample": F.col("rn") - length})
    order = [c for c in s.order if c not in s.keys]
    return out.select(*dict.fromkeys([*s.keys, *order, *keep, "rn", "n", "sample", "features", "label"]))


@dataclass(frozen=True)
class SequenceRegressor:
    """Predict the next value of a series from its last ``length`` steps with any MLlib estimator.

    One model is fitted over the windows of all series.
    """

    estimator: Estimator
    features: tuple[str, ...]
    target: str
    length: int

    def windows(self, df: DataFrame, s: Series, keep: Sequence[str] = ()) -> DataFrame:
        return window_vectors(df, s, self.features, self.target, self.length, keep)

    def fit(self, windows: DataFrame) -> PipelineModel:
        return Pipeline(stages=[self.estimator]).fit(windows)


def stopped_boosting(validation: str = "is_validation", tolerance: float = 0.01, **params) -> GBTRegressor:
    """Boosted trees that stop once the loss on the validation rows no longer improves."""
    return GBTRegressor(validationIndicatorCol=validation, validationTol=tolerance, **params)


@dataclass(frozen=True)
class Boosted:
    """A boosted model, the validation loss after each round that was fitted, and the rounds of the best state."""

    model: GBTRegressionModel
    losses: list[float]
    kept: int


def patient_boosting(train: DataFrame, validation: DataFrame, patience: int = 10, rounds: int = 100, first: int = 16,
                     **params) -> Boosted:
    """Boosted trees up to the round of the least validation loss, given up ``patience`` rounds after it.

    Rounds are fitted in growing numbers, ``first`` and then twice as many, until the loss has not fallen below its
    least for ``patience`` rounds or ``rounds`` are done; with the same seed a longer run starts with the same
    trees. The model holds the trees up to the least loss before that point, ties to the fewer.
    """
    def fitted(n: int) -> GBTRegressionModel:
        return GBTRegressor(maxIter=n, **params).fit(train)

    n = min(first, rounds)
    while True:
        model = fitted(n)
        losses = list(model.evaluateEachIteration(validation, "squared"))
        stop = best = 0
        for stop, loss in enumerate(losses):
            best = stop if loss < losses[best] else best
            if stop - best >= patience:
                break
        done = stop - best >= patience
        if done or n == rounds:
            return Boosted(model if best + 1 == n else fitted(best + 1), losses[:stop + 1], best + 1)
        n = min(2 * n, rounds)


def sample_split(windows: DataFrame, length: int, p: float) -> DataFrame:
    """Add ``split`` by the windows themselves: the first floor((n - length) p) of a series are ``train``."""
    return windows.withColumn("split", F.when(
        F.col("sample") <= F.floor((F.col("n") - length) * F.lit(p)), "train").otherwise("test"))


def _scaled(df: DataFrame, s: Series, features: Sequence[str], target: str, p: float, fit_on: str) -> tuple[DataFrame, DataFrame]:
    """Standardised features and target in 0..1 per series, and the target's parameters."""
    if fit_on == "train":
        df = df.withColumn("split", F.when(F.col("rn") <= cut_point(p), "train").otherwise("test"))
    params = minmax_params(df, s.keys, [target], fit_on)
    return minmax_scale(standard_scale(df, s, [c for c in features if c != target], fit_on), s, [target], fit_on), params


def walk_forward_linear(df: DataFrame, s: Series, features: Sequence[str], target: str, length: int, p: float = 0.5,
                        k: int = 3, context: str = "fold", fit_on: str = "all", ridge: float = 0.0,
                        by_series: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`walk_forward_ml` for least squares, all folds at once.

    Each slice of rows gives one cross-product matrix of its windows, summed in the map tasks; the matrix of a fold is
    the sum of those of the slices before it. So the windows are read once for all models and no fold runs a job.
    ``by_series`` fits each series for itself. ``ridge`` is added to the diagonal, times the rows and not for the
    constant. A fold that cannot be fitted has no forecasts; its row of scores stays, without metrics.
    """
    if context not in ("fold", "history"):
        raise ValueError(f"unknown context {context!r}")
    scaled, params = _scaled(df, s, features, target, p, fit_on)
    windows = as_table(window_vectors(scaled, s, features, target, length), "windows")
    train_n = cut_point(p)
    size = F.floor((F.col("n") - train_n) / k)
    # 0 for the first training part, then the number of the slice; rows after the last slice are in none
    cut = windows.withColumn("_slice", F.when(F.col("rn") <= train_n, 0).when(
        size > 0, F.floor((F.col("rn") - train_n - 1) / size) + 1).cast("int"))
    inputs = len(features) * length
    names = ["_one", *[f"_x{i}" for i in range(inputs)], "label"]
    wide = cut.withColumn("_a", vector_to_array("features")).select(
        *s.keys, "_slice", F.lit(1.0).alias("_one"), *[F.get("_a", F.lit(i)).alias(f"_x{i}") for i in range(inputs)], "label")
    keys = [*(s.keys if by_series else ()), "fold"]
    folds = F.explode(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda f: f > F.col("_slice"))).alias("fold")
    slices = gramian(wide.filter(F.col("_slice") < k), [*keys[:-1], "_slice"], names)
    cells = slices.select(*keys[:-1], "n_obs", "gram", folds).select(*keys, "n_obs", F.posexplode("gram").alias("_i", "_v"))
    sums = cells.groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"), F.sum("n_obs").alias("_n")).groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias("gram"))
    schema = T.StructType([*[sums.schema[c] for c in keys], T.StructField("_beta", T.ArrayType(T.DoubleType())),
                           T.StructField("status", T.StringType())])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for gram, n in zip(pdf["gram"], pdf["_n"], strict=True):
                g = np.array(gram, float).reshape(len(names), len(names))
                g[range(1, inputs + 1), range(1, inputs + 1)] += ridge * n
                try:
                    found.append((solve(g, range(inputs + 1), inputs + 1)[0], "ok"))
                except np.linalg.LinAlgError:
                    found.append((None, "singular"))
            out = pdf[keys].copy()
            out["_beta"], out["status"] = [b for b, _ in found], [status for _, status in found]
            yield out

    models = sums.mapInPandas(fit, schema)
    lost = length if context == "fold" else 0
    test = cut.filter(F.col("_slice").between(1, k)).withColumnRenamed("_slice", "fold")
    inside = test.filter(F.col("rn") > train_n + size * (F.col("fold") - 1) + lost)
    order = [c for c in s.order if c not in s.keys]
    # one row a fold, or a series and fold
    scored = attach(inside, models.filter("status = 'ok'"), keys, ["rn"], how="inner").withColumn(
        "predicted", F.aggregate(F.zip_with(F.concat(F.array(F.lit(1.0)), vector_to_array("features")), "_beta", lambda x, b: x * b),
                                 F.lit(0.0), lambda a, x: a + x))
    forecasts = minmax_inverse(scored.select(*s.keys, *order, "rn", "fold", F.col("label").alias("actual"), "predicted"),
                               params, s, target, ["actual", "predicted"])
    every = join_keys(test.select(*s.keys, "fold").distinct(), models.select(*keys, "status"), keys, "left").withColumn(
        "status", F.coalesce("status", F.lit("no_rows")))
    return forecasts, join_keys(every, regression_metrics(forecasts, [*s.keys, "fold"]), [*s.keys, "fold"], "left")


def walk_forward_ml(df: DataFrame, s: Series, features: Sequence[str], target: str, length: int,
                    estimator: Estimator, p: float = 0.5, k: int = 3, context: str = "fold",
                    fit_on: str = "all", model_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Expanding-window validation in original units: forecasts and metrics per series and fold.

    Features are standardised and the target put to 0..1 per series, on all rows or on
    the first training part (``split = 'train'``). With ``context="fold"`` a test window
    lies wholly in its slice, so each slice loses its first ``length`` rows; with
    ``"history"`` windows reach back before it. k models are fitted, one after the
    other, and saved under ``model_dir/fold=<n>`` if given.
    """
    if context not in ("fold", "history"):
        raise ValueError(f"unknown context {context!r}")
    scaled, params = _scaled(df, s, features, target, p, fit_on)
    # every fold reads the windows again
    windows = as_table(window_vectors(scaled, s, features, target, length), "windows")
    train_n = cut_point(p)
    size = F.floor((F.col("n") - train_n) / k)
    lost = length if context == "fold" else 0
    parts = []
    for fold in range(1, k + 1):
        start = train_n + size * (fold - 1)
        model = estimator.fit(windows.filter(F.col("rn") <= start))
        if model_dir is not None:
            model.write().overwrite().save(f"{model_dir}/fold={fold}")
        test = windows.filter((F.col("rn") > start + lost) & (F.col("rn") <= start + size))
        parts.append(model.transform(test).select(
            *s.keys, *[c for c in s.order if c not in s.keys], "rn", F.lit(fold).alias("fold"),
            F.col("label").alias("actual"), F.col("prediction").alias("predicted")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    forecasts = minmax_inverse(out, params, s, target, ["actual", "predicted"])
    return forecasts, regression_metrics(forecasts, [*s.keys, "fold"])


def auto_estimator(df: DataFrame, target: str, max_classes: int = 10, **params) -> Estimator:
    """A random forest for classes when the target has at most ``max_classes`` values (one job)."""
    kind = problem_type(df, target, max_classes=max_classes).first()["problem"]
    params = {"numTrees": 100, "seed": 42} | params
    return RandomForestClassifier(**params) if kind == "classification" else RandomForestRegressor(**params)


def forest(df: DataFrame, features: Sequence[str], target: str, trees: int = 100, seed: int = 42,
           **params) -> PipelineModel:
    """Random forest classifier of 100 seeded trees on assembled columns."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
        RandomForestClassifier(labelCol=target, numTrees=trees, seed=seed, **params)]).fit(df)


def score_external(model: PipelineModel, windows: DataFrame, s: Series, batch: int = 1000
                   ) -> tuple[DataFrame, DataFrame]:
    """Mean batch loss and metrics per series of a fitted model on another data set."""
    scored = model.transform(windows).select(
        *s.keys, *[c for c in s.order if c not in s.keys], F.col("label").alias("actual"),
        F.col("prediction").alias("predicted"))
    error = F.col("actual") - F.col("predicted")
    loss = batch_mean_loss(scored.withColumn("_loss", error * error), s, "_loss", batch)
    return loss, regression_metrics(scored, s.keys)

