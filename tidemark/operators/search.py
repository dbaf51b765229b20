"""Seeded random search over model parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import fold_summary
from tidemark.operators.ordered import Series
from tidemark.operators.ranking import best_rows
from tidemark.operators.regress import walk_forward_ml


def categorical(*values) -> list:
    return list(values)


def whole(low: int, high: int) -> list[int]:
    """Whole numbers low..high."""
    return list(range(low, high + 1))


def stepped(low: float, high: float, step: float) -> list[float]:
    """Numbers low, low + step, .. high."""
    return [round(low + i * step, 10) for i in range(int(round((high - low) / step)) + 1)]


def draw_trials(space: Mapping[str, Sequence], n_trials: int, seed: int) -> list[dict]:
    """Parameter choices per trial, drawn by hashing seed, trial and name: repeatable anywhere."""
    def pick(trial: int, name: str, values: Sequence):
        digest = hashlib.md5(f"{seed}-{trial}-{name}".encode()).hexdigest()
        return values[int(digest[:8], 16) % len(values)]

    return [{"trial": t, **{name: pick(t, name, values) for name, values in space.items()}}
            for t in range(n_trials)]


def run(df: DataFrame, s: Series, features: Sequence[str], target: str, params: Mapping,
        estimator: Callable[[Mapping], Estimator], p: float = 0.5, k: int = 3) -> DataFrame:
    """Validation of one fixed parameter set: mean and std of each metric over series and folds."""
    _, scores = walk_forward_ml(df, s, features, target, int(params["sequence_length"]),
                                estimator(params), p, k)
    return fold_summary(scores, ["mse", "mae", "rmse", "r2"])


def random_search(df: DataFrame, s: Series, features: Sequence[str], target: str,
                  space: Mapping[str, Sequence], estimator: Callable[[Mapping], Estimator] | None = None,
                  objective: Callable[[Mapping], DataFrame] | None = None, n_trials: int = 10, seed: int = 0, p: float = 0.5, k: int = 3,
                  parallelism: int = 4) -> DataFrame:
    """One row per trial with its parameters and mean fold RMSE.

    ``objective`` maps the parameters of a trial to one row with ``rmse``; without one,
    the trial's ``estimator`` is validated by :func:`run`. Trials are independent; a few
    run at a time so that their jobs share the cluster. One row per trial comes back.
    """
    spark: SparkSession = df.sparkSession

    def validated(params: Mapping) -> DataFrame:
        summary = run(df, s, features, target, params, estimator, p, k)
        return summary.filter("metric = 'rmse'").select(F.col("mean").alias("rmse"))

    def score(trial: dict) -> dict:
        params = {name: v for name, v in trial.items() if name != "trial"}
        return trial | {"rmse": float((objective or validated)(params).first()["rmse"])}

    with ThreadPool(min(parallelism, n_trials)) as pool:
        rows = pool.map(score, draw_trials(space, n_trials, seed))
    return spark.createDataFrame([Row(**row) for row in rows])


def best_trial(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The trial with the smallest RMSE."""
    return best_rows(trials, by, "rmse", ["trial"])


