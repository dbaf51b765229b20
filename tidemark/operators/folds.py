"""Ordered splits and expanding folds; frames carry ``rn`` and ``n``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_point(p: float, rounding: str = "floor") -> Column:
    """Rows in the first part: floor(n p), or round half to even of (1 - p) n."""
    if rounding == "floor":
        return F.floor(F.col("n") * F.lit(p)).cast("long")
    if rounding == "half_even":
        return F.bround(F.lit(1 - p) * F.col("n")).cast("long")
    raise ValueError(f"unknown rounding {rounding!r}")


def ordered_split(df: DataFrame, p: float, rounding: str = "floor") -> DataFrame:
    """Add ``split``: ``train`` before the cut, ``test`` from it on.

    With ``floor`` p is the train share, with ``half_even`` the test share.
    """
    return df.withColumn("split", F.when(F.col("rn") <= cut_point(p, rounding), "train").otherwise("test"))


def validation_tail(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Add boolean ``is_validation``: the last ``share`` of the training rows.

    ``rn`` counts within the series; ``train_n`` is its number of training rows.
    """
    keep = F.floor(F.col("train_n") * F.lit(1 - share))
    return df.withColumn("is_validation", (F.col("rn") > keep) & (F.col("rn") <= F.col("train_n")))


def expanding_folds(df: DataFrame, p: float = 0.5, k: int = 3) -> DataFrame:
    """Add ``fold`` 1..k and ``role``: each fold tests its slice and trains on all rows before.

    A row appears once per fold it takes part in (at most k times). The slice is
    (n - train) // k rows; the remainder is never tested.
    """
    train = F.floor(F.col("n") * F.lit(p))
    size = F.floor((F.col("n") - train) / k)
    parts = []
    for f in range(k):
        start = train + size * f
        parts.append(F.when(F.col("rn") <= start, F.struct(
            F.lit(f + 1).alias("fold"), F.lit("train").alias("role"))).when(
            F.col("rn") <= start + size, F.struct(
                F.lit(f + 1).alias("fold"), F.lit("test").alias("role"))))
    return df.withColumn("_f", F.explode(F.array_compact(F.array(*parts)))).select(
        *df.columns, "_f.fold", "_f.role")


def training_rows(folds: DataFrame, fold: int | None = None) -> DataFrame:
    """Training side of the folds: the first part with all earlier test slices."""
    rows = folds.filter("role = 'train'")
    return rows if fold is None else rows.filter(F.col("fold") == fold)
