"""Scalar column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(code: Column | str, n: int = 4, strict: bool = False) -> Column:
    """Array of ``n`` with a single 1: code 0 in the last slot, code c in slot c-1.

    Codes outside 0..n-1 give null, or an error when ``strict``.
    """
    c = F.col(code) if isinstance(code, str) else code
    slot = F.when(c == 0, F.lit(n - 1)).otherwise(c - 1)
    known = c.between(0, n - 1)
    hot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == slot).cast("int"))
    if strict:
        return F.when(known, hot).when(c.isNull(), F.lit(None)).otherwise(
            F.raise_error(F.concat(F.lit("unknown category code "), c.cast("string"))))
    return F.when(known, hot)


def log1p_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by ln(x + 1)."""
    return df.withColumns({c: F.log1p(c) for c in cols})


def safe_ratio(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """``a / (b + eps)``, missing where that divisor is zero."""
    return F.try_divide(a, b + F.lit(eps))


def argmax_class(scores: Column) -> Column:
    """Index of the largest score in an array; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def step_names(cols: Sequence[str], length: int) -> list[str]:
    """Names of flattened window columns, ``<col>_t-<lag>``, oldest step first."""
    return [f"{c}_t-{length - i - 1}" for i in range(length) for c in cols]
