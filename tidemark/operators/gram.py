"""Cross-product matrices per group, from which small regressions are solved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# beyond this many sums the aggregate no longer fits generated code
MAX_SUMS = 90
# cells of the partial matrices that one task holds back before it sends them on
MAX_CELLS = 8_000_000


def gramian(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``(keys, n_obs, gram)``: X'X over the rows of each group, row by row as an array.

    Rows must have no missing value in ``cols``. Partial matrices are summed in the
    map tasks, so a group of any size sends one matrix per task. Narrow matrices are
    plain sums; wide ones are multiplied batch-wise in numpy.
    """
    width = len(cols)
    if width * (width + 1) // 2 <= MAX_SUMS:
        # both triangles name the same sum, which Spark then computes once
        cells = [f"sum(`{cols[min(i, j)]}` * `{cols[max(i, j)]}`)" for i in range(width) for j in range(width)]
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_obs"), F.expr(f"array({', '.join(cells)})").alias("gram"))

    rows = df.selectExpr(*[f"`{k}`" for k in keys], *[f"CAST(`{c}` AS DOUBLE) AS _x{i}" for i, c in enumerate(cols)])
    names = [f"_x{i}" for i in range(width)]
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("_n", T.LongType()), T.StructField("_g", T.ArrayType(T.DoubleType()))])
    key_list = list(keys)

    def flush(held: dict) -> pd.DataFrame:
        out = pd.DataFrame({k: pd.Series(list(v), dtype=object) for k, v in zip(key_list, zip(*held))})
        out["_n"] = [n for n, _ in held.values()]
        out["_g"] = [g.ravel() for _, g in held.values()]
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(key_list, sort=False, dropna=False):
                # a null key is one group, whatever object stands for it
                key = tuple(None if pd.isna(k) else k for k in key)
                x = part[names].to_numpy()
                n, g = held.get(key, (0, 0.0))
                held[key] = (n + len(x), g + x.T @ x)
            if len(held) * width * width > MAX_CELLS:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return summed(rows.mapInPandas(partial, schema), keys)


def summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, n_obs, gram)`` from partial matrices ``(keys, _n, _g)``."""
    cells = parts.select(*keys, "_n", F.posexplode("_g").alias("_i", "_v")).groupBy(*keys, "_i").agg(
        F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    return cells.groupBy(*keys).agg(
        F.max("_n").alias("n_obs"),
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias("gram"))


def solve(gram: np.ndarray, inputs: Sequence[int], target: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares of one column on others from X'X: coefficients, RSS, inverse of the inputs' X'X.

    Inputs are put to unit length first. Raises ``LinAlgError`` when they are collinear.
    """
    idx = list(inputs)
    total = float(gram[target, target])
    if not idx:
        return np.empty(0), total, np.empty((0, 0))
    a, b = gram[np.ix_(idx, idx)], gram[idx, target]
    length = np.sqrt(np.diag(a))
    if not np.all(length > 0):
        raise np.linalg.LinAlgError("empty input")
    scaled = a / np.outer(length, length)
    if np.linalg.cond(scaled) > 1e12:
        raise np.linalg.LinAlgError("collinear inputs")
    inverse = np.linalg.inv(scaled) / np.outer(length, length)
    beta = np.linalg.solve(scaled, b / length) / length
    return beta, max(total - float(beta @ b), 0.0), inverse


def solve_many(grams: np.ndarray, inputs: Sequence[int], target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`solve` for a stack of matrices: coefficients, RSS, and False where ``solve`` would raise."""
    idx, total = list(inputs), grams[:, target, target]
    if not idx:
        return np.empty((len(grams), 0)), total, np.ones(len(grams), bool)
    a, b = grams[:, idx][:, :, idx], grams[:, idx, target]
    length = np.sqrt(np.diagonal(a, axis1=1, axis2=2))
    good = np.all(length > 0, axis=1) & np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    beta, at = np.zeros((len(grams), len(idx))), np.flatnonzero(good)
    a, b, length = a[at], b[at], length[at]
    scaled = a / (length[:, :, None] * length[:, None, :])
    if len(idx) > 1 and len(at):
        clear = ~(np.linalg.cond(scaled) > 1e12)
        good[at[~clear]] = False
        at, b, length, scaled = at[clear], b[clear], length[clear], scaled[clear]
    if len(at):
        beta[at] = np.linalg.solve(scaled, (b / length)[:, :, None])[:, :, 0] / length
    return beta, np.maximum(total - (beta * grams[:, idx, target]).sum(axis=1), 0.0), good
