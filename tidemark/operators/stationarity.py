"""Augmented Dickey-Fuller test and the choice of differencing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.gram import gramian, solve
from tidemark.operators.ordered import Series, attach, framed, join_keys
from tidemark.sources.shared import as_table

# Fixed published values, regression with constant, one series.
# P-value: normal distribution of a polynomial in the statistic (MacKinnon 1994).
P_LOW = (2.1659, 1.4412, 0.038269)
P_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
P_BREAK, P_MIN, P_MAX = -1.61, -18.83, 2.74
# Critical values: polynomial in 1/n (MacKinnon 2010).
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def p_value(tau: float) -> float:
    """P-value of the test statistic."""
    if tau > P_MAX:
        return 1.0
    if tau < P_MIN:
        return 0.0
    z = sum(c * tau ** i for i, c in enumerate(P_LOW if tau <= P_BREAK else P_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def difference_weights(d: int, seasonal: int, season: int) -> list[float]:
    """Coefficients of (1 - B)^d (1 - B^season)^seasonal, from B^0 on."""
    poly = np.array([1.0])
    step = np.zeros(season + 1)
    step[0], step[season] = 1.0, -1.0
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(seasonal):
        poly = np.convolve(poly, step)
    return poly.tolist()


def differenced_variants(df: DataFrame, s: Series, col: str, season: int, max_d: int,
                         max_seasonal: int) -> DataFrame:
    """Every differencing (d regular, sd seasonal) of each series as rows ``(keys, d, sd, rn, n, w)``.

    ``df`` has ``rn`` and ``n`` and no missing ``col``. Positions restart at 1.
    """
    pairs = [(d, b) for b in range(max_seasonal + 1) for d in range(max_d + 1)]
    reach = max_d + season * max_seasonal

    def made(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for d, b in pairs:
            total = F.lit(0.0)
            for i, weight in enumerate(difference_weights(d, b, season)):
                if weight:
                    total = total + (F.lag(col, i).over(w) if i else F.col(col)) * F.lit(weight)
            out[f"_w{d}_{b}"] = total
        return out

    wide = framed(df.select(*s.keys, *[c for c in s.order if c not in (*s.keys, "rn", col)], "rn", "n", col),
                  s, reach, 0, made)
    rows = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(b).alias("sd"),
                              F.lit(d + season * b).cast("long").alias("skip"),
                              F.col(f"_w{d}_{b}").alias("w")) for d, b in pairs])
    return wide.select(*s.keys, "rn", "n", F.explode(rows).alias("_v")).filter(
        F.col("rn") > F.col("_v.skip")).select(
        *s.keys, "_v.d", "_v.sd", (F.col("rn") - F.col("_v.skip")).alias("rn"),
        (F.col("n") - F.col("_v.skip")).alias("n"), "_v.w")


def lag_bound(n: Column) -> Column:
    """ceil(12 (n/100)^(1/4)), at most n // 2 - 2."""
    return F.least(F.ceil(F.lit(12.0) * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2).cast("int")


def _adf_row(n_max: int, gram: np.ndarray, head: np.ndarray, n_obs: int, autolag: bool) -> tuple:
    """Statistic, lag and observations from the matrix of one series.

    Columns of the matrix: constant, level before, differences 1..L before, difference.
    """
    target = gram.shape[0] - 1

    def score(lag: int) -> float:
        _, rss, _ = solve(gram, range(lag + 2), target)
        return n_obs * (math.log(2 * math.pi) + math.log(rss / n_obs) + 1) + 2 * (lag + 2)

    lag = min(range(n_max + 1), key=lambda p: (score(p), p)) if autolag else n_max
    # the chosen lag is fitted again on the rows that larger lags had to leave out
    full = gram.copy()
    steps = np.diff(head)
    for t in range(lag + 1, n_max + 1):
        x = np.zeros(target + 1)
        x[0], x[1], x[target] = 1.0, head[t - 1], steps[t - 1]
        x[2:2 + lag] = [steps[t - 1 - i] for i in range(1, lag + 1)]
        full += np.outer(x, x)
        n_obs += 1
    beta, rss, inverse = solve(full, range(lag + 2), target)
    sigma2 = rss / (n_obs - lag - 2)
    return float(beta[1] / math.sqrt(sigma2 * inverse[1, 1])), lag, n_obs


# classes double in width; bounds of 0 and below are class 0
WIDTH_CLASS = "CAST(ceil(log2(greatest(_bound, 1))) AS INT)"


def width_classes(stats: DataFrame) -> dict[int, int]:
    """Class and largest lag bound in it, of series with ``_bound``: one row per class comes back, some ten at most."""
    rows = stats.groupBy(F.expr(WIDTH_CLASS).alias("c")).agg(F.max("_bound").alias("w")).collect()
    return {r.c: max(0, r.w) for r in rows}


def _lag_gramian(z: DataFrame, s: Series, keys: list[str], width: int) -> DataFrame:
    """Cross products of constant, level before, ``width`` differences before, and difference, per series."""
    def made(w: WindowSpec) -> dict[str, Column]:
        return {f"_z{i}": F.lag("_z", i).over(w) for i in range(1, width + 2)}

    usable = framed(z, s, width + 1, 0, made).filter(
        "rn >= _bound + 2 AND _z IS NOT NULL AND _z1 IS NOT NULL").selectExpr(
        *[f"`{k}`" for k in keys], "1.0D AS _one", "_z1 AS _level", "_z - _z1 AS _x",
        *[f"coalesce(_z{i} - _z{i + 1}, 0.0D) AS _dz{i}" for i in range(1, width + 1)])
    return gramian(usable, keys, ["_one", "_level", *[f"_dz{i}" for i in range(1, width + 1)], "_x"])


def adf_test(df: DataFrame, s: Series, col: str, max_lag: int | None = None, autolag: bool = True,
             longest: int | None = None, alpha: float = 0.05) -> DataFrame:
    """One row per series: statistic, p-value, critical values, used lag, decision.

    ``df`` has ``rn`` and ``n`` and no missing ``col``. The lag is chosen by AIC up to
    the bound for the series length, or is ``max_lag`` itself without ``autolag``.
    Neither ``max_lag`` nor ``longest`` (an upper bound of the series length) given, the
    series are put in classes by their bound (:func:`width_classes`), each with a matrix of
    its own width, so a short series never gets the lag columns of the longest one. The
    means of the series are then written, and so are the scaled rows if there are several classes.
    """
    keys = list(s.keys)
    if max_lag is not None:
        width, bound = max_lag, F.least(F.lit(max_lag), F.floor(F.col("n") / 2) - 2).cast("int")
    elif longest is not None:
        width = max(0, min(math.ceil(12 * (longest / 100) ** 0.25), longest // 2 - 2))
        bound = F.least(lag_bound(F.col("n")), F.lit(width))
    else:
        width, bound = None, lag_bound(F.col("n"))
    stats = df.groupBy(*keys).agg(
        F.avg(col).alias("_mean"), F.stddev_pop(col).alias("_sd"), F.max("n").alias("n")).withColumn(
        "_bound", bound)
    classes = {}
    if width is None:
        stats = as_table(stats, "adf-series")
        classes = width_classes(stats)
        width = max(classes.values(), default=0)
    z = attach(df.select(*keys, "rn", col), stats, keys, ["rn"], how="inner").withColumn(
        "_z", (F.col(col) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    by_rn = Series(s.keys, ("rn",), s.block_rows)
    if len(classes) > 1:
        z = as_table(z, "adf-rows")
        grams = reduce(DataFrame.union, [_lag_gramian(z.filter(f"{WIDTH_CLASS} = {c}"), by_rn, keys, w)
                                         for c, w in sorted(classes.items())])
    else:
        grams = _lag_gramian(z, by_rn, keys, width)
    heads = z.filter(F.col("rn") <= F.col("_bound") + 1).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "_z"))), lambda v: v["_z"]).alias("head"))
    inputs = join_keys(join_keys(stats.select(*keys, "n", F.col("_bound").alias("bound")),
                                 grams, keys, "left"), heads, keys, "left")

    crit = list(CRITICAL)
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("n", T.LongType()), T.StructField("statistic", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()), T.StructField("used_lag", T.IntegerType()),
        T.StructField("n_obs", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in crit],
        T.StructField("stationary", T.BooleanType()), T.StructField("status", T.StringType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                rec = {k: getattr(row, k) for k in keys} | {"n": row.n}
                try:
                    side = math.isqrt(len(row.gram))
                    tau, lag, used = _adf_row(int(row.bound), np.reshape(row.gram, (side, side)),
                                              np.asarray(row.head, float), int(row.n_obs), autolag)
                    p = p_value(tau)
                    rec |= {"statistic": tau, "p_value": p, "used_lag": lag, "n_obs": used,
                            "stationary": p < alpha, "status": "ok"}
                    rec |= {c: sum(v / used ** i for i, v in enumerate(CRITICAL[c])) for c in crit}
                except (np.linalg.LinAlgError, ValueError, TypeError, ZeroDivisionError):
                    rec["status"] = "singular" if row.n > 3 else "too_short"
                rows.append(rec)
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"used_lag": "Int32", "n_obs": "Int64", "stationary": "boolean"})

    return inputs.mapInPandas(decide, schema)


def make_stationary(df: DataFrame, s: Series, col: str, season: int, max_d: int = 3,
                    longest: int | None = None, max_lag: int | None = None, autolag: bool = True) -> DataFrame:
    """The differencing each series needs: ``(keys, seasonal_diff, n_diff, p_value)``.

    A series that is not stationary takes the seasonal difference if that lowers the
    p-value, then regular differences until stationary, at most ``max_d``. All variants
    are tested in one pass; the last difference is applied without a test.
    ``p_value`` is that of the last test made. The lag arguments are those of :func:`adf_test`.
    """
    tall = differenced_variants(df, s, col, season, max_d - 1, 1)
    tests = adf_test(tall, s.keyed_by("d", "sd"), "w", max_lag, autolag, longest)
    per_key = tests.groupBy(*s.keys).agg(
        *[F.max(F.when((F.col("d") == d) & (F.col("sd") == b), F.col("p_value"))).alias(f"_p{d}_{b}")
          for b in (0, 1) for d in range(max_d)],
        *[F.max(F.when((F.col("d") == d) & (F.col("sd") == b), F.col("stationary"))).alias(f"_s{d}_{b}")
          for b in (0, 1) for d in range(max_d)])
    seasonal = F.coalesce(~F.col("_s0_0") & (F.col("_p0_1") < F.col("_p0_0")), F.lit(False))

    def steps(b: int) -> Column:
        return F.coalesce(*[F.when(F.col(f"_s{d}_{b}"), d) for d in range(max_d)], F.lit(max_d))

    def last_p(b: int) -> Column:
        return F.coalesce(*[F.when(F.col(f"_s{d}_{b}"), F.col(f"_p{d}_{b}")) for d in range(max_d)],
                          F.col(f"_p{max_d - 1}_{b}"))

    return per_key.select(*s.keys, seasonal.alias("seasonal_diff"),
                          F.when(seasonal, steps(1)).otherwise(steps(0)).alias("n_diff"),
                          F.when(seasonal, last_p(1)).otherwise(last_p(0)).alias("p_value"))


def apply_differencing(df: DataFrame, s: Series, col: str, decision: DataFrame, season: int,
                       max_d: int = 3) -> DataFrame:
    """Rows ``(keys, rn, n, w)`` of each series with the differencing chosen for it."""
    tall = differenced_variants(df, s, col, season, max_d, 1)
    chosen = decision.select(*s.keys, F.col("n_diff").alias("d"), F.col("seasonal_diff").cast("int").alias("sd"))
    return attach(tall, chosen, [*s.keys, "d", "sd"], ["rn"], how="inner").select(*s.keys, "rn", "n", "w")
