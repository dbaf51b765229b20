"""Seasonal autoregressive moving-average models for many series at once.

Every (series, differencing) is reduced to two cross-product matrices: one of a long
autoregression, whose residuals stand in for the shocks, and one of the lags of values
and shocks (Hannan and Rissanen 1982). Each candidate order is a sub-matrix of the
second one, so a whole order search scans the data twice, however many candidates.

Seasonal polynomials multiply the others, so a lag such as 1 + season has the product of two
parameters; Gauss-Newton steps on the cross-product matrix fit them. ``refined`` puts the
fitted model's residuals in place of the first shocks, one more matrix a step.

Departures from exact likelihood: least squares on the rows after the first ``m``
(the long autoregression's order); scores with different differencing rest on different data.
There is no constant term. ``llf`` is the conditional Gaussian one and k counts the variance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.folds import expanding_folds
from tidemark.operators.gram import gramian, solve, solve_many, summed
from tidemark.operators.metrics import fold_summary, regression_metrics
from tidemark.operators.ordered import Series, attach, framed, join_keys
from tidemark.operators.ranking import best_rows
from tidemark.operators.stationarity import difference_weights, differenced_variants
from tidemark.sources.shared import as_table

# 97.5 % point of the normal distribution
Z95 = 1.959963984540054
# fixed list of simple orders (p, d, q) tried when no seasonal candidate can be fitted
FALLBACK_ORDERS = ((0, 1, 0), (1, 0, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 1, 1))
FALLBACK_SCORE = 999999.0

ORDER = ["p", "d", "q", "sp", "sd", "sq"]
# steps of a forecast that one task makes at once
STEP_BLOCK = 4096
# values of equally long series that a task works on at once
STACK_CELLS = 200_000
# orders up to 1023 in each place of a candidate's number
CANDIDATE_BASE = 1024


@dataclass(frozen=True)
class Bounds:
    """Largest order of each part: p, d, q and the seasonal sp, sd, sq.

    ``multiplied=False`` adds the seasonal lags to the others without the products.
    """

    p: int = 2
    d: int = 1
    q: int = 2
    sp: int = 1
    sd: int = 1
    sq: int = 1
    multiplied: bool = True


# ---- candidates --------------------------------------------------------------------------------

def order_candidates(lengths: DataFrame, season: int, bounds: Bounds = Bounds()) -> DataFrame:
    """Candidate orders per series from its length ``n``, before pruning.

    Under 50 rows p and q stay at 1 without seasonal lags; under 100 rows at 2 with one
    seasonal lag; under three seasons there is no seasonal part and the period is 1.
    """
    n = F.col("n")
    short, medium, flat = n < 50, n < 100, n < 3 * season

    def limit(small: int | None, mid: int | None, full: int, seasonal: bool) -> Column:
        out = F.lit(full)
        if mid is not None:
            out = F.when(medium, mid).otherwise(out)
        if small is not None:
            out = F.when(short, small).otherwise(out)
        return F.when(flat, 0).otherwise(out) if seasonal else out

    limits = {
        "p": limit(1, 2, bounds.p, False), "d": F.lit(bounds.d), "q": limit(1, 2, bounds.q, False),
        "sp": limit(0, 1, bounds.sp, True), "sd": limit(None, None, bounds.sd, True),
        "sq": limit(0, 1, bounds.sq, True),
    }
    out = lengths.withColumn("season", F.when(flat, 1).otherwise(season))
    for name in ORDER:
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), limits[name])))
    return out.withColumn("candidate", candidate_id())


def candidate_id() -> Column:
    """Number that sorts orders as nested loops over p, d, q, sp, sd, sq would."""
    out = F.lit(0).cast("long")
    for name in ORDER:
        out = out * CANDIDATE_BASE + F.col(name)
    return out


def prune_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates a series is long enough for: n >= 3 k + season, k <= n // 10, d + sd <= 2,
    where k is the sum of all six orders."""
    total = sum((F.col(c) for c in ORDER[1:]), F.col("p"))
    return candidates.filter(
        (F.col("n") >= 3 * total + F.col("season")) & (total <= F.floor(F.col("n") / 10))
        & (F.col("d") + F.col("sd") <= 2))


# ---- shared regressions ------------------------------------------------------------------------

def _lags(p: int, sp: int, season: int, multiplied: bool) -> list[int]:
    """Lags that an order of p and a seasonal one of sp reach, ascending."""
    if not multiplied:
        return sorted({*range(1, p + 1), *(season * k for k in range(1, sp + 1))})
    return sorted({i + season * k for i in range(p + 1) for k in range(sp + 1)} - {0})


def _lag_names(bounds: Bounds, season: int) -> tuple[dict[str, int], dict[str, int]]:
    values = {f"_v{i}": i for i in _lags(bounds.p, bounds.sp, season, bounds.multiplied)}
    shocks = {f"_e{i}": i for i in _lags(bounds.q, bounds.sq, season, bounds.multiplied)}
    return values, shocks


def _product(plain: np.ndarray, seasonal: np.ndarray, season: int, sign: float, multiplied: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients by lag, from 1 on, of one side of the model, and their derivatives by plain, then seasonal parameters.

    ``sign`` is that of the product of two parameters: -1 for values, 1 for shocks.
    """
    p, sp = len(plain), len(seasonal)
    reach = p + season * sp
    coef, slope = np.zeros(reach + 1), np.zeros((reach + 1, p + sp))
    for i in range(p):
        coef[i + 1] += plain[i]
        slope[i + 1, i] += 1
    for k in range(sp):
        coef[season * (k + 1)] += seasonal[k]
        slope[season * (k + 1), p + k] += 1
        for i in range(p) if multiplied else ():
            at = i + 1 + season * (k + 1)
            coef[at] += sign * plain[i] * seasonal[k]
            slope[at, i] += sign * seasonal[k]
            slope[at, p + k] += sign * plain[i]
    return coef[1:], slope[1:]


def _model(theta: np.ndarray, order: dict[str, int], season: int, names: list[str], multiplied: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the columns ``names`` under the parameters p, sp, q, sq, and their derivatives."""
    p, sp, q, sq = (order[c] for c in ("p", "sp", "q", "sq"))
    beta, slope = np.zeros(len(names)), np.zeros((len(names), len(theta)))
    for head, first, a, b, sign in (("_v", 0, p, sp, -1.0), ("_e", p + sp, q, sq, 1.0)):
        own = theta[first:first + a + b]
        coef, d = _product(own[:a], own[a:], season, sign, multiplied)
        for lag in _lags(a, b, season, multiplied):
            row = names.index(f"{head}{lag}")
            beta[row], slope[row, first:first + a + b] = coef[lag - 1], d[lag - 1]
    return beta, slope


def _gauss_newton(gram: np.ndarray, order: dict[str, int], season: int, names: list[str], multiplied: bool,
                  steps: int = 60) -> tuple[np.ndarray, float]:
    """Parameters p, sp, q, sq and residual sum of squares; ``gram`` has ``names`` and then the target.

    A model without products of parameters takes one step, which is least squares. Raises ``LinAlgError`` for
    collinear inputs and ``ArithmeticError`` if the steps do not end.
    """
    size = order["p"] + order["sp"] + order["q"] + order["sq"]
    linear = not multiplied or not (order["p"] and order["sp"] or order["q"] and order["sq"])
    theta, width = np.zeros(size), len(names)

    def around(theta: np.ndarray) -> np.ndarray:
        # cross products of the derivatives and of what the parameters leave of the target
        beta, slope = _model(theta, order, season, names, multiplied)
        turn = np.zeros((width + 1, size + 1))
        turn[:width, :size], turn[:width, size], turn[width, size] = slope, -beta, 1.0
        return turn.T @ gram @ turn

    if not size:
        return theta, float(gram[width, width])
    local = around(theta)
    for _ in range(steps):
        step, rss, _ = solve(local, range(size), size)
        if linear:
            return step, rss
        share = 1.0
        while True:
            new = around(theta + share * step)
            if new[size, size] <= local[size, size] * (1 + 1e-12) or share < 1e-6:
                break
            share /= 2
        theta, local = theta + share * step, new
        if np.max(np.abs(share * step)) < 1e-10 * (1 + np.max(np.abs(theta))):
            return theta, max(float(local[size, size]), 0.0)
    raise ArithmeticError("no convergence")


def _terms(order: dict[str, int], season: int, multiplied: bool) -> list[str]:
    return ([f"_v{i}" for i in _lags(order["p"], order["sp"], season, multiplied)]
            + [f"_e{i}" for i in _lags(order["q"], order["sq"], season, multiplied)])


def _result(theta: np.ndarray, rss: float, n: int, order: dict[str, int], season: int, names: list[str], multiplied: bool) -> dict:
    """Columns of a fitted model. Raises ``ValueError`` if nothing is left to explain."""
    k = len(theta) + 1
    sigma2 = rss / n
    llf = -n / 2 * (math.log(2 * math.pi * sigma2) + 1)
    beta, _ = _model(theta, order, season, names, multiplied)
    return {"n_obs": n, "sigma2": sigma2, "llf": llf, "aic": 2 * k - 2 * llf, "bic": k * math.log(n) - 2 * llf,
            "coefs": [float(beta[names.index(t)]) for t in _terms(order, season, multiplied)], "params": theta.tolist(), "status": "ok"}


def _long_order(season: int, bounds: Bounds) -> int:
    return max(bounds.p + season * bounds.sp, bounds.q + season * bounds.sq,
               max(bounds.p, bounds.q, season * max(bounds.sp, bounds.sq, 1)) + 2)


def _own_order(m: int) -> Column:
    """Order of the long autoregression for a series of n rows: a third of it at most."""
    return F.least(F.lit(m), F.floor(F.col("n") / 3)).cast("int")


def _long_coefficients(grams: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    schema = T.StructType([grams.schema[k] for k in keys] + [
        T.StructField("_ar", T.ArrayType(T.DoubleType()))])
    key_list = list(keys)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for own, gram in zip(pdf["_m"], pdf["gram"], strict=True):
                coef = np.zeros(m)
                try:
                    beta, _, _ = solve(np.reshape(gram, (m + 1, m + 1)), range(int(own)), m)
                    coef[:len(beta)] = beta
                except np.linalg.LinAlgError:
                    pass  # no usable autoregression: the shocks are the values themselves
                found.append(coef)
            out = pdf[key_list].copy()
            out["_ar"] = found
            yield out

    return grams.mapInPandas(fit, schema)


def design_rows(df: DataFrame, s: Series, col: str, season: int, bounds: Bounds) -> DataFrame:
    """Rows ``(keys, d, sd, rn, n, w, shock, lags...)`` for every differencing in ``bounds``.

    ``df`` has ``rn`` and ``n`` and no missing ``col``.
    """
    m = _long_order(season, bounds)
    tall = differenced_variants(df, s, col, season, bounds.d, bounds.sd)
    own = Series((*s.keys, "d", "sd"), ("rn",), s.block_rows)
    values, shocks = _lag_names(bounds, season)
    ar = [f"_a{i}" for i in range(1, m + 1)]

    def back(w: WindowSpec) -> dict[str, Column]:
        return {f"_a{i}": F.coalesce(F.lag("w", i).over(w), F.lit(0.0)) for i in range(1, m + 1)}

    lagged = framed(tall, own, m, 0, back).withColumn("_m", _own_order(m))
    grams = gramian(lagged.filter("rn > _m"), own.keys, [*ar, "w"])
    orders = tall.groupBy(*own.keys).agg(F.max("n").alias("n")).select(*own.keys, _own_order(m).alias("_m"))
    coefs = _long_coefficients(join_keys(grams, orders, own.keys), own.keys, m)
    expected = sum((F.col("_ar")[i] * F.col(f"_a{i + 1}") for i in range(1, m)), F.col("_ar")[0] * F.col("_a1"))
    with_shock = attach(lagged, coefs, own.keys, ["rn"], how="inner").withColumn(
        "shock", F.when(F.col("rn") > F.col("_m"), F.col("w") - expected).otherwise(0.0)).withColumns(
        {name: F.col(f"_a{i}") for name, i in values.items()})

    def shock_lags(w: WindowSpec) -> dict[str, Column]:
        return {name: F.coalesce(F.lag("shock", i).over(w), F.lit(0.0)) for name, i in shocks.items()}

    reach = max([*shocks.values(), 1])
    kept = with_shock.select(*own.keys, "rn", "n", "_m", "w", "shock", *values)
    return framed(kept, own, reach, 0, shock_lags)


def _score_schema(candidates: DataFrame) -> T.StructType:
    return T.StructType(list(candidates.schema.fields) + [
        T.StructField("n_obs", T.LongType()), T.StructField("sigma2", T.DoubleType()),
        T.StructField("llf", T.DoubleType()), T.StructField("aic", T.DoubleType()),
        T.StructField("bic", T.DoubleType()), T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("coefs", T.ArrayType(T.DoubleType())), T.StructField("params", T.ArrayType(T.DoubleType())),
        T.StructField("status", T.StringType())])


def _fitted(order: dict, gram: np.ndarray | None, n: int, season: int, names: list[str], multiplied: bool) -> dict:
    """Columns of one candidate, fitted from the matrix of its series."""
    terms = _terms(order, season, multiplied)
    k = sum(order[c] for c in ("p", "q", "sp", "sq")) + 1
    rec = {"terms": terms, "status": "too_short", "n_obs": None, "coefs": None, "params": None}
    if gram is None or n <= k:
        return rec
    try:
        theta, rss = _gauss_newton(gram, order, season, names, multiplied)
        return rec | _result(theta, rss, n, order, season, names, multiplied)
    except (np.linalg.LinAlgError, ValueError):
        return rec | {"status": "singular"}
    except ArithmeticError:
        return rec | {"status": "not_converged"}


def fit_orders(design: DataFrame, keys: Sequence[str], candidates: DataFrame, season: int,
               bounds: Bounds) -> DataFrame:
    """Fit every candidate row ``(keys, p, d, q, sp, sd, sq, ...)`` from the design rows.

    Adds n_obs, sigma2, llf, aic, bic, the coefficients by lag and a status. A candidate that
    cannot be fitted keeps its row with a status other than ``ok``.
    """
    values, shocks = _lag_names(bounds, season)
    names, multiplied = [*values, *shocks], bounds.multiplied
    group = [*keys, "d", "sd"]
    grams = gramian(design.filter("rn > _m"), group, [*names, "w"])
    schema = _score_schema(candidates)
    width = len(names) + 1
    key_list = list(keys)
    own = [c for c in candidates.columns if c not in key_list]
    # one matrix a series and differencing beside the list of its candidates, of which the bounds allow so many
    lists = candidates.groupBy(*group).agg(F.collect_list(F.struct(*own)).alias("_own"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for found, gram, n in zip(pdf["_own"], pdf["gram"], pdf["n_obs"], strict=True):
                whole = None if gram is None else np.reshape(np.asarray(gram, float), (width, width))
                for one in found:
                    one = one if isinstance(one, dict) else one.asDict()
                    rows.append(one | _fitted({c: int(one[c]) for c in ORDER}, whole, 0 if gram is None else int(n), season, names, multiplied))
            out = pd.DataFrame(rows, columns=[*own, "n_obs", "sigma2", "llf", "aic", "bic", "terms", "coefs", "params", "status"])
            base = pdf[key_list].loc[pdf.index.repeat([len(x) for x in pdf["_own"]])].reset_index(drop=True)
            yield pd.concat([base, out.astype({"n_obs": "Int64"})], axis=1)[schema.names]

    return join_keys(lists, grams, group, "left").select(*keys, "_own", "n_obs", "gram").mapInPandas(score, schema)


# ---- many short series -------------------------------------------------------------------------

def _stretches(df: DataFrame, s: Series, col: str, reach: int) -> DataFrame:
    """(keys, _block, n, _at, _y): the values of each series in order, in blocks after the ``reach`` values before them.

    ``_at`` is the position of the first value. Without ``block_rows`` a series is one block. Rows are shuffled once,
    and not again where they lie by key, as after :func:`positions` of short series.
    """
    size = s.block_rows
    if size is not None and reach > size:
        raise ValueError(f"frame of {reach} rows exceeds the block of {size}")
    rows = df.select(*s.keys, "rn", "n", F.col(col).cast("double").alias("_v"))
    own = F.lit(0).cast("long") if size is None else F.floor((F.col("rn") - 1) / F.lit(size)).cast("long")
    rows = rows.withColumn("_block", own)
    if size is not None:
        late = F.pmod(F.col("rn") - 1, F.lit(size)) >= size - reach
        rows = rows.withColumn("_block", F.explode(F.array_compact(F.array("_block", F.when(late & (F.col("rn") < F.col("n")), F.col("_block") + 1)))))
    found = rows.groupBy(*s.keys, "_block").agg(
        F.max("n").alias("n"), F.min("rn").alias("_at"), F.max("rn").alias("_last"),
        F.sort_array(F.collect_list(F.struct("rn", "_v"))).alias("_y"))
    return found.filter(F.col("_last") > F.col("_block") * (size or 0)).drop("_last").withColumn("_y", F.col("_y._v"))


class _Stack:
    """Equally long and equally placed blocks of values, one a row, and the matrices of one differencing.

    The columns are those of :func:`design_rows`: lags before the start are 0, missing values and lags too. Only the
    rows from ``first`` on, those after what a block repeats, count.
    """

    def __init__(self, y: np.ndarray, missing: np.ndarray, at: int, first: int, n: int, d: int, sd: int, season: int, m: int):
        skip, size = d + season * sd, y.shape[1]
        w, gap = np.zeros((len(y), max(size - skip, 0))), np.zeros((len(y), max(size - skip, 0)), bool)
        for i, weight in enumerate(difference_weights(d, sd, season)):
            if weight and size > skip:
                w += y[:, skip - i:size - i] * weight
                gap |= missing[:, skip - i:size - i]
        w[gap] = 0.0
        self.m, self.w, self.gap = min(m, max(n - skip, 0) // 3), w, gap
        self.rn = np.arange(w.shape[1]) + at
        self.use = (self.rn > self.m) & (self.rn + skip >= first)
        self.back = [self._lag(w, i) for i in range(1, m + 1)]

    @staticmethod
    def _lag(v: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros_like(v)
        out[:, i:] = v[:, :-i]
        return out

    def _gram(self, columns: list[np.ndarray]) -> np.ndarray:
        x = np.stack([c[:, self.use] for c in columns], axis=2)
        return np.matmul(x.transpose(0, 2, 1), x)

    def long_gram(self) -> np.ndarray:
        return self._gram([*self.back, self.w])

    def order_gram(self, ar: np.ndarray, values: Sequence[int], shocks: Sequence[int]) -> tuple[np.ndarray, int]:
        """The matrix that candidates are fitted from and its number of rows."""
        expected = ar[:, 0, None] * self.back[0]
        for i in range(1, len(self.back)):
            expected += ar[:, i, None] * self.back[i]
        shock = np.where((self.rn > self.m) & ~self.gap, self.w - expected, 0.0)
        gram = self._gram([*[self.back[i - 1] for i in values], *[self._lag(shock, i) for i in shocks], self.w])
        return gram, int(self.use.sum())


def _long_fit(grams: np.ndarray, own: int) -> np.ndarray:
    """Coefficients of the long autoregressions; none where they are collinear, as in :func:`_long_coefficients`."""
    m = grams.shape[1] - 1
    coef = np.zeros((len(grams), m))
    beta, _, good = solve_many(grams, range(own), m)
    coef[good, :own] = beta[good]
    return coef


def _fit_many(order: dict, grams: np.ndarray | None, n: int, count: int, season: int, names: list[str], multiplied: bool) -> dict:
    """Columns of one candidate for ``count`` series: those of :func:`_fitted`, a row a series."""
    p, sp, q, sq = (order[c] for c in ("p", "sp", "q", "sq"))
    terms, size, width = _terms(order, season, multiplied), p + sp + q + sq, len(names)
    out = {c: np.full(count, np.nan) for c in ("sigma2", "llf", "aic", "bic")}
    out |= {"terms": terms, "status": np.full(count, "too_short", object), "coefs": None, "params": None, "n": n}
    if grams is None or n <= size + 1:
        return out
    if multiplied and (p and sp or q and sq):
        made = [_fitted(order, g, n, season, names, multiplied) for g in grams]
        good = [x["status"] == "ok" for x in made]
        for c in ("sigma2", "llf", "aic", "bic"):
            out[c][good] = [x[c] for x, g in zip(made, good) if g]
        for c, long in (("coefs", len(terms)), ("params", size)):
            out[c] = np.array([x[c] if g else [0.0] * long for x, g in zip(made, good)], float)
        return out | {"status": np.array([x["status"] for x in made], object)}
    out["status"][:] = "singular"
    try:
        _, slope = _model(np.zeros(size), order, season, names, multiplied)
    except ValueError:  # a lag beyond the bounds
        return out
    turn = np.zeros((width + 1, size + 1))
    turn[:width, :size], turn[width, size] = slope, 1.0
    theta, rss, good = solve_many(turn.T @ grams @ turn, range(size), size)
    good = good & (rss != 0)
    sigma2 = rss[good] / n
    llf = -n / 2 * (np.log(2 * math.pi * sigma2) + 1)
    out["sigma2"][good], out["llf"][good] = sigma2, llf
    out["aic"][good], out["bic"][good] = 2 * (size + 1) - 2 * llf, (size + 1) * math.log(n) - 2 * llf
    out["status"][good] = "ok"
    return out | {"coefs": theta @ slope[[names.index(t) for t in terms]].T, "params": theta}


def _search(stretches: DataFrame, s: Series, lists: DataFrame, schema: T.StructType, season: int, bounds: Bounds) -> DataFrame:
    """Every candidate of ``lists (n, _own)`` fitted to every series of :func:`_stretches`.

    A series of one block is fitted in the task that reads it, with others of its length. Blocks of longer ones give
    partial matrices, which are summed: first those of the long autoregression, then those with its residuals.
    """
    value_lags, shock_lags = _lag_names(bounds, season)
    names, multiplied, m = [*value_lags, *shock_lags], bounds.multiplied, _long_order(season, bounds)
    values, shocks = list(value_lags.values()), list(shock_lags.values())
    pairs = [(d, b) for b in range(bounds.sd + 1) for d in range(bounds.d + 1)]
    keys, size, width, out_schema = list(s.keys), s.block_rows, len(names) + 1, to_arrow_schema(schema)

    def stacks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[int, int, int], np.ndarray, np.ndarray]]:
        """Rows of a batch with as many values at the same place: their numbers, (n, at, first), values and gaps."""
        y = b.column("_y")
        n, at, block = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "_at", "_block"))
        long, flat = np.diff(y.offsets.to_numpy()), y.flatten()
        start = np.r_[0, np.cumsum(long)]
        missing = flat.is_null().to_numpy(zero_copy_only=False)
        number = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        alike, which = np.unique(np.stack([n, at, block, long], axis=1), axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(len(alike) + 1))
        for (n_, at_, block_, long_), a, z in zip(alike.tolist(), cuts[:-1], cuts[1:]):
            step = max(1, STACK_CELLS // max(long_, 1))
            for i in range(a, z, step):
                rows = order[i:min(i + step, z)]
                cells = start[rows][:, None] + np.arange(long_)
                yield rows, (n_, at_, block_ * (size or 0) + 1), number[cells], missing[cells]

    def blanked(grams: np.ndarray, have: np.ndarray) -> np.ndarray:
        # without any value the sums of the target are unknown, not 0
        grams[have == 0, -1, :] = np.nan
        grams[have == 0, :, -1] = np.nan
        return grams

    def scored(b: pa.RecordBatch, made: list[tuple[np.ndarray, int, list[dict], dict]]) -> Iterator[pa.RecordBatch]:
        """Output rows of groups of series: their numbers, n, candidates and matrices by differencing."""
        for rows, n, wanted, grams in made:
            parts = []
            for one in wanted:
                order = {c: int(one[c]) for c in ORDER}
                gram, n_obs = grams.get((order["d"], order["sd"]), (None, 0))
                parts.append((one, _fit_many(order, gram, n_obs, len(rows), season, names, multiplied)))
            yield _rows(b, rows, n, parts, out_schema, keys)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, (n, at, first), y, missing in stacks(b):
                wanted, grams = b.column("_own")[int(rows[0])].as_py(), {}
                for d, sd in pairs:
                    if n > d + season * sd:
                        st = _Stack(y, missing, at, first, n, d, sd, season, m)
                        gram, n_obs = st.order_gram(_long_fit(st.long_gram(), st.m), values, shocks)
                        grams[d, sd] = blanked(gram, (~st.gap[:, st.use]).sum(axis=1)), n_obs
                yield from scored(b, [(rows, n, wanted, grams)])

    single = stretches if size is None else stretches.filter(F.col("n") <= size)
    found = single.join(lists, "n").select(*keys, "n", "_at", "_block", "_y", "_own").mapInArrow(alone, schema)
    if size is None or not stretches.filter(F.col("n") > size).limit(1).count():
        return found

    many = stretches.filter(F.col("n") > size)
    group = [*keys, "d", "sd"]
    fields = [stretches.schema[k] for k in keys] + [T.StructField("d", T.IntegerType()), T.StructField("sd", T.IntegerType())]
    part = T.StructType([*fields, T.StructField("_n", T.LongType()), T.StructField("_g", T.ArrayType(T.DoubleType()))])

    def partial(b: pa.RecordBatch, row: int, d: int, sd: int, n: int, g: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[b.column(k).slice(row, 1) for k in keys], pa.array([d], pa.int32()), pa.array([sd], pa.int32()),
                                           pa.array([n], pa.int64()), pa.array([g.ravel()], pa.list_(pa.float64()))], names=part.names)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, (n, at, first), y, missing in stacks(b):
                for d, sd in pairs:
                    st = _Stack(y, missing, at, first, n, d, sd, season, m)
                    for row, g in zip(rows.tolist(), st.long_gram()):
                        yield partial(b, row, d, sd, int(st.use.sum()), g)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, (n, at, first), y, missing in stacks(b):
                for i, row in enumerate(rows.tolist()):
                    for fit in b.column("_fits")[row].as_py():
                        st = _Stack(y[i:i + 1], missing[i:i + 1], at, first, n, fit["d"], fit["sd"], season, m)
                        gram, n_obs = st.order_gram(np.array([fit["_ar"]]), values, shocks)
                        have = float((~st.gap[:, st.use]).sum())
                        yield partial(b, row, fit["d"], fit["sd"], n_obs, np.r_[gram.ravel(), have])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (n, wanted, made) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "_own", "_grams")))):
                grams = {}
                for x in made:
                    gram = np.array(x["gram"])
                    grams[x["d"], x["sd"]] = blanked(gram[:-1].reshape(1, width, width), gram[-1:]), x["n_obs"]
                yield from scored(b, [(np.array([row]), n, wanted, grams)])

    lengths = many.filter("_block = 0").select(*keys, "n")
    skip = F.col("d") + F.lit(season) * F.col("sd")
    grams = join_keys(summed(many.mapInArrow(first_pass, part), group), lengths, keys)
    grams = grams.withColumn("n", F.col("n") - skip).withColumn("_m", _own_order(m))
    fits = _long_coefficients(grams, group, m).groupBy(*keys).agg(F.collect_list(F.struct("d", "sd", "_ar")).alias("_fits"))
    again = summed(attach(many, fits, keys, ["_block"], how="inner").mapInArrow(second_pass, part), group)
    whole = again.groupBy(*keys).agg(F.collect_list(F.struct("d", "sd", "n_obs", "gram")).alias("_grams"))
    whole = join_keys(whole, lengths, keys).join(lists, "n").select(*keys, "n", "_own", "_grams")
    return found.union(whole.mapInArrow(together, schema))


def _rows(b: pa.RecordBatch, rows: np.ndarray, n: int, parts: list[tuple[dict, dict]], schema: pa.Schema, keys: list[str]) -> pa.RecordBatch:
    """Output rows of the series ``rows`` of a batch, candidate by candidate."""
    count, times = len(rows), len(parts)
    good = [fit["status"] == "ok" for _, fit in parts]
    all_good = np.concatenate(good) if parts else np.empty(0, bool)

    def lists(cells: list[np.ndarray], some: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Rows of equally long lists for each candidate; null where not ``some``."""
        long = np.repeat([c.shape[1] for c in cells], count)
        offsets = np.r_[0, np.cumsum(long)].astype(np.int32)
        flat = pa.array(np.concatenate([c.ravel() for c in cells]) if cells else [], kind)
        return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~some))

    def numbers(name: str) -> np.ndarray:
        return np.concatenate([fit[name] for _, fit in parts]) if parts else np.empty(0)

    made = {}
    for name in schema.names:
        kind = schema.field(name).type
        if name in keys:
            made[name] = b.column(name).take(pa.array(np.tile(rows, times)))
        elif name == "n":
            made[name] = pa.array(np.full(count * times, n), kind)
        elif name == "n_obs":
            made[name] = pa.array(np.repeat([fit["n"] for _, fit in parts], count), kind, mask=~all_good)
        elif name in ("sigma2", "llf", "aic", "bic"):
            v = numbers(name)
            made[name] = pa.array(v, kind, mask=np.isnan(v))
        elif name == "terms":
            made[name] = lists([np.tile(np.array(fit["terms"], object), (count, 1)).reshape(count, -1) for _, fit in parts],
                               np.ones(count * times, bool), pa.string())
        elif name in ("coefs", "params"):
            made[name] = lists([np.zeros((count, 0)) if fit[name] is None else fit[name] for _, fit in parts], all_good, pa.float64())
        elif name == "status":
            made[name] = pa.array(numbers(name), kind)
        else:
            made[name] = pa.array(np.repeat([one[name] for one, _ in parts], count), kind)
    return pa.RecordBatch.from_arrays([made[c].cast(schema.field(c).type) for c in schema.names], schema=schema)


# ---- order search ------------------------------------------------------------------------------

def _fallback_candidates(lengths: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"))
                     for p, d, q in FALLBACK_ORDERS])
    return lengths.select("*", F.posexplode(rows).alias("_i", "_o")).select(
        *lengths.columns, F.lit(1).alias("season"), "_o.p", "_o.d", "_o.q", F.lit(0).alias("sp"),
        F.lit(0).alias("sd"), F.lit(0).alias("sq"), F.col("_i").cast("long").alias("candidate"))


def order_search(df: DataFrame, s: Series, col: str, season: int, bounds: Bounds = Bounds(),
                 criterion: str = "aic", fallback: bool = True) -> DataFrame:
    """Every candidate of every series with its score; ``stage`` 0 searched, 1 simple, 2 random walk.

    ``df`` has ``rn`` and ``n`` and no missing ``col``. The best order per series is
    :func:`best_orders` of this.
    """
    # the values a block needs before it: of a shock's lag, its autoregression and the differences
    reach = 2 * _long_order(season, bounds) + bounds.d + season * bounds.sd
    stretches = as_table(_stretches(df, s, col, reach), "stretches")
    lengths = stretches.filter("_block = 0").select(*s.keys, "n")
    # candidates depend on the length alone: one list for each length
    different = lengths.select("n").distinct()
    wanted = prune_candidates(order_candidates(different, season, bounds)).withColumn("stage", F.lit(0))
    if fallback:
        wanted = wanted.unionByName(_fallback_candidates(different).withColumn("stage", F.lit(1)))
    # written, so that Spark knows their size before it would deal the series out by length
    lists = as_table(wanted.groupBy("n").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "n"])).alias("_own")), "candidates")
    schema = _score_schema(lengths.limit(0).join(wanted.limit(0), "n").select(*s.keys, *wanted.columns))
    fitted = _search(stretches, s, lists, schema, season, bounds)
    score = F.col("bic" if criterion.lower() == "bic" else "aic")
    finite = (F.col("status") == "ok") & ~F.isnan(score) & (F.abs(score) != F.lit(float("inf")))
    fitted = fitted.withColumn("score", F.when(finite, score))
    if not fallback:
        return fitted
    walk = _fallback_candidates(lengths).filter("candidate = 0").select(
        "*", F.lit(2).alias("stage"), F.lit(FALLBACK_SCORE).alias("score"),
        F.lit(FALLBACK_SCORE).alias("aic"), F.lit(FALLBACK_SCORE).alias("bic"),
        F.lit("random_walk").alias("status"))
    return fitted.unionByName(walk, allowMissingColumns=True)


def best_orders(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best scored row per series: searched ones first, then simple ones, then the random walk."""
    usable = scored.filter(F.col("score").isNotNull()).select(
        *keys, "stage", "score", "candidate", *ORDER, "season", "aic", "bic", "status")
    return best_rows(usable, keys, "stage", ["score", "candidate"])


# ---- fit, residuals, forecast ------------------------------------------------------------------

def default_orders(df: DataFrame, keys: Sequence[str], season: int) -> DataFrame:
    """(1,1,1)(1,1,1) for each series."""
    return df.select(*keys).distinct().select(*keys, *[F.lit(1).alias(c) for c in ORDER],
                                              F.lit(season).alias("season"))


def fit_seasonal(design: DataFrame, s: Series, orders: DataFrame, season: int,
                 bounds: Bounds = Bounds()) -> DataFrame:
    """One fitted model per series of ``orders`` from :func:`design_rows`."""
    return fit_orders(design, s.keys, orders.select(*s.keys, *ORDER), season, bounds)


def _expected(design: DataFrame, keys: Sequence[str], model: DataFrame, season: int, bounds: Bounds) -> tuple[DataFrame, Column]:
    """Design rows of the fitted models beside their coefficients, and the value the model expects."""
    values, shocks = _lag_names(bounds, season)
    on = [*keys, "d", "sd"]
    fit = model.filter("status = 'ok'").select(*on, F.map_from_arrays("terms", "coefs").alias("_beta"))
    expected = F.lit(0.0)
    for name in [*values, *shocks]:
        expected = expected + F.coalesce(F.col("_beta")[name], F.lit(0.0)) * F.col(name)
    return attach(design, fit, on, ["rn"], how="inner"), expected


def _filters(theta: np.ndarray, order: dict[str, int], season: int, multiplied: bool, memory: int) -> tuple[np.ndarray, ...]:
    """Parameters, and weights by lag of the values that give: values and shocks filtered by the inverse of the
    moving-average part, and the shocks themselves.

    Moving-average parameters without an inverse are shrunk until the weights fade within ``memory``.
    """
    p, sp, q, sq = (order[c] for c in ("p", "sp", "q", "sq"))

    def divide(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        out = np.zeros(memory + 1)
        out[:len(top)] = top[:memory + 1]
        for t in range(memory + 1):
            back = bottom[1:t + 1]
            out[t] -= back @ out[t - 1::-1][:len(back)] if t and len(back) else 0.0
        return out

    while True:
        a, _ = _product(theta[:p], theta[p:p + sp], season, -1.0, multiplied)
        b, _ = _product(theta[p + sp:p + sp + q], theta[p + sp + q:], season, 1.0, multiplied)
        values, shocks = np.r_[1.0, -a], np.r_[1.0, b]
        inverse = divide(np.ones(1), shocks)
        if np.abs(inverse[-season:]).max() < 0.05 or not (q or sq):
            break
        theta = np.r_[theta[:p + sp], 0.9 * theta[p + sp:]]
    own = divide(values, shocks)
    return theta, inverse, divide(own, shocks), own


def refined(design: DataFrame, s: Series, orders: DataFrame, season: int, bounds: Bounds = Bounds(),
            steps: int = 4, memory: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Design and models after ``steps`` Gauss-Newton steps on the models' own shocks.

    The first fit takes the residuals of a long autoregression for the shocks. Here the shocks follow from the
    model itself: values and shocks are filtered by the inverse of the moving-average part, cut off after ``memory``
    lags, and the change of the parameters is the regression of the shocks on the lags of both. A step filters all
    rows once and takes one matrix a series; one that raises the sum of squares is halved. The model kept is the one
    with the least sum; models without a moving-average part stay as they are.
    """
    values, shocks = _lag_names(bounds, season)
    names, multiplied = [*values, *shocks], bounds.multiplied
    memory = memory or max(10 * season, 60)
    group, keys = [*s.keys, "d", "sd"], list(s.keys)
    own = Series(tuple(group), ("rn",), s.block_rows)
    reach, width = max([*values.values(), *shocks.values(), 1]), len(names) + 1
    first = as_table(fit_seasonal(design, s, orders, season, bounds), "models")
    fields = [first.schema[c] for c in [*keys, *ORDER]]
    numbers = T.ArrayType(T.DoubleType())
    held = T.StructType([*fields, T.StructField("_n", T.LongType()), *[
        T.StructField(c, numbers) for c in ("_theta", "_best", "_inverse", "_double", "_own")], T.StructField("_least", T.DoubleType())])

    def state(pdf: pd.DataFrame, rows: list[tuple]) -> pd.DataFrame:
        out = pdf[[*keys, *ORDER]].reset_index(drop=True)
        made = []
        for order, (theta, best, least, n) in zip(out[ORDER].to_dict("records"), rows, strict=True):
            theta, inverse, double, own_ = _filters(np.asarray(theta, float), order, season, multiplied, memory)
            made.append((n, theta, np.asarray(best, float), inverse, double, own_, least))
        return pd.concat([out, pd.DataFrame(made, columns=["_n", "_theta", "_best", "_inverse", "_double", "_own", "_least"])], axis=1)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield state(pdf, [(t, t, math.inf, int(n)) for t, n in zip(pdf["params"], pdf["n_obs"])])

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                order = {c: int(row[c]) for c in ORDER}
                gram = np.reshape(np.asarray(row["gram"], float), (width, width))
                theta, best, least = np.asarray(row["_theta"], float), np.asarray(row["_best"], float), row["_least"]
                rss = float(gram[-1, -1])
                if rss <= least:
                    best, least = theta, rss
                    try:
                        _, slope = _model(theta, order, season, names, multiplied)
                        turn = np.zeros((width, len(theta) + 1))
                        turn[:-1, :-1], turn[-1, -1] = slope, 1.0
                        theta = theta + solve(turn.T @ gram @ turn, range(len(theta)), len(theta))[0]
                    except np.linalg.LinAlgError:
                        pass
                else:
                    theta = (theta + best) / 2
                rows.append((theta, best, least, int(row["_n"])))
            yield state(pdf, rows)

    def filtered(at: DataFrame) -> DataFrame:
        with_state = attach(design.select(*group, "rn", "n", "_m", "w"), at.select(*group, "_inverse", "_double", "_own"), group, ["rn"], how="inner")

        def passed(w: WindowSpec) -> dict[str, Column]:
            back = F.reverse(F.collect_list("w").over(w.rowsBetween(-memory, 0)))

            def through(weights: str) -> Column:
                return F.aggregate(F.zip_with(back, weights, lambda v, c: F.coalesce(v * c, F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)

            return {"_x": through("_inverse"), "_u": through("_double"), "shock": through("_own")}

        return framed(with_state, own, memory, 0, passed).drop("_inverse", "_double", "_own")

    def lagged(rows: DataFrame, value: str, shock: str) -> DataFrame:
        return framed(rows, own, reach, 0, lambda w: {
            **{c: F.coalesce(F.lag(value, i).over(w), F.lit(0.0)) for c, i in values.items()},
            **{c: F.coalesce(F.lag(shock, i).over(w), F.lit(0.0)) for c, i in shocks.items()}})

    at = as_table(first.filter("status = 'ok'").select(*keys, *ORDER, "params", "n_obs").mapInPandas(begin, held), "models")
    for _ in range(steps + 1):
        rows = lagged(filtered(at), "_x", "_u")
        grams = gramian(rows.filter("rn > _m"), group, [*names, "shock"]).select(*group, "gram")
        at = as_table(join_keys(at, grams, group).mapInPandas(move, held), "models")

    result = T.StructType([*fields, *_score_schema(first.select(*keys, *ORDER)).fields[len(fields):]])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                order, n = {c: int(row[c]) for c in ORDER}, int(row["_n"])
                rec = {"terms": _terms(order, season, multiplied), "status": "singular", "n_obs": n}
                try:
                    rec |= _result(np.asarray(row["_best"], float), row["_least"], n, order, season, names, multiplied)
                except ValueError:
                    pass
                rows.append(rec)
            out = pd.DataFrame(rows, columns=result.names[len(fields):])
            yield pd.concat([pdf[[*keys, *ORDER]].reset_index(drop=True), out], axis=1)[result.names]

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield state(pdf, [(b, b, least, int(n)) for b, least, n in zip(pdf["_best"], pdf["_least"], pdf["_n"])])

    model = at.mapInPandas(finish, result).unionByName(first.filter("status <> 'ok'"))
    best = filtered(at.mapInPandas(again, held)).drop("_x", "_u")
    return as_table(lagged(best, "w", "shock").select(*design.columns), "design"), as_table(model, "models")


def model_residuals(design: DataFrame, s: Series, model: DataFrame, season: int,
                    bounds: Bounds = Bounds()) -> DataFrame:
    """One-step residuals ``(keys, rn, n, resid)`` of the fitted models."""
    rows, expected = _expected(design.filter("rn > _m"), s.keys, model, season, bounds)
    return rows.select(*s.keys, (F.col("rn") - F.col("_m")).alias("rn"),
                       (F.col("n") - F.col("_m")).alias("n"), (F.col("w") - expected).alias("resid"))


def forecast(df: DataFrame, design: DataFrame, s: Series, col: str, model: DataFrame,
             steps: DataFrame | int, season: int, bounds: Bounds = Bounds(), block: int = STEP_BLOCK) -> DataFrame:
    """Rows ``(keys, step, predicted, lower, upper)`` with a 95 % interval.

    ``steps`` is a number, or a frame ``(keys, steps)``. Only the last rows of each
    series enter. A horizon is cut into blocks of ``block`` steps, which tasks share: the state before a block is
    the first one times a power of the model's matrix, taken by repeated squaring. The interval of a step rests on
    all squared responses before it, which are summed inside a block and over the totals of the blocks before.
    """
    reach = _long_order(season, bounds) + bounds.d + season * bounds.sd
    keys = list(s.keys)

    def tail(rows: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
        # the filter bounds the list: at most ``reach`` rows per series
        return rows.filter(F.col("rn") > F.col("n") - reach).groupBy(*by).agg(F.transform(
            F.sort_array(F.collect_list(F.struct("rn", value))), lambda x: x[value]).alias(out))

    on = [*keys, "d", "sd"]
    ok = model.filter("status = 'ok'").select(*on, "sigma2", "terms", "coefs")
    state = join_keys(ok, tail(df, col, keys, "_y"), keys)
    state = join_keys(join_keys(state, tail(design, "w", on, "_w"), on), tail(design, "shock", on, "_e"), on)
    state = state.withColumn("_h", F.lit(steps).cast("long")) if isinstance(steps, int) else join_keys(
        state, steps.select(*keys, F.col("steps").cast("long").alias("_h")), keys)
    one = isinstance(steps, int) and steps <= block
    cut = F.explode(F.expr(f"sequence(0L, greatest(0L, (_h - 1) div {block}))")).alias("_block")
    state = state.filter("_h > 0").select("*", cut)
    if not one:
        state = state.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_block")
    schema = T.StructType([state.schema[k] for k in keys] + [
        T.StructField("_block", T.LongType()), T.StructField("sigma2", T.DoubleType()),
        T.StructField("_predicted", T.ArrayType(T.DoubleType())), T.StructField("_squares", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*keys, "_block", "sigma2"]].copy()
            made = [_steps(row, season, block) for row in pdf.to_dict("records")]
            out["_predicted"] = [m[0] for m in made]
            out["_squares"] = [m[1] for m in made]
            yield out

    parts = state.mapInPandas(run, schema)
    if one:
        parts = parts.withColumn("_before", F.lit(0.0))
    else:
        # one total a block; its window holds horizon / block rows
        by_key = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        totals = parts.select(*keys, "_block", F.element_at("_squares", -1).alias("_total"))
        totals = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(by_key), F.lit(0.0)).alias("_before"))
        parts = join_keys(parts, totals, [*keys, "_block"])
    rows = parts.select(*keys, "_block", "sigma2", "_before", F.posexplode(F.arrays_zip("_predicted", "_squares")).alias("_i", "_f"))
    width = F.lit(Z95) * F.sqrt(F.col("sigma2") * (F.col("_before") + F.col("_f._squares")))
    return rows.select(*keys, (F.col("_block") * block + F.col("_i") + 1).cast("int").alias("step"), F.col("_f._predicted").alias("predicted"),
                       (F.col("_f._predicted") - width).alias("lower"), (F.col("_f._predicted") + width).alias("upper"))


def _steps(row: dict, season: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of one block of steps, and the running sums of the squared responses to a shock inside it.

    The state holds the last differenced values, shocks and values; one step is a product with one matrix.
    """
    beta = dict(zip(row["terms"], row["coefs"], strict=True)) if len(row["terms"]) else {}
    ar = {int(t[2:]): b for t, b in beta.items() if t.startswith("_v")}
    ma = {int(t[2:]): b for t, b in beta.items() if t.startswith("_e")}
    undo = -np.array(difference_weights(int(row["d"]), int(row["sd"]), season)[1:], float)
    nw, ne, ny = max([*ar, 1]), max([*ma, 1]), max(len(undo), 1)
    a = np.zeros((nw + ne + ny,) * 2)
    for lag, b in ar.items():
        a[0, lag - 1] += b
    for lag, b in ma.items():
        a[0, nw + lag - 1] += b
    a[nw + ne] = a[0]
    a[nw + ne, nw + ne:nw + ne + len(undo)] += undo
    for first, size in ((0, nw), (nw, ne), (nw + ne, ny)):
        for i in range(1, size):
            a[first + i, first + i - 1] = 1.0

    def last(values: Sequence[float], size: int) -> list[float]:
        back = [float(v) for v in values][::-1][:size]
        return back + [0.0] * (size - len(back))

    start = np.array([*last(row["_w"], nw), *last(row["_e"], ne), *last(row["_y"], ny)])
    shock = np.zeros(len(a))
    shock[[0, nw, nw + ne]] = 1.0
    before, at = int(row["_block"]) * block, np.stack([start, shock], axis=1)
    power, left = a, before
    while left:
        if left & 1:
            at = power @ at
        power, left = power @ power, left >> 1
    size = int(min(block, row["_h"] - before))
    # states of the steps, doubled: the next as many follow by one product
    at = np.stack([a @ at[:, 0], at[:, 1]], axis=1)
    states, power = at[:, None, :], a
    while states.shape[1] < size:
        states = np.concatenate([states, np.tensordot(power, states, (1, 0))], axis=1)
        power = power @ power
    found = states[nw + ne, :size]
    return found[:, 0], np.cumsum(found[:, 1] ** 2)


# ---- walk-forward validation -------------------------------------------------------------------

def walk_forward(df: DataFrame, s: Series, col: str, season: int, p: float = 0.5, k: int = 3,
                 bounds: Bounds = Bounds(), orders: DataFrame | None = None, criterion: str = "aic"
                 ) -> tuple[DataFrame, DataFrame]:
    """Forecasts ``(keys, fold, rn, actual, predicted, lower, upper)`` and metrics per fold.

    Orders are searched once on the first training part unless given. Each fold is
    fitted on all rows before it and forecasts its whole slice. A fold that cannot be
    fitted keeps a row of scores without metrics, and its status.
    """
    df = as_table(df.select(*s.keys, *[c for c in s.order if c not in (*s.keys, "rn")], "rn", "n", col), "series")
    folds = expanding_folds(df, p, k)
    train = folds.filter("role = 'train'").withColumn(
        "n", F.floor(F.col("n") * F.lit(p)) + F.floor(
            (F.col("n") - F.floor(F.col("n") * F.lit(p))) / k) * (F.col("fold") - 1))
    if orders is None:
        first = train.filter("fold = 1").drop("fold", "role")
        orders = best_orders(order_search(first, s, col, season, bounds, criterion), s.keys)
    by_fold = s.keyed_by("fold")
    test = folds.filter("role = 'test'")
    sizes = test.groupBy(*by_fold.keys).agg(F.count(F.lit(1)).alias("steps"), (F.min("rn") - 1).alias("n_train"))
    fold_orders = join_keys(orders, sizes, s.keys)
    # written once: fit, state and residual lags all read it
    design = as_table(design_rows(train, by_fold, col, season, bounds), "design")
    model = fit_seasonal(design, by_fold, fold_orders, season, bounds)
    ahead = forecast(train, design, by_fold, col, model, sizes, season, bounds)
    placed = join_keys(ahead, sizes, by_fold.keys).select(
        *by_fold.keys, (F.col("n_train") + F.col("step")).alias("rn"), "predicted", "lower", "upper")
    forecasts = join_keys(test.select(*by_fold.keys, "rn", F.col(col).alias("actual")),
                          placed, [*by_fold.keys, "rn"])
    scores = regression_metrics(forecasts, by_fold.keys).withColumnRenamed("n", "n_test")
    # every fold with a test row, whether it could be fitted or not
    every = join_keys(sizes.select(*by_fold.keys, "n_train"), model.select(*by_fold.keys, "aic", "status"), by_fold.keys, "left")
    scores = join_keys(every.withColumn("status", F.coalesce("status", F.lit("no_order"))), scores, by_fold.keys, "left")
    return forecasts, scores


def walk_forward_summary(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population std over the folds of mse, mae, rmse, r2 and aic."""
    return fold_summary(scores, ["mse", "mae", "rmse", "r2", "aic"], keys)
