"""Tests, models and attribution against brute force on small data."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.operators import attribution, reduction, regress, residuals, search, seasonal, shapley, stationarity
from tidemark.operators.gram import gramian
from tidemark.operators.ordered import Series, positions
from tidemark.operators.seasonal import Bounds

S = Series(("k",), ("t",))


def frame(spark, **named):
    rows = [(k, i, float(v)) for k, vs in named.items() for i, v in enumerate(vs)]
    return positions(spark.createDataFrame(rows, "k string, t int, y double"), S)


def ar(n, phi, seed, d=0):
    e = np.random.default_rng(seed).normal(size=n)
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = phi * y[i - 1] + e[i]
    for _ in range(d):
        y = y.cumsum()
    return y


def ols(x, y):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = float(((y - x @ beta) ** 2).sum())
    return beta, rss


def adf_by_hand(y):
    n = len(y)
    bound = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    dy = np.diff(y)

    def design(lag, first):
        rows, target = [], []
        for t in range(first, n):
            rows.append([1.0, y[t - 1], *[dy[t - 1 - i] for i in range(1, lag + 1)]])
            target.append(dy[t - 1])
        return np.array(rows), np.array(target)

    def aic(lag):
        x, z = design(lag, bound + 1)
        _, rss = ols(x, z)
        return len(z) * (math.log(2 * math.pi) + math.log(rss / len(z)) + 1) + 2 * x.shape[1]

    lag = min(range(bound + 1), key=aic)
    x, z = design(lag, lag + 1)
    beta, rss = ols(x, z)
    cov = rss / (len(z) - x.shape[1]) * np.linalg.inv(x.T @ x)
    return beta[1] / math.sqrt(cov[1, 1]), lag, len(z)


def test_adf_matches_brute_force(spark):
    named = {"ar": ar(220, 0.5, 1), "walk": ar(150, 1.0, 6), "short": ar(24, 0.3, 3), "big": 1e6 + 1e4 * ar(300, 0.8, 4)}
    got = {x.k: x for x in stationarity.adf_test(frame(spark, **named), S, "y").collect()}
    for key, y in named.items():
        tau, lag, used = adf_by_hand(y)
        assert got[key].statistic == pytest.approx(tau, rel=1e-6)
        assert (got[key].used_lag, got[key].n_obs) == (lag, used)
    assert got["ar"].stationary and not got["walk"].stationary


def test_adf_by_width_class(spark, monkeypatch):
    rng = np.random.default_rng(21)
    named = {f"n{n}": np.cumsum(rng.normal(size=n)) * 0.3 + rng.normal(size=n) for n in (2, 3, 5, 9, 24, 60, 61, 900)}
    widths = []
    made = stationarity._lag_gramian
    monkeypatch.setattr(stationarity, "_lag_gramian", lambda z, s, keys, w: widths.append(w) or made(z, s, keys, w))
    got = {x.k: x for x in stationarity.adf_test(frame(spark, **named), S, "y").collect()}
    # bounds 9 // 2 - 2 = 2, 9 for 24 rows, 11 for 60 and 61, 21 for 900; the shortest have none
    assert widths == [0, 2, 11, 21]
    for k, y in named.items():
        (alone,) = stationarity.adf_test(frame(spark, **{k: y}), S, "y").collect()
        if alone.status == "ok":
            assert (got[k].used_lag, got[k].n_obs, got[k].stationary) == (alone.used_lag, alone.n_obs, alone.stationary)
            assert got[k].statistic == pytest.approx(alone.statistic, abs=1e-9)
            if len(y) > 20:
                assert got[k].statistic == pytest.approx(adf_by_hand(y)[0], abs=1e-6)
        else:
            assert got[k].status == alone.status
    assert {k for k in got if got[k].status == "ok"} >= {"n24", "n60", "n61", "n900"}
    assert stationarity.adf_test(frame(spark, n9=named["n9"]).limit(0), S, "y").count() == 0


def test_adf_of_unusable_series(spark):
    got = {x.k: x for x in stationarity.adf_test(frame(spark, flat=[2.0] * 30, tiny=[1.0, 2.0]), S, "y").collect()}
    assert got["flat"].status == "singular" and got["tiny"].status == "too_short"
    assert got["flat"].statistic is None


def test_p_value():
    assert stationarity.p_value(-2.86) == pytest.approx(0.05, abs=2e-3)
    assert stationarity.p_value(3.0) == 1.0 and stationarity.p_value(-20.0) == 0.0


def test_make_stationary(spark):
    named = {"level": ar(300, 0.3, 5), "walk": ar(300, 1.0, 6), "twice": ar(300, 1.0, 7, d=1)}
    df = frame(spark, **named)
    got = {x.k: x for x in stationarity.make_stationary(df, S, "y", 7).collect()}

    def by_hand(y):
        def p(v):
            return stationarity.p_value(adf_by_hand(v)[0])
        seasonal_diff, base = False, p(y)
        if base >= 0.05 and p(y[7:] - y[:-7]) < base:
            y, seasonal_diff = y[7:] - y[:-7], True
        n = 0
        while n < 3 and p(y) >= 0.05:
            y, n = np.diff(y), n + 1
        return seasonal_diff, n, y

    decision = stationarity.make_stationary(df, S, "y", 7)
    rows = stationarity.apply_differencing(df, S, "y", decision, 7)
    for key, y in named.items():
        want_seasonal, want_n, want_y = by_hand(y)
        assert (got[key].seasonal_diff, got[key].n_diff) == (want_seasonal, want_n)
        w = [x.w for x in rows.filter(F.col("k") == key).orderBy("rn").collect()]
        assert w == pytest.approx(want_y.tolist(), abs=1e-9)


def test_chi2_tail():
    # 95 % points of the chi-squared distribution
    for dof, point in ((1, 3.8415), (2, 5.9915), (3, 7.8147), (5, 11.0705), (10, 18.3070)):
        assert residuals.chi2_tail(point, dof) == pytest.approx(0.05, abs=1e-5)


def test_ljung_box_uses_few_lags_for_short_series(spark):
    y = ar(17, 0.4, 8)
    got = residuals.ljung_box(frame(spark, a=y), S, "y").first()
    c = y - y.mean()
    rho = [float((c[h:] * c[:-h]).sum() / (c * c).sum()) for h in (1, 2, 3)]
    q = 17 * 19 * sum(v * v / (17 - h) for h, v in zip((1, 2, 3), rho))
    assert got.h == 3 and got.lb_stat == pytest.approx(q)
    assert got.lb_pvalue == pytest.approx(residuals.chi2_tail(q, 3))


def test_gramian_wide_equals_narrow(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 15))
    names = [f"c{i}" for i in range(15)]
    df = spark.createDataFrame([("ab"[i % 2], *map(float, row)) for i, row in enumerate(x)], ["k", *names])
    wide = {r.k: r for r in gramian(df, ["k"], names).collect()}
    for j, key in enumerate("ab"):
        own = x[j::2]
        assert wide[key].n_obs == 25
        assert np.reshape(wide[key].gram, (15, 15)) == pytest.approx(own.T @ own)
    narrow = {r.k: r for r in gramian(df, ["k"], names[:5]).collect()}
    assert np.reshape(narrow["a"].gram, (5, 5)) == pytest.approx(x[::2, :5].T @ x[::2, :5])


def hannan_rissanen(y, order, season, bounds):
    """The documented two regressions, written out for one series."""
    p, d, q, sp, sd, sq = order
    w = np.array(y, float)
    for _ in range(d):
        w = np.diff(w)
    for _ in range(sd):
        w = w[season:] - w[:-season]
    n = len(w)
    m_max = max(bounds.p, bounds.q, season * max(bounds.sp, bounds.sq, 1)) + 2
    m = min(m_max, n // 3)
    x = np.array([[w[t - i] for i in range(1, m + 1)] for t in range(m, n)])
    beta, _ = ols(x, w[m:])
    e = np.zeros(n)
    e[m:] = w[m:] - x @ beta
    lags = [("w", i) for i in range(1, p + 1)] + [("w", i * season) for i in range(1, sp + 1)]
    lags += [("e", i) for i in range(1, q + 1)] + [("e", i * season) for i in range(1, sq + 1)]
    back = {"w": w, "e": e}
    x = np.array([[back[s][t - i] if t >= i else 0.0 for s, i in lags] for t in range(m, n)])
    if lags:
        beta, rss = ols(x, w[m:])
    else:
        beta, rss = np.empty(0), float((w[m:] ** 2).sum())
    k, used = len(lags) + 1, n - m
    llf = -used / 2 * (math.log(2 * math.pi * rss / used) + 1)
    return beta, 2 * k - 2 * llf, k * math.log(used) - 2 * llf


def test_order_search_matches_brute_force(spark):
    named = {"long": ar(160, 0.6, 9), "short": ar(40, 0.4, 10)}
    added = Bounds(multiplied=False)
    scored = seasonal.order_search(frame(spark, **named), S, "y", 7, added, fallback=False)
    rows = scored.collect()
    assert sum(x.k == "long" for x in rows) == 144
    for x in rows:
        order = tuple(x[c] for c in seasonal.ORDER)
        beta, aic, bic = hannan_rissanen(named[x.k], order, 7, Bounds())
        assert x.status == "ok"
        assert x.coefs == pytest.approx(beta.tolist(), rel=1e-5, abs=1e-7)
        assert (x.aic, x.bic) == pytest.approx((aic, bic), rel=1e-7)
    best = {x.k: x for x in seasonal.best_orders(scored, ["k"]).collect()}
    for key in named:
        assert best[key].score == min(x.score for x in rows if x.k == key)
    by_bic = seasonal.order_search(frame(spark, **named), S, "y", 7, added, criterion="bic", fallback=False)
    assert all(x.score == x.bic for x in by_bic.collect())


def test_order_search_in_blocks(spark):
    df = frame(spark, a=ar(150, 0.6, 11))
    blocks = Series(("k",), ("t",), 32)
    a, b = (seasonal.best_orders(seasonal.order_search(df, s, "y", 7), ["k"]).first() for s in (S, blocks))
    assert a.score == pytest.approx(b.score) and a.candidate == b.candidate


@pytest.mark.parametrize("bounds", [Bounds(), Bounds(1, 1, 0, 0, 0, 0)])
def test_order_search_shuffles_values_once(spark, bounds):
    # lagged rows were shuffled four times over, a row for each differencing; now matrices are made where the blocks lie
    df = frame(spark, a=ar(150, 0.6, 11), b=ar(40, 0.5, 3))
    scored = seasonal.order_search(df, Series(("k",), ("t",), 64), "y", 7, bounds)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "_a1" not in plan


def test_order_search_leaves_short_series_where_they_are_numbered(spark):
    # the values were shuffled again by key and block, and once more by length to the lists of candidates
    df = frame(spark, a=ar(50, 0.6, 11), b=ar(40, 0.5, 3)).drop("rn", "n")
    s = Series(("k",), ("t",), 64, "t")
    at = positions(df, s)
    assert seasonal._stretches(at, s, "y", 5)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = seasonal.order_search(at, s, "y", 7, Bounds(1, 1, 0, 0, 0, 0))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    whole = seasonal.order_search(positions(df, S), S, "y", 7, Bounds(1, 1, 0, 0, 0, 0))
    columns = ["k", "stage", "candidate", "status", "score"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


def test_order_search_equals_fits_of_design_rows(spark):
    # equal lengths, very short ones, a missing value, a constant; whole and in blocks
    gaps = [None if t in (5, 60) else v for t, v in enumerate(ar(120, 0.4, 21))]
    named = {"a": ar(40, 0.6, 9), "b": ar(40, 0.4, 10), "c": [1.0], "d": [2.0, 3.0], "e": [5.0] * 30, "f": gaps, "g": [None] * 25}
    rows = [(k, t, v, t + 1, len(y)) for k, y in named.items() for t, v in enumerate([None if v is None else float(v) for v in y])]
    df = spark.createDataFrame(rows, "k string, t bigint, y double, rn bigint, n bigint")
    for s, bounds in ((S, Bounds()), (Series(("k",), ("t",), 32), Bounds()), (Series(("k",), ("t",), 32), Bounds(1, 1, 1, 0, 1, 0))):
        lengths = df.groupBy("k").agg(F.max("n").alias("n"))
        wanted = seasonal.prune_candidates(seasonal.order_candidates(lengths, 7, bounds)).withColumn("stage", F.lit(0)).unionByName(
            seasonal._fallback_candidates(lengths).withColumn("stage", F.lit(1)))
        want = {(x.k, x.stage, x.candidate): x for x in seasonal.fit_orders(
            seasonal.design_rows(df, s, "y", 7, bounds), s.keys, wanted, 7, bounds).collect()}
        got = {(x.k, x.stage, x.candidate): x for x in seasonal.order_search(df, s, "y", 7, bounds).filter("stage < 2").collect()}
        assert set(got) == set(want)
        for at, x in want.items():
            assert (got[at].status, got[at].n_obs, got[at].terms) == (x.status, x.n_obs, x.terms), at
            for c in ("aic", "bic", "llf", "sigma2", "coefs", "params"):
                assert (got[at][c] is None) == (x[c] is None), (at, c)
                if x[c] is not None:
                    assert got[at][c] == pytest.approx(x[c], rel=1e-6, abs=1e-8), (at, c)


def test_recovers_simulated_models(spark):
    rng = np.random.default_rng(12)
    e = rng.normal(size=3000)
    ma = e.copy()
    ma[1:] += 0.5 * e[:-1]
    seasonal_ar = np.zeros(3000)
    for t in range(3000):
        seasonal_ar[t] = (0.6 * seasonal_ar[t - 7] if t >= 7 else 0) + e[t]
    df = frame(spark, ar=ar(3000, 0.7, 13), ma=ma, season=seasonal_ar)
    scored = seasonal.order_search(df, S, "y", 7, fallback=False)

    def coefs(key, **order):
        row = scored.filter(F.col("k") == key)
        for c in seasonal.ORDER:
            row = row.filter(F.col(c) == order.get(c, 0))
        return row.first().coefs

    assert coefs("ar", p=1)[0] == pytest.approx(0.7, abs=0.04)
    assert coefs("ma", q=1)[0] == pytest.approx(0.5, abs=0.05)
    assert coefs("season", sp=1)[0] == pytest.approx(0.6, abs=0.04)


def test_fallback_for_hopeless_series(spark):
    df = frame(spark, tiny=[3.0, 4.0], zero=[0.0] * 12, fine=ar(80, 0.5, 14))
    best = {x.k: x for x in seasonal.best_orders(seasonal.order_search(df, S, "y", 7), ["k"]).collect()}
    assert best["zero"].stage == 2 and best["zero"].score == seasonal.FALLBACK_SCORE
    assert (best["zero"].p, best["zero"].d, best["zero"].q) == (0, 1, 0)
    # two rows allow no order but the empty one
    assert best["tiny"].stage == 0 and best["tiny"].candidate == 0 and best["fine"].stage == 0


def test_forecast_undoes_differences(spark):
    # without noise the seasonal random walk with drift pattern repeats exactly
    y = [10.0 + 0.5 * t + [0, 3, 1, 4, -2, -5, 2][t % 7] for t in range(70)]
    df = frame(spark, a=y)
    bounds = Bounds()
    design = seasonal.design_rows(df, S, "y", 7, bounds)
    orders = spark.createDataFrame([("a", 0, 1, 0, 0, 1, 0)], ["k", *seasonal.ORDER])
    model = seasonal.fit_seasonal(design, S, orders, 7)
    # the differenced series is all zero: fit has no spread, so put one in for the recursion
    model = model.withColumns({"status": F.lit("ok"), "sigma2": F.lit(1.0), "coefs": F.array().cast("array<double>")})
    got = seasonal.forecast(df, design, S, "y", model, 10, 7).orderBy("step").collect()
    want = [10.0 + 0.5 * t + [0, 3, 1, 4, -2, -5, 2][t % 7] for t in range(70, 80)]
    assert [x.predicted for x in got] == pytest.approx(want)
    # shocks of (1 - B)(1 - B^7) accumulate: one per step, doubled after a season
    psi = np.cumsum(np.square([1.0] * 7 + [2.0] * 3))
    assert [x.upper - x.predicted for x in got] == pytest.approx((seasonal.Z95 * np.sqrt(psi)).tolist())


def test_forecast_matches_recursion_by_hand(spark):
    y = ar(120, 0.6, 15)
    order = (2, 0, 1, 1, 0, 1)
    beta, _, _ = hannan_rissanen(y, order, 7, Bounds())
    m = 9
    x = np.array([[y[t - i] for i in range(1, m + 1)] for t in range(m, len(y))])
    long, _ = ols(x, y[m:])
    e = np.r_[np.zeros(m), y[m:] - x @ long].tolist()
    w = y.tolist()
    for _ in range(12):
        w.append(beta @ np.array([w[-1], w[-2], w[-7], e[-1], e[-7]]))
        e.append(0.0)
    df = frame(spark, a=y)
    added = Bounds(multiplied=False)
    design = seasonal.design_rows(df, S, "y", 7, added)
    orders = spark.createDataFrame([("a", *order)], ["k", *seasonal.ORDER])
    model = seasonal.fit_seasonal(design, S, orders, 7, added)
    got = seasonal.forecast(df, design, S, "y", model, 12, 7, added).orderBy("step").collect()
    assert [v.predicted for v in got] == pytest.approx(w[120:], rel=1e-5)
    assert all(v.lower < v.predicted < v.upper for v in got)
    resid = seasonal.model_residuals(design, S, model, 7, added)
    assert resid.count() == 111


def multiplied_fit(y, order, season, shocks):
    """Least squares of a multiplied model by a general minimiser, for given shocks; parameters p, sp, q, sq."""
    p, sp, q, sq = order
    m = 9

    def coefficients(theta):
        parts = np.split(theta, np.cumsum([p, sp, q]))
        out = []
        for plain, seas, sign in ((parts[0], parts[1], -1), (parts[2], parts[3], 1)):
            lead, tail = np.zeros(p + q + 1), np.zeros(season + 1)
            lead[0] = tail[0] = 1
            lead[1:len(plain) + 1] = sign * plain
            if len(seas):
                tail[season] = sign * seas[0]
            out.append(sign * np.convolve(lead, tail)[1:])
        return out

    def residual(theta):
        a, b = coefficients(theta)
        return np.array([y[t] - sum(c * y[t - i - 1] for i, c in enumerate(a) if c) - sum(c * shocks[t - i - 1] for i, c in enumerate(b) if c and t > i)
                         for t in range(m, len(y))])

    theta = np.zeros(p + sp + q + sq)
    for _ in range(40):  # numeric derivatives, independent of the operator's
        r = residual(theta)
        jac = np.array([(residual(theta + 1e-6 * e) - residual(theta - 1e-6 * e)) / 2e-6 for e in np.eye(len(theta))]).T
        theta = theta - np.linalg.lstsq(jac, r, rcond=None)[0]
    return theta, coefficients(theta), float((residual(theta) ** 2).sum())


@pytest.mark.parametrize("order", [(1, 0, 0, 1, 0, 0), (2, 0, 1, 1, 0, 1), (0, 0, 1, 0, 0, 1)])
def test_multiplied_models_are_least_squares(spark, order):
    y = ar(150, 0.6, 23)
    scored = seasonal.order_search(frame(spark, a=y), S, "y", 7, fallback=False)
    for c, n in zip(seasonal.ORDER, order):
        scored = scored.filter(F.col(c) == n)
    got = scored.first()
    x = np.array([[y[t - i] for i in range(1, 10)] for t in range(9, 150)])
    shocks = np.r_[np.zeros(9), y[9:] - x @ ols(x, y[9:])[0]]
    p, _, q, sp, _, sq = order
    _, (a, b), rss = multiplied_fit(y, (p, sp, q, sq), 7, shocks)
    want = {f"_v{i + 1}": c for i, c in enumerate(a) if c} | {f"_e{i + 1}": c for i, c in enumerate(b) if c}
    assert got.status == "ok" and dict(zip(got.terms, got.coefs)) == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert got.sigma2 == pytest.approx(rss / 141, rel=1e-8)


def simulated(n, seed, a=None, b=None):
    """Values of a model with the given coefficients of values and shocks by lag."""
    e = np.random.default_rng(seed).normal(size=n)
    y = np.zeros(n)
    for t in range(n):
        y[t] = e[t] + sum(c * y[t - i] for i, c in (a or {}).items() if t >= i) + sum(c * e[t - i] for i, c in (b or {}).items() if t >= i)
    return y


def test_multiplied_models_recover_their_parameters(spark):
    df = frame(spark, value=simulated(3000, 24, a={1: 0.5, 7: 0.4, 8: -0.2}), shock=simulated(3000, 25, b={1: 0.6, 7: 0.5, 8: 0.3}))
    orders = spark.createDataFrame([("value", 1, 0, 0, 1, 0, 0), ("shock", 0, 0, 1, 0, 0, 1)], ["k", *seasonal.ORDER])
    first = seasonal.design_rows(df, S, "y", 7, Bounds())
    design, model = seasonal.refined(first, S, orders, 7)
    got = {r.k: dict(zip(r.terms, r.coefs)) for r in model.collect()}
    assert got["value"] == pytest.approx({"_v1": 0.5, "_v7": 0.4, "_v8": -0.2}, abs=0.04)
    assert got["value"]["_v8"] == pytest.approx(-got["value"]["_v1"] * got["value"]["_v7"])
    assert got["shock"]["_e8"] == pytest.approx(got["shock"]["_e1"] * got["shock"]["_e7"])
    assert got["shock"] == pytest.approx({"_e1": 0.6, "_e7": 0.5, "_e8": 0.3}, abs=0.05)
    # the rounds come nearer to the true shocks than the long autoregression does
    before = {r.k: dict(zip(r.terms, r.coefs)) for r in seasonal.fit_seasonal(first, S, orders, 7).collect()}["shock"]
    assert abs(got["shock"]["_e7"] - 0.5) < abs(before["_e7"] - 0.5)
    # the shocks of the design are those of the model
    resid = seasonal.model_residuals(design, S, model, 7).groupBy("k").agg(F.avg(F.col("resid") ** 2).alias("s2"))
    assert {r.k: r.s2 for r in resid.collect()} == pytest.approx({r.k: r.sigma2 for r in model.collect()}, rel=1e-3)
    ahead = seasonal.forecast(df, design, S, "y", model, 9, 7)
    assert ahead.count() == 18


@pytest.mark.parametrize("order", [(2, 0, 1, 1, 0, 1), (1, 1, 1, 1, 1, 0), (0, 1, 0, 0, 1, 1), (0, 0, 0, 0, 0, 0)])
def test_horizon_in_blocks_equals_the_recursion(spark, order):
    y = np.cumsum(ar(140, 0.5, 26)) if order[1] else ar(140, 0.5, 26)
    df = frame(spark, a=y, b=y[:90])
    design = seasonal.design_rows(df, S, "y", 7, Bounds())
    orders = spark.createDataFrame([("a", *order), ("b", *order)], ["k", *seasonal.ORDER])
    model = seasonal.fit_seasonal(design, S, orders, 7)
    state = {(r.k, r.rn): (r.w, r.shock) for r in design.filter(f"d = {order[1]} and sd = {order[4]}").collect()}
    steps = spark.createDataFrame([("a", 50), ("b", 33)], "k string, steps long")
    got = seasonal.forecast(df, design, S, "y", model, steps, 7, block=8).orderBy("k", "step").collect()
    assert [(r.k, r.step) for r in got] == [("a", i + 1) for i in range(50)] + [("b", i + 1) for i in range(33)]
    for fitted in model.collect():
        beta = dict(zip(fitted.terms, fitted.coefs))
        undo = -np.array(stationarity.difference_weights(order[1], order[4], 7)[1:])
        own = [state[k] for k in sorted(state) if k[0] == fitted.k]
        w, e, values = [v for v, _ in own], [s for _, s in own], list(y if fitted.k == "a" else y[:90])
        n, psi_w, psi = len(values), [], []
        for t in range(50 if fitted.k == "a" else 33):
            w.append(sum(c * (w if n_[1] == "v" else e)[-int(n_[2:])] for n_, c in beta.items()))
            e.append(0.0)
            values.append(w[-1] + sum(c * values[-i] for i, c in enumerate(undo, start=1) if c))
            psi_w.append((1.0 if t == 0 else 0.0) + sum(c * (psi_w[t - int(n_[2:])] if n_[1] == "v" else float(t == int(n_[2:])))
                                                        for n_, c in beta.items() if t >= int(n_[2:])))
            psi.append(psi_w[t] + sum(c * psi[t - i] for i, c in enumerate(undo, start=1) if c and i <= t))
        mine = [r for r in got if r.k == fitted.k]
        assert [r.predicted for r in mine] == pytest.approx(values[n:], rel=1e-8, abs=1e-8)
        width = seasonal.Z95 * np.sqrt(fitted.sigma2 * np.cumsum(np.square(psi)))
        assert [r.upper - r.predicted for r in mine] == pytest.approx(width.tolist(), rel=1e-8)


def test_long_horizon_is_split_over_tasks(spark):
    df = frame(spark, a=ar(60, 0.9, 27) + 3)
    design = seasonal.design_rows(df, S, "y", 7, Bounds())
    orders = spark.createDataFrame([("a", 1, 1, 0, 0, 0, 0)], ["k", *seasonal.ORDER])
    model = seasonal.fit_seasonal(design, S, orders, 7)
    ahead = seasonal.forecast(df, design, S, "y", model, 1_000_000, 7)
    parts = ahead.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in parts) == 1_000_000 and max(r.n for r in parts) < 400_000
    phi, last = model.first().coefs[0], [r.y for r in df.orderBy("rn").collect()][-2:]
    end = ahead.filter("step = 1000000").first()
    assert end.predicted == pytest.approx(last[1] + (last[1] - last[0]) * phi / (1 - phi), rel=1e-6)


def test_walk_forward_keeps_folds_that_fail(spark):
    df = frame(spark, fine=ar(60, 0.5, 28), flat=[2.0] * 30)
    orders = spark.createDataFrame([("fine", 1, 1, 0, 0, 0, 0), ("flat", 1, 1, 0, 0, 0, 0)], ["k", *seasonal.ORDER])
    _, scores = seasonal.walk_forward(df, S, "y", 7, orders=orders)
    got = sorted((r.k, r.fold, r.status, r.rmse is None) for r in scores.collect())
    assert got == [("fine", f, "ok", False) for f in (1, 2, 3)] + [("flat", f, "singular", True) for f in (1, 2, 3)]


def test_walk_forward_covers_each_fold(spark):
    df = frame(spark, a=ar(200, 0.6, 16), b=5 + ar(101, 0.4, 17))
    forecasts, scores = seasonal.walk_forward(df, S, "y", 7)
    spans = {(x.k, x.fold): (x.lo, x.hi) for x in forecasts.groupBy("k", "fold").agg(
        F.min("rn").alias("lo"), F.max("rn").alias("hi")).collect()}
    assert spans["a", 1] == (101, 133) and spans["a", 3] == (167, 199)
    assert spans["b", 2] == (68, 84)
    assert {(x.k, x.fold): (x.n_train, x.n_test) for x in scores.collect()}["a", 2] == (133, 33)
    summary = seasonal.walk_forward_summary(scores, ["k"]).collect()
    assert len(summary) == 10


def test_walk_forward_ml_context(spark):
    df = frame(spark, a=ar(60, 0.6, 18))
    for context, first in (("fold", 33), ("history", 31)):
        forecasts, _ = regress.walk_forward_ml(df, S, ["y"], "y", 2, LinearRegression(), context=context)
        assert forecasts.filter("fold = 1").agg(F.min("rn")).first()[0] == first
    y = {x.rn: x.y for x in df.collect()}
    assert all(abs(x.actual - y[x.rn]) < 1e-9 for x in forecasts.collect())


@pytest.mark.parametrize("context,fit_on", [("fold", "all"), ("history", "train")])
def test_all_folds_from_slice_matrices_equal_a_fit_per_fold(spark, context, fit_on):
    rng = np.random.default_rng(29)
    rows = [(k, i, float(10 + x), float(1000 + 50 * x + 5 * z)) for k, n in (("a", 120), ("b", 83))
            for i, (x, z) in enumerate(zip(ar(n, 0.7, ord(k)), rng.normal(size=n)))]
    df = positions(spark.createDataFrame(rows, "k string, t int, sold double, y double"), S)
    args = (df, S, ["sold", "y"], "y", 7)
    each, scores = regress.walk_forward_ml(*args, LinearRegression(), context=context, fit_on=fit_on)
    once, all_scores = regress.walk_forward_linear(*args, context=context, fit_on=fit_on)
    want = {(r.k, r.fold, r.rn): (r.actual, r.predicted) for r in each.collect()}
    got = {(r.k, r.fold, r.rn): (r.actual, r.predicted) for r in once.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    assert {(r.k, r.fold, r.status): round(r.rmse, 4) for r in all_scores.collect()} == {(r.k, r.fold, "ok"): round(r.rmse, 4) for r in scores.collect()}


def test_slice_matrices_of_each_series_and_of_short_ones(spark):
    df = frame(spark, a=ar(60, 0.5, 30), b=ar(61, 0.5, 31), short=[1.0, 2.0, 4.0, 3.0])
    _, scores = regress.walk_forward_linear(df, S, ["y"], "y", 2, by_series=True)
    alone, _ = regress.walk_forward_linear(df.filter("k = 'a'"), S, ["y"], "y", 2)
    both, _ = regress.walk_forward_linear(df, S, ["y"], "y", 2, by_series=True)
    assert {(r.fold, r.rn): round(r.predicted, 8) for r in both.filter("k = 'a'").collect()} == {(r.fold, r.rn): round(r.predicted, 8) for r in alone.collect()}
    got = {(r.k, r.fold): (r.status, r.rmse is None) for r in scores.collect()}
    assert all(got[k, f] == ("ok", False) for k in "ab" for f in (1, 2, 3))
    assert all(v[0] != "ok" and v[1] for (k, _), v in got.items() if k == "short")


def test_sequence_regressor_equals_least_squares(spark):
    y = ar(120, 0.6, 19)
    model = regress.SequenceRegressor(LinearRegression(), ("y",), "y", 3)
    windows = model.windows(frame(spark, a=y), S)
    fitted = model.fit(windows).stages[0]
    x = np.array([[*y[t - 3:t], 1.0] for t in range(3, 120)])
    beta, _ = ols(x, y[3:])
    assert [*fitted.coefficients, fitted.intercept] == pytest.approx(beta.tolist(), rel=1e-6)


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(20)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 3
    df = spark.createDataFrame([(i, Vectors.dense(row)) for i, row in enumerate(x)], ["i", "v"])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    vectors = vectors[:, ::-1][:, :3]
    vectors = vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), range(3)])
    fitted = reduction.pca(df, "v", 3)
    got = np.array([[r.PC1, r.PC2, r.PC3] for r in reduction.pca_scores(df, fitted, ["i"]).orderBy("i").collect()])
    assert got == pytest.approx(x @ vectors, rel=1e-6, abs=1e-8)
    ratios = [r.ratio for r in fitted.explained(spark).orderBy("component").collect()]
    assert ratios == pytest.approx((values[::-1] / values.sum())[:3].tolist())
    centred = reduction.pca(df, "v", 2, center=True)
    got = np.array([r.PC1 for r in reduction.pca_scores(df, centred, ["i"], 2).orderBy("i").collect()])
    assert got == pytest.approx((x - x.mean(axis=0)) @ vectors[:, 0], rel=1e-6, abs=1e-8)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(60, 3))
    y = x[:, 0] * x[:, 1] + 2 * x[:, 2]
    rows = [(i, "g", float(v), Vectors.dense(row)) for i, (row, v) in enumerate(zip(x, y))]
    return x, spark.createDataFrame(rows, ["i", "g", "label", "features"]).cache()


def shapley_by_hand(predict, x, background):
    width = len(x)
    out = np.zeros(width)
    for j in range(width):
        others = [i for i in range(width) if i != j]
        for size in range(width):
            weight = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
            for subset in itertools.combinations(others, size):
                for with_j, sign in ((True, 1), (False, -1)):
                    mixed = background.copy()
                    cols = [*subset, j] if with_j else list(subset)
                    mixed[:, cols] = x[cols]
                    out[j] += sign * weight * predict(mixed).mean()
    return out


def drawn_rows(ids, size, draws, seed):
    """Numbers of the background rows drawn for a row, by the documented rule."""
    return [int(hashlib.md5("-".join(map(str, [seed, *ids, k])).encode()).hexdigest()[:15], 16) % size for k in range(draws)]


def forest_predict(model):
    return lambda m: np.array([model.predict(Vectors.dense(row)) for row in m])


@pytest.mark.parametrize("block_rows", [None, 16])
def test_exact_shapley_matches_brute_force(spark, scored, block_rows):
    x, df = scored
    model = RandomForestRegressor(numTrees=5, maxDepth=3, seed=1).fit(df)
    background = shapley.background_table(df, ["g"], ["i"], block_rows)
    rows = df.filter("i in (20, 33)")
    phi = shapley.shapley_exact(rows, background, ["i"], ["g"], ["a", "b", "c"], shapley.regression_score(model), draws=7)
    got = {(r.i, r.feature): r for r in phi.collect()}
    predict = forest_predict(model)
    for i in (20, 33):
        drawn = x[drawn_rows([i], 60, 7, 0)]
        want = shapley_by_hand(predict, x[i], drawn)
        assert [got[i, f].phi for f in "abc"] == pytest.approx(want.tolist(), abs=1e-9)
        assert got[i, "a"].base_value == pytest.approx(predict(drawn).mean())
        assert sum(got[i, f].phi for f in "abc") == pytest.approx(got[i, "a"].fx - got[i, "a"].base_value)


def test_background_numbers_all_rows_of_each_group(spark):
    rows = [(i, g, Vectors.dense([float(i)])) for i, g in enumerate([None, "a", "b", "a", None, "a"])]
    df = spark.createDataFrame(rows, ["i", "g", "features"])
    for block_rows in (None, 2):
        got = sorted(((r.g or "", r._no, r._n, r._b[0]) for r in shapley.background_table(df, ["g"], ["i"], block_rows).collect()))
        assert got == [("", 0, 2, 0.0), ("", 1, 2, 4.0), ("a", 0, 3, 1.0), ("a", 1, 3, 3.0), ("a", 2, 3, 5.0), ("b", 0, 1, 2.0)]


def test_sampled_shapley_of_linear_model_is_exact(spark, scored):
    x, df = scored
    model = LinearRegression(regParam=0.0).fit(df)
    background = shapley.background_table(df, ["g"], ["i"])
    phi = shapley.shapley_sampled(df.filter("i < 15"), background, ["i"], ["g"], ["a_t-1", "a_t-0", "b_t-0"],
                                  shapley.regression_score(model), n_perm=3, seed=2)
    rows = shapley.split_step_names(phi).collect()
    assert len(rows) == 45
    for r in rows:
        j = {("a", 1): 0, ("a", 0): 1, ("b", 0): 2}[r.feature, r.lag]
        want = model.coefficients[j] * (x[r.i, j] - x[drawn_rows([r.i], 60, 3, 2), j].mean())
        assert r.phi == pytest.approx(want, abs=1e-9)


def test_sampled_shapley_approaches_all_background_rows(spark, scored):
    x, df = scored
    model = RandomForestRegressor(numTrees=5, maxDepth=3, seed=1).fit(df)
    background = shapley.background_table(df, ["g"], ["i"])
    args = (df.filter("i = 20"), background, ["i"], ["g"], ["a", "b", "c"], shapley.regression_score(model))
    near = {r.feature: r.phi for r in shapley.shapley_sampled(*args, n_perm=1500).collect()}
    assert [near[f] for f in "abc"] == pytest.approx(shapley_by_hand(forest_predict(model), x[20], x).tolist(), abs=0.12)
    with pytest.raises(ValueError):
        shapley.shapley_exact(args[0], background, ["i"], ["g"], list("abcdefghijk"), args[5])


def test_all_weighted_coalitions_equal_the_exact_values(spark, scored):
    _, df = scored
    model = RandomForestRegressor(numTrees=5, maxDepth=3, seed=1).fit(df)
    background = shapley.background_table(df, ["g"], ["i"])
    args = (df.filter("i < 6"), background, ["i"], ["g"], ["a", "b", "c"], shapley.regression_score(model))
    exact = {(r.i, r.feature): r for r in shapley.shapley_exact(*args).collect()}
    got = shapley.shapley_coalitions(*args, budget=6).collect()
    assert len(got) == 18
    for r in got:
        assert r.phi == pytest.approx(exact[r.i, r.feature].phi, abs=1e-9)
        assert (r.base_value, r.fx) == pytest.approx((exact[r.i, r.feature].base_value, exact[r.i, r.feature].fx))


def test_weighted_coalitions_of_many_inputs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 13))
    df = spark.createDataFrame([(i, 0, Vectors.dense(v)) for i, v in enumerate(x)], ["i", "g", "features"])

    # a sum of inputs and one product: its value is shared by two inputs, whatever the coalitions drawn
    def score(frame):
        v = vector_to_array("features")
        return frame.withColumn("fx", F.array(F.aggregate(v, F.lit(0.0), lambda a, e: a + e), v[0] * v[1]))

    names = [f"x{j}" for j in range(13)]
    background = shapley.background_table(df, ["g"], ["i"])
    got = {(r.i, r.output, r.feature): r for r in shapley.shapley(df, background, ["i"], ["g"], names, score, outputs=2, draws=5, budget=400).collect()}
    assert len(got) == 30 * 2 * 13
    for i in range(30):
        b = x[drawn_rows([i], 30, 5, 0)]
        for j, n in enumerate(names):
            assert got[i, 0, n].phi == pytest.approx(x[i, j] - b[:, j].mean(), abs=1e-9)
        for o in (0, 1):
            assert sum(got[i, o, n].phi for n in names) == pytest.approx(got[i, o, "x0"].fx - got[i, o, "x0"].base_value)
        first = 0.5 * ((x[i, 0] * b[:, 1] - b[:, 0] * b[:, 1]) + (x[i, 0] * x[i, 1] - b[:, 0] * x[i, 1])).mean()
        assert got[i, 1, "x0"].phi == pytest.approx(first, abs=0.3)


def test_coalitions_are_the_kernel():
    masks, weights = shapley.coalition_design(5, 30)
    assert len(set(masks)) == 30 and weights.sum() == pytest.approx(sum(4 / (s * (5 - s)) for s in range(1, 5)))
    assert all(w == pytest.approx(4 / (math.comb(5, m.count("1")) * m.count("1") * (5 - m.count("1")))) for m, w in zip(masks, weights))
    drawn, weights = shapley.coalition_design(20, 100, 1)
    assert len(drawn) <= 100 and weights.sum() == pytest.approx(sum(19 / (s * (20 - s)) for s in range(1, 20)))
    assert shapley.coalition_design(20, 100, 1)[0] == drawn != shapley.coalition_design(20, 100, 2)[0]
    assert shapley.coalition_design(1, 10)[0] == []


def test_features_with_shared_prefix_stay_apart(spark):
    phi = spark.createDataFrame([(1, "temp", 0, 1.0), (1, "temp_max", 0, -3.0)], "i int, feature string, lag int, phi double")
    got = {r.feature: r.importance for r in attribution.attribution_by_feature(phi).collect()}
    assert got == {"temp": 1.0, "temp_max": 3.0}


def test_patient_boosting_keeps_the_least_validation_loss(spark):
    rng = np.random.default_rng(32)
    x = rng.normal(size=(160, 2))
    y = np.sin(2 * x[:, 0]) + 0.8 * rng.normal(size=160)
    df = spark.createDataFrame([(i, float(v), Vectors.dense(row)) for i, (row, v) in enumerate(zip(x, y))], ["i", "label", "features"])
    train, validation = df.filter("i < 100"), df.filter("i >= 100")
    found = regress.patient_boosting(train, validation, patience=4, rounds=40, first=3, maxDepth=3, seed=1)
    whole = GBTRegressor(maxIter=40, maxDepth=3, seed=1).fit(train).evaluateEachIteration(validation, "squared")
    assert found.losses == pytest.approx(whole[:len(found.losses)])
    assert found.kept == int(np.argmin(found.losses)) + 1 == found.model.getNumTrees
    assert len(found.losses) == min(40, found.kept + 4)
    own = found.model.evaluateEachIteration(validation, "squared")
    assert own[-1] == pytest.approx(min(found.losses))


def test_trials_are_repeatable():
    space = {"a": search.categorical(1, 2, 3), "b": search.whole(1, 3), "c": search.stepped(0.1, 0.5, 0.1)}
    assert search.draw_trials(space, 10, 7) == search.draw_trials(space, 10, 7)
    assert search.draw_trials(space, 10, 7) != search.draw_trials(space, 10, 8)
    assert space["c"] == [0.1, 0.2, 0.3, 0.4, 0.5]


def test_random_search_with_own_objective(spark):
    df = frame(spark, a=ar(30, 0.5, 22))
    space = {"x": search.whole(1, 50)}
    trials = search.random_search(df, S, ["y"], "y", space, n_trials=5, seed=3, objective=lambda params: spark.range(1).select(
        F.lit(float((params["x"] - 20) ** 2)).alias("rmse")))
    best = search.best_trial(trials.withColumn("g", F.lit(0)), ["g"]).first()
    assert trials.count() == 5 and best.rmse == min(r.rmse for r in trials.collect())
