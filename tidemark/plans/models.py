"""Tests, order search, forecasts and model queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import residuals as res
from tidemark.operators import seasonal as sea
from tidemark.operators import stationarity as sta
from tidemark.operators.ordered import Series, cumulative_sum, difference, positions
from tidemark.plans.registry import query, r, rs
from tidemark.plans.series import ACF, prio
from tidemark.plans.tables import DAILY, PARTS, load, production, with_views
from tidemark.sources.shared import as_table

SEASON = 7


def logged(spark, sf_dir):
    """Daily revenue per priority in logs, which keeps regressions well scaled."""
    return prio(spark, sf_dir).withColumn("y", F.log("revenue"))


# ---- tests -------------------------------------------------------------------------------------

@query("h1_adf_lag0", with_views("prio", f"""l AS (SELECT series, n, rn, ln(revenue) - lag(ln(revenue)) OVER w AS dy, lag(ln(revenue)) OVER w AS y1
    FROM prio WINDOW w AS (PARTITION BY series ORDER BY rn)), f AS (SELECT series, max(n) AS n, count(*) AS m, regr_slope(dy, y1) AS b,
    regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) AS syy FROM l WHERE rn > 1 GROUP BY 1)
    SELECT series, n, m AS n_obs, CAST(0 AS INT) AS used_lag, {rs("b / sqrt((syy - b * b * sxx) / (m - 2) / sxx)", "statistic")} FROM f"""))
def h1_lag0(spark, sf_dir):
    t = sta.adf_test(logged(spark, sf_dir), DAILY, "y", max_lag=0, autolag=False)
    return t.select("series", "n", "n_obs", "used_lag", r("statistic", "statistic"))


# the level's coefficient after taking the lagged difference out of both sides
LAG1 = """l AS (SELECT series, n, rn, ln(revenue) AS y, lag(ln(revenue), 1) OVER w AS y1, lag(ln(revenue), 2) OVER w AS y2 FROM prio
    WINDOW w AS (PARTITION BY series ORDER BY rn)),
    d AS (SELECT series, n, y - y1 AS dy, y1, y1 - y2 AS d1 FROM l WHERE rn > 2),
    r AS (SELECT series, regr_slope(dy, d1) AS b1, regr_intercept(dy, d1) AS a1, regr_slope(y1, d1) AS b2, regr_intercept(y1, d1) AS a2 FROM d GROUP BY 1),
    u AS (SELECT d.series, n, dy - a1 - b1 * d1 AS u, y1 - a2 - b2 * d1 AS v FROM d JOIN r ON d.series = r.series),
    t AS (SELECT series, max(n) AS n, count(*) AS m, sum(u * v) / sum(v * v) AS b, sum(v * v) AS vv, sum(u * u) AS uu FROM u GROUP BY 1)"""


@query("h1_adf_lag1", with_views("prio", f"""{LAG1} SELECT series, n, m AS n_obs, CAST(1 AS INT) AS used_lag,
    {rs("b / sqrt((uu - b * b * vv) / (m - 3) / vv)", "statistic")}, {rs("-2.86154 - 2.8903 / m - 4.234 / m ** 2 - 40.040 / m ** 3", "crit_5", 6)} FROM t"""))
def h1_lag1(spark, sf_dir):
    t = sta.adf_test(logged(spark, sf_dir), DAILY, "y", max_lag=1, autolag=False)
    return t.select("series", "n", "n_obs", "used_lag", r("statistic", "statistic"), r("crit_5", "crit_5", 6))


# lag 0 or 1 by AIC on the rows that both have; lag 0 is then fitted on all its rows
CHOICE = """c0 AS (SELECT series, max(n) AS n, count(*) AS m, regr_syy(dy, y1) - regr_slope(dy, y1) ** 2 * regr_sxx(dy, y1) AS rss FROM d GROUP BY 1),
    c1 AS (SELECT series, uu - b * b * vv AS rss FROM t),
    c AS (SELECT c0.series, n, m, c0.rss AS rss0, c1.rss AS rss1, m * ln(c0.rss) + 4 > m * ln(c1.rss) + 6 AS one FROM c0 JOIN c1 ON c0.series = c1.series),
    w AS (SELECT series, count(*) AS m, regr_slope(y - y1, y1) AS b, regr_sxx(y - y1, y1) AS sxx, regr_syy(y - y1, y1) AS syy FROM l WHERE rn > 1 GROUP BY 1),
    z AS (SELECT c.series, c.n, CASE WHEN one THEN 1 ELSE 0 END AS used_lag, CASE WHEN one THEN c.m ELSE w.m END AS n_obs,
    CASE WHEN one THEN t.b / sqrt(c.rss1 / (c.m - 3) / t.vv) ELSE w.b / sqrt((w.syy - w.b * w.b * w.sxx) / (w.m - 2) / w.sxx) END AS tau
    FROM c JOIN t ON c.series = t.series JOIN w ON c.series = w.series),
    g AS (SELECT *, CASE WHEN tau < -18.83 THEN -99 WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau ** 2
    ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau ** 2 - 0.010368 * tau ** 3 END AS score FROM z)"""


@query("h1_adf_autolag", with_views("prio", f"""{LAG1.replace("ln(revenue)", "ln(revenue) + CAST(rn AS DOUBLE) / n")}, {CHOICE} SELECT series, n, n_obs, CAST(used_lag AS INT) AS used_lag, {rs("tau", "statistic")},
    score < -1.6448536269514722 AS stationary, 'ok' AS status FROM g"""))
def h1_autolag(spark, sf_dir):
    df = logged(spark, sf_dir).withColumn("y", F.col("y") + F.col("rn").cast("double") / F.col("n"))
    t = sta.adf_test(df, DAILY, "y", max_lag=1)
    return t.select("series", "n", "n_obs", "used_lag", r("statistic", "statistic"), "stationary", "status")


@query("h1_adf_test")
def h1(spark, sf_dir):
    return sta.adf_test(logged(spark, sf_dir), DAILY, "y")


# all six variants tested without lags; p < 0.05 means a normal quantile below -1.645
H2 = """base AS (SELECT series, rn, sum(ln(revenue) - 12.5) OVER (PARTITION BY series ORDER BY rn) AS y FROM prio),
    v0 AS (SELECT series, rn, 0 AS sd, 0 AS d, y AS w FROM base
    UNION ALL SELECT series, rn, 1, 0, y - lag(y, 7) OVER (PARTITION BY series ORDER BY rn) FROM base),
    v1 AS (SELECT series, rn, sd, 1 AS d, w - lag(w) OVER (PARTITION BY series, sd ORDER BY rn) AS w FROM v0),
    v2 AS (SELECT series, rn, sd, 2 AS d, w - lag(w) OVER (PARTITION BY series, sd ORDER BY rn) AS w FROM v1),
    v AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2),
    l AS (SELECT series, sd, d, w - lag(w) OVER q AS dy, lag(w) OVER q AS y1 FROM v WHERE w IS NOT NULL WINDOW q AS (PARTITION BY series, sd, d ORDER BY rn)),
    f AS (SELECT series, sd, d, count(*) AS m, regr_slope(dy, y1) AS b, regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) AS syy FROM l WHERE y1 IS NOT NULL GROUP BY 1, 2, 3),
    t AS (SELECT series, sd, d, b / sqrt((syy - b * b * sxx) / (m - 2) / sxx) AS tau FROM f),
    g AS (SELECT *, CASE WHEN tau < -18.83 THEN -99 WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau ** 2
    ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau ** 2 - 0.010368 * tau ** 3 END AS z FROM t),
    a AS (SELECT series, sd, max(CASE WHEN d = 0 THEN z END) AS z0, coalesce(min(CASE WHEN z < -1.6448536269514722 THEN d END), 3) AS steps FROM g GROUP BY 1, 2),
    h2 AS (SELECT x.series, x.z0 >= -1.6448536269514722 AND y.z0 < x.z0 AS seasonal_diff, x.steps AS s0, y.steps AS s1 FROM a x JOIN a y ON x.series = y.series AND x.sd = 0 AND y.sd = 1)"""


@query("h2_make_stationary_lag0", with_views("prio", f"""{H2} SELECT series, seasonal_diff,
    CAST(CASE WHEN seasonal_diff THEN s1 ELSE s0 END AS INT) AS n_diff FROM h2"""))
def h2_lag0(spark, sf_dir):
    df = logged(spark, sf_dir).withColumn("y", F.col("y") - 12.5)
    walk = cumulative_sum(df, DAILY, ["y"]).drop("y")
    out = sta.make_stationary(walk, DAILY, "y_cum", SEASON, max_lag=0, autolag=False)
    return out.select("series", "seasonal_diff", "n_diff")


@query("h2_make_stationary")
def h2(spark, sf_dir):
    return sta.make_stationary(logged(spark, sf_dir), DAILY, "y", SEASON)


@query("h2_differenced_rows")
def h2_rows(spark, sf_dir):
    df = logged(spark, sf_dir)
    decision = sta.make_stationary(df, DAILY, "y", SEASON)
    return sta.apply_differencing(df, DAILY, "y", decision, SEASON)


@query("h3_ljung_box", with_views("prio", f"""{ACF}, q AS (SELECT series, max(n) AS n, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM acf GROUP BY 1)
    SELECT series, n, CAST(10 AS INT) AS h, {rs("q", "lb_stat")},
    {rs("exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24)", "lb_pvalue", 6)} FROM q"""))
def h3(spark, sf_dir):
    return res.ljung_box(prio(spark, sf_dir), DAILY, "revenue").select(
        "series", "n", "h", r("lb_stat", "lb_stat"), r("lb_pvalue", "lb_pvalue", 6))


MOMENTS = """d AS (SELECT series, revenue - lag(revenue) OVER (PARTITION BY series ORDER BY rn) AS e FROM prio),
    m AS (SELECT series, avg(e) AS mu, count(e) AS n FROM d GROUP BY 1),
    z AS (SELECT d.series, max(n) AS n, max(mu) AS mean, stddev_samp(e) AS std, avg((e - mu) ** 2) AS m2, avg((e - mu) ** 3) AS m3, avg((e - mu) ** 4) AS m4
    FROM d JOIN m ON d.series = m.series WHERE e IS NOT NULL GROUP BY 1),
    y AS (SELECT series, n, mean, std, m3 / m2 ** 1.5 AS s, m4 / m2 ** 2 - 3 AS k FROM z)"""


@query("h4_jarque_bera", with_views("prio", f"""{MOMENTS} SELECT series, n, {rs("s", "skewness", 6)}, {rs("k", "kurtosis", 6)},
    {rs("n / 6.0 * (s * s + k * k / 4)", "jb_stat")}, {rs("exp(-(n / 6.0 * (s * s + k * k / 4)) / 2)", "jb_pvalue", 6)} FROM y"""))
def h4(spark, sf_dir):
    d = difference(prio(spark, sf_dir), DAILY, ["revenue"], suffix="_e").filter("revenue_e is not null")
    return res.jarque_bera(d, ["series"], "revenue_e").select(
        "series", "n", r("skewness", "skewness", 6), r("kurtosis", "kurtosis", 6), r("jb_stat", "jb_stat"), r("jb_pvalue", "jb_pvalue", 6))


@query("h5_residual_moments", with_views("prio", f"""{MOMENTS} SELECT series, {rs("mean", "mean")}, {rs("std", "std", 3)}, {rs("s", "skewness", 6)},
    {rs("k", "kurtosis", 6)} FROM y"""))
def h5(spark, sf_dir):
    d = difference(prio(spark, sf_dir), DAILY, ["revenue"], suffix="_e").filter("revenue_e is not null")
    return res.residual_moments(d, ["series"], "revenue_e").select(
        "series", r("mean", "mean"), r("std", "std", 3), r("skewness", "skewness", 6), r("kurtosis", "kurtosis", 6))


# ---- order candidates --------------------------------------------------------------------------

CANDIDATES = """lens AS (SELECT l_partkey AS part_id, count(*) AS n FROM lineitem GROUP BY 1
    UNION ALL SELECT -1, count(*) FROM (SELECT DISTINCT l_shipdate FROM lineitem) HAVING count(*) > 0),
    b AS (SELECT *, CASE WHEN n < 50 THEN 1 ELSE 2 END AS mp, CASE WHEN n < 21 OR n < 50 THEN 0 ELSE 1 END AS msp,
    CASE WHEN n < 21 THEN 0 ELSE 1 END AS msd, CASE WHEN n < 21 THEN 1 ELSE 7 END AS season FROM lens),
    cand AS (SELECT part_id, n, season, p, d, q, sp, sd, sq, p + d + q + sp + sd + sq AS total FROM b, range(3) t1(p), range(2) t2(d),
    range(3) t3(q), range(2) t4(sp), range(2) t5(sd), range(2) t6(sq) WHERE p <= mp AND q <= mp AND sp <= msp AND sq <= msp AND sd <= msd)"""


def _lengths(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    parts = li.groupBy(F.col("l_partkey").alias("part_id")).agg(F.count(F.lit(1)).alias("n"))
    whole = li.agg(F.count_distinct("l_shipdate").alias("n")).select(F.lit(-1).cast("long").alias("part_id"), "n")
    return parts.unionByName(whole)


@query("m1_order_candidates", f"""WITH {CANDIDATES} SELECT part_id, n, CAST(season AS INT) AS season, count(*) AS candidates,
    CAST(max(p) AS INT) AS max_p, CAST(max(sp) AS INT) AS max_sp, CAST(max(sd) AS INT) AS max_sd FROM cand GROUP BY 1, 2, 3""")
def m1(spark, sf_dir):
    c = sea.order_candidates(_lengths(spark, sf_dir), SEASON)
    return c.groupBy("part_id", "n", "season").agg(
        F.count(F.lit(1)).alias("candidates"), F.max("p").alias("max_p"), F.max("sp").alias("max_sp"), F.max("sd").alias("max_sd"))


@query("f7_prune_candidates", f"""WITH {CANDIDATES} SELECT part_id, n, CAST(p AS INT) AS p, CAST(d AS INT) AS d, CAST(q AS INT) AS q,
    CAST(sp AS INT) AS sp, CAST(sd AS INT) AS sd, CAST(sq AS INT) AS sq FROM cand
    WHERE n >= 3 * total + season AND total <= n // 10 AND d + sd <= 2""")
def f7(spark, sf_dir):
    c = sea.prune_candidates(sea.order_candidates(_lengths(spark, sf_dir), SEASON))
    return c.select("part_id", "n", *sea.ORDER)


# ---- order search, fit, forecast ---------------------------------------------------------------

# the plain AR(1) without a constant, on the rows after the long autoregression (order 9)
AR1 = """l AS (SELECT series, rn, n, ln(revenue) AS y, lag(ln(revenue)) OVER (PARTITION BY series ORDER BY rn) AS y1 FROM prio),
    ar1 AS (SELECT series, max(n) AS n, count(*) AS m, sum(y * y1) / sum(y1 * y1) AS phi,
    (sum(y * y) - sum(y * y1) ** 2 / sum(y1 * y1)) / count(*) AS s2 FROM l WHERE rn > 9 GROUP BY 1)"""
LLF = "(-m / 2.0 * (ln(2 * pi() * s2) + 1))"


@query("m2_order_search_ar1", with_views("prio", f"""{AR1} SELECT series, m AS n_obs, {rs("phi", "phi", 6)}, {rs("s2", "sigma2", 6)},
    {rs(f"4 - 2 * {LLF}", "aic", 3)}, {rs(f"2 * ln(m) - 2 * {LLF}", "bic", 3)} FROM ar1"""))
def m2_ar1(spark, sf_dir):
    scored = sea.order_search(logged(spark, sf_dir), DAILY, "y", SEASON, fallback=False)
    pure = scored.filter("p = 1 and d = 0 and q = 0 and sp = 0 and sd = 0 and sq = 0")
    return pure.select("series", "n_obs", r(F.col("coefs")[0], "phi", 6), r("sigma2", "sigma2", 6),
                       r("aic", "aic", 3), r("bic", "bic", 3))


@query("m2_order_search")
def m2(spark, sf_dir):
    scored = sea.order_search(logged(spark, sf_dir), DAILY, "y", SEASON)
    return scored.filter("stage = 0").select("series", *sea.ORDER, "n_obs", "aic", "bic", "score", "status")


# pure autoregressions of both differencings, from sums of products
PURE = """s0 AS (SELECT series, 0 AS d, rn AS k, ln(revenue) AS w FROM prio
    UNION ALL SELECT series, 1, rn - 1, ln(revenue) - lag(ln(revenue)) OVER (PARTITION BY series ORDER BY rn) FROM prio),
    s1 AS (SELECT *, lag(w) OVER q AS w1, lag(w, 2) OVER q AS w2 FROM s0 WHERE k > 0 WINDOW q AS (PARTITION BY series, d ORDER BY k)),
    s2 AS (SELECT series, d, count(*) AS m, sum(w * w) AS c00, sum(w * w1) AS c01, sum(w * w2) AS c02, sum(w1 * w1) AS c11, sum(w1 * w2) AS c12, sum(w2 * w2) AS c22
    FROM s1 WHERE k > 9 GROUP BY 1, 2),
    s3 AS (SELECT series, 0 AS p, d, m, c00 / m AS s2 FROM s2 UNION ALL SELECT series, 1, d, m, (c00 - c01 * c01 / c11) / m FROM s2
    UNION ALL SELECT series, 2, d, m, (c00 - (c01 * (c01 * c22 - c02 * c12) + c02 * (c02 * c11 - c01 * c12)) / (c11 * c22 - c12 * c12)) / m FROM s2)"""


@query("m2_order_search_autoregressive", with_views("prio", f"""{PURE} SELECT series, CAST(p AS INT) AS p, CAST(d AS INT) AS d, m AS n_obs, {rs("s2 * 1000", "sigma2", 6)},
    {rs(f"2 * (p + 1) - 2 * {LLF}", "aic", 3)}, {rs(f"(p + 1) * ln(m) - 2 * {LLF}", "bic", 3)},
    CAST(row_number() OVER (PARTITION BY series ORDER BY 2 * (p + 1) - 2 * {LLF}, p, d) AS INT) AS place FROM s3"""))
def m2_pure(spark, sf_dir):
    scored = sea.order_search(logged(spark, sf_dir), DAILY, "y", SEASON, sea.Bounds(2, 1, 0, 0, 0, 0), fallback=False)
    place = F.row_number().over(Window.partitionBy("series").orderBy("score", "candidate"))
    return scored.select("series", "p", "d", "n_obs", r(F.col("sigma2") * 1000, "sigma2", 6), r("aic", "aic", 3), r("bic", "bic", 3), place.alias("place"))


# products with the parameter of the season: least squares in turn for one, given the other
TURNS = """p0 AS (SELECT series, rn - 1 AS k, ln(revenue) - lag(ln(revenue)) OVER (PARTITION BY series ORDER BY rn) AS w FROM prio),
    p1 AS (SELECT *, lag(w) OVER q AS w1, lag(w, 7) OVER q AS w7, lag(w, 8) OVER q AS w8 FROM p0 WHERE k > 0 WINDOW q AS (PARTITION BY series ORDER BY k)),
    p2 AS (SELECT series, count(*) AS m, sum(w * w) AS c00, sum(w * w1) AS c01, sum(w * w7) AS c07, sum(w * w8) AS c08, sum(w1 * w1) AS c11, sum(w1 * w7) AS c17,
    sum(w1 * w8) AS c18, sum(w7 * w7) AS c77, sum(w7 * w8) AS c78, sum(w8 * w8) AS c88 FROM p1 WHERE k > 9 GROUP BY 1),
    p3 AS (SELECT *, 0 AS turn, 0.0::DOUBLE AS f, 0.0::DOUBLE AS g FROM p2 UNION ALL
    SELECT * EXCLUDE (f1) REPLACE (turn + 1 AS turn, f1 AS f, (c07 - f1 * (c08 + c17) + f1 * f1 * c18) / (c77 - 2 * f1 * c78 + f1 * f1 * c88) AS g)
    FROM (SELECT *, (c01 - g * (c08 + c17) + g * g * c78) / (c11 - 2 * g * c18 + g * g * c88) AS f1 FROM p3 WHERE turn < 200)),
    p4 AS (SELECT *, (c00 - 2 * g * c07 + g * g * c77 - 2 * f * (c01 - g * (c08 + c17) + g * g * c78) + f * f * (c11 - 2 * g * c18 + g * g * c88)) / m AS s2
    FROM p3 WHERE turn = 200)"""


@query("m4_fit_multiplied", with_views("prio", f"""{TURNS} SELECT series, m AS n_obs, {rs("f", "phi", 6)}, {rs("g", "seasonal_phi", 6)}, {rs("-f * g", "product", 6)},
    {rs("s2 * 1000", "sigma2", 6)}, {rs(f"6 - 2 * {LLF}", "aic", 3)} FROM p4"""))
def m4_multiplied(spark, sf_dir):
    df = logged(spark, sf_dir)
    orders = df.select("series").distinct().select("series", *[F.lit(v).alias(c) for c, v in zip(sea.ORDER, (1, 1, 0, 1, 0, 0))])
    model = sea.fit_seasonal(sea.design_rows(df, DAILY, "y", SEASON, sea.Bounds()), DAILY, orders, SEASON)
    beta = F.map_from_arrays("terms", "coefs")
    return model.select("series", "n_obs", r(beta["_v1"], "phi", 6), r(beta["_v7"], "seasonal_phi", 6), r(beta["_v8"], "product", 6),
                        r(F.col("sigma2") * 1000, "sigma2", 6), r("aic", "aic", 3))


@query("m4_fit_refined")
def m4_refined(spark, sf_dir):
    # (1,1,1)(1,0,1): both sides multiplied, the shocks refiltered by the model itself
    df = as_table(logged(spark, sf_dir), "series")
    design = as_table(sea.design_rows(df, DAILY, "y", SEASON, sea.Bounds()), "design")
    orders = df.select("series").distinct().select("series", *[F.lit(v).alias(c) for c, v in zip(sea.ORDER, (1, 1, 1, 1, 0, 1))])
    _, model = sea.refined(design, DAILY, orders, SEASON)
    return model.select("series", "terms", "coefs", "sigma2", "aic", "status")


SIMPLE = """pr AS (SELECT part_id, price, row_number() OVER q AS rn, count(*) OVER (PARTITION BY part_id) AS n FROM production
    WINDOW q AS (PARTITION BY part_id ORDER BY ts, l_orderkey, l_linenumber, price)),
    v0 AS (SELECT part_id, n, 0 AS d, rn AS k, n AS nd, price AS w FROM pr
    UNION ALL SELECT part_id, n, 1, rn - 1, n - 1, price - lag(price) OVER (PARTITION BY part_id ORDER BY rn) FROM pr),
    v1 AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY part_id, d ORDER BY k), 0) AS w1 FROM v0 WHERE k > 0),
    v2 AS (SELECT part_id, n, d, count(*) AS m, sum(w * w) AS c00, sum(w * w1) AS c01, sum(w1 * w1) AS c11 FROM v1 WHERE k > least(9, nd // 3) GROUP BY 1, 2, 3),
    v3 AS (SELECT part_id, n, 0 AS p, d, m, c00 / m AS s2 FROM v2 UNION ALL SELECT part_id, n, 1, d, m, (c00 - c01 * c01 / c11) / m FROM v2 WHERE c11 > 0),
    v4 AS (SELECT *, 2 * (p + 1) - 2 * (-m / 2.0 * (ln(2 * pi() * s2) + 1)) AS aic FROM v3
    WHERE m > p + 1 AND s2 > 0 AND p + d <= n // 10 AND n >= 3 * (p + d) + CASE WHEN n < 21 THEN 1 ELSE 7 END),
    v5 AS (SELECT * FROM v4 QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY aic, p, d) = 1),
    parts AS (SELECT DISTINCT part_id FROM pr)"""


@query("m3_best_order_autoregressive", with_views("production", f"""{SIMPLE} SELECT part_id, CAST(CASE WHEN aic IS NULL THEN 2 ELSE 0 END AS INT) AS stage, CAST(coalesce(p, 0) AS INT) AS p,
    CAST(coalesce(d, 1) AS INT) AS d, CASE WHEN aic IS NULL THEN 'random_walk' ELSE 'ok' END AS status, {rs("coalesce(aic, 999999)", "score", 3)}
    FROM parts LEFT JOIN v5 USING (part_id)"""))
def m3_pure(spark, sf_dir):
    df = positions(production(spark, sf_dir), PARTS)
    scored = sea.order_search(df, PARTS, "price", SEASON, sea.Bounds(1, 1, 0, 0, 0, 0))
    return sea.best_orders(scored, ["part_id"]).select("part_id", "stage", "p", "d", "status", r("score", "score", 3))


@query("m3_best_order_with_fallback")
def m3(spark, sf_dir):
    # one short series per part: many allow no candidate, or only the simple ones
    df = positions(production(spark, sf_dir), PARTS)
    scored = sea.order_search(df, PARTS, "price", SEASON)
    return sea.best_orders(scored, ["part_id"])


@query("t6_best_candidate", with_views("prio", f"""{AR1}, walk AS (SELECT series, count(*) AS m, avg((y - y1) ** 2) AS s2 FROM l WHERE rn > 10 GROUP BY 1),
    both_ AS (SELECT series, 'ar1' AS model, 4 - 2 * {LLF} AS score FROM ar1 UNION ALL SELECT series, 'walk', 2 - 2 * {LLF} FROM walk)
    SELECT series, arg_min(model, score) AS model, {rs("min(score)", "score", 3)} FROM both_ GROUP BY 1"""))
def t6(spark, sf_dir):
    from tidemark.operators.ranking import best_rows
    scored = sea.order_search(logged(spark, sf_dir), DAILY, "y", SEASON, fallback=False)
    two = scored.filter("q = 0 and sp = 0 and sd = 0 and sq = 0 and p + d = 1").select(
        "series", "score", "candidate", F.when(F.col("p") == 1, "ar1").otherwise("walk").alias("model"))
    return best_rows(two, ["series"], "score", ["candidate"]).select("series", "model", r("score", "score", 3))


def _ar1_orders(df, keys):
    return df.select(*keys).distinct().select(*keys, F.lit(1).alias("p"), *[F.lit(0).alias(c) for c in sea.ORDER[1:]])


@query("m4_fit_ar1", with_views("prio", f"""{AR1} SELECT series, {rs("phi", "phi", 6)}, {rs("s2", "sigma2", 6)}, {rs(LLF, "llf", 3)}, m AS n_obs FROM ar1"""))
def m4(spark, sf_dir):
    df = logged(spark, sf_dir)
    model = sea.fit_seasonal(sea.design_rows(df, DAILY, "y", SEASON, sea.Bounds()), DAILY,
                             _ar1_orders(df, ["series"]), SEASON)
    return model.select("series", r(F.col("coefs")[0], "phi", 6), r("sigma2", "sigma2", 6), r("llf", "llf", 3), "n_obs")


@query("m4_fit_default_diagnostics")
def m4_default(spark, sf_dir):
    df = as_table(logged(spark, sf_dir), "series")
    design = as_table(sea.design_rows(df, DAILY, "y", SEASON, sea.Bounds()), "design")
    model = sea.fit_seasonal(design, DAILY, sea.default_orders(df, ["series"], SEASON), SEASON)
    resid = sea.model_residuals(design, DAILY, model, SEASON)
    diag = res.residual_diagnostics(resid, Series(("series",), ("rn",)), "resid")
    return model.select("series", "aic", "bic", "llf", "terms", "coefs").join(diag, "series")


@query("m5_forecast_ar1", with_views("prio", f"""{AR1}, last AS (SELECT series, arg_max(y, rn) AS y FROM l GROUP BY 1)
    SELECT a.series, CAST(h AS INT) AS step, {rs("phi ** h * y", "predicted", 6)},
    {rs("phi ** h * y - 1.959963984540054 * sqrt(s2 * (1 - phi ** (2 * h)) / (1 - phi * phi))", "lower", 6)},
    {rs("phi ** h * y + 1.959963984540054 * sqrt(s2 * (1 - phi ** (2 * h)) / (1 - phi * phi))", "upper", 6)}
    FROM ar1 a JOIN last ON a.series = last.series, range(1, 15) t(h)"""))
def m5(spark, sf_dir):
    df = as_table(logged(spark, sf_dir), "series")
    design = as_table(sea.design_rows(df, DAILY, "y", SEASON, sea.Bounds()), "design")
    model = sea.fit_seasonal(design, DAILY, _ar1_orders(df, ["series"]), SEASON)
    f = sea.forecast(df, design, DAILY, "y", model, 14, SEASON)
    return f.select("series", "step", r("predicted", "predicted", 6), r("lower", "lower", 6), r("upper", "upper", 6))


@query("m6_walk_forward_ar1", with_views("prio", f"""l AS (SELECT series, rn, n, ln(revenue) AS y, lag(ln(revenue)) OVER (PARTITION BY series ORDER BY rn) AS y1,
    n // 2 AS tr, (n - n // 2) // 3 AS size FROM prio),
    f AS (SELECT l.*, fold, tr + (fold - 1) * size AS n_train FROM l, range(1, 4) t(fold)),
    fit AS (SELECT series, fold, max(n_train) AS n_train, count(*) AS m, sum(y * y1) / sum(y1 * y1) AS phi,
    (sum(y * y) - sum(y * y1) ** 2 / sum(y1 * y1)) / count(*) AS s2 FROM f WHERE rn > 9 AND rn <= n_train GROUP BY 1, 2),
    ends AS (SELECT series, fold, y FROM f WHERE rn = n_train),
    e AS (SELECT f.series, f.fold, f.y, fit.phi ** (f.rn - f.n_train) * ends.y AS p, fit.n_train, 4 - 2 * {LLF} AS aic FROM f JOIN fit ON f.series = fit.series AND f.fold = fit.fold
    JOIN ends ON f.series = ends.series AND f.fold = ends.fold WHERE f.rn > f.n_train AND f.rn <= f.n_train + f.size)
    SELECT series, CAST(fold AS INT) AS fold, max(n_train) AS n_train, count(*) AS n_test, {rs("avg((y - p) ** 2)", "mse", 6)}, {rs("avg(abs(y - p))", "mae", 6)},
    {rs("sqrt(avg((y - p) ** 2))", "rmse", 6)}, {rs("1 - sum((y - p) ** 2) / (var_pop(y) * count(*))", "r2", 4)}, {rs("max(aic)", "aic", 3)} FROM e GROUP BY 1, 2"""))
def m6_ar1(spark, sf_dir):
    df = logged(spark, sf_dir)
    _, scores = sea.walk_forward(df, DAILY, "y", SEASON, orders=_ar1_orders(df, ["series"]))
    return scores.select("series", "fold", "n_train", "n_test", r("mse", "mse", 6), r("mae", "mae", 6), r("rmse", "rmse", 6),
                         r("r2", "r2", 4), r("aic", "aic", 3))


CHOSEN = """u0 AS (SELECT series, rn, n, ln(revenue) AS y, ln(revenue) - lag(ln(revenue)) OVER (PARTITION BY series ORDER BY rn) AS dy, n // 2 AS tr, (n - n // 2) // 3 AS size FROM prio),
    u1 AS (SELECT series, rn, tr, size, d, CASE d WHEN 0 THEN y ELSE dy END AS w FROM u0, range(0, 2) t(d) WHERE rn > d),
    u2 AS (SELECT *, lag(w) OVER (PARTITION BY series, d ORDER BY rn) AS w1 FROM u1),
    u3 AS (SELECT series, d, fold, tr + (fold - 1) * size AS n_train, count(*) AS m, sum(w * w) AS c00, sum(w * w1) AS c01, sum(w1 * w1) AS c11
    FROM u2, range(1, 4) t(fold) WHERE rn - d > 9 AND rn <= tr + (fold - 1) * size GROUP BY 1, 2, 3, 4),
    u4 AS (SELECT *, p * c01 / c11 AS phi, (c00 - p * c01 * c01 / c11) / m AS s2 FROM u3, range(0, 2) t(p)),
    u5 AS (SELECT *, 2 * (p + 1) - 2 * (-m / 2.0 * (ln(2 * pi() * s2) + 1)) AS aic FROM u4),
    u6 AS (SELECT series, p, d FROM u5 WHERE fold = 1 QUALIFY row_number() OVER (PARTITION BY series ORDER BY aic, p, d) = 1),
    u7 AS (SELECT u5.* FROM u5 JOIN u6 USING (series, p, d)),
    u8 AS (SELECT u7.*, y AS y_end, dy AS dy_end FROM u7 JOIN u0 ON u0.series = u7.series AND rn = n_train),
    u9 AS (SELECT u0.series, fold, p, d, n_train, aic, y, CASE d WHEN 0 THEN phi ** (rn - n_train) * y_end
    ELSE y_end + dy_end * CASE WHEN phi = 1 THEN rn - n_train ELSE phi * (1 - phi ** (rn - n_train)) / (1 - phi) END END AS f
    FROM u0 JOIN u8 ON u0.series = u8.series WHERE rn > n_train AND rn <= n_train + size)"""


@query("m6_walk_forward_chosen", with_views("prio", f"""{CHOSEN} SELECT series, CAST(fold AS INT) AS fold, 'ok' AS status, n_train, count(*) AS n_test, {rs("avg((y - f) ** 2)", "mse", 6)},
    {rs("avg(abs(y - f))", "mae", 6)}, {rs("1 - sum((y - f) ** 2) / (var_pop(y) * count(*))", "r2", 4)}, {rs("aic", "aic", 3)} FROM u9 GROUP BY series, fold, n_train, aic"""))
def m6_chosen(spark, sf_dir):
    # orders chosen on the first part, fitted again for each fold
    _, scores = sea.walk_forward(logged(spark, sf_dir), DAILY, "y", SEASON, bounds=sea.Bounds(1, 1, 0, 0, 0, 0))
    return scores.select("series", "fold", "status", "n_train", "n_test", r("mse", "mse", 6), r("mae", "mae", 6), r("r2", "r2", 4), r("aic", "aic", 3))


@query("m6_walk_forward_searched")
def m6(spark, sf_dir):
    _, scores = sea.walk_forward(logged(spark, sf_dir), DAILY, "y", SEASON)
    return sea.walk_forward_summary(scores, ["series"])
