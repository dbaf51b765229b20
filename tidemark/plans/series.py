"""Window operators, aggregates, scaling and metrics over the series views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.clean import nan_as_null
from tidemark.operators import aggregates as agg
from tidemark.operators import folds, metrics, ordered, scaling
from tidemark.operators.filters import series_status
from tidemark.operators.ordered import Series, positions
from tidemark.operators.sequences import last_step, sequences
from tidemark.plans.registry import big, bigs, day, days, query, r, rs
from tidemark.plans.tables import (
    BLOCK_ROWS, DAILY, EVENTS, MEASURES, PARTS, WEEKLY, daily_sales, gap_events, inspection, load, priority_sales,
    production, weekly, with_views)


def prio(spark, sf_dir):
    return positions(priority_sales(spark, sf_dir), DAILY)


def gaps(spark, sf_dir):
    return positions(gap_events(spark, sf_dir), EVENTS)


# ---- ordered operators -------------------------------------------------------------------------

@query("w2_row_index", with_views("production", f"""SELECT part_id, l_orderkey, {rs("price", "price", 2)},
    row_number() OVER (PARTITION BY part_id ORDER BY ts, l_orderkey, l_linenumber, price) AS rn,
    count(*) OVER (PARTITION BY part_id) AS n FROM production"""))
def w2(spark, sf_dir):
    df = production(spark, sf_dir).select("part_id", "ts", "l_orderkey", "l_linenumber", "price")
    return positions(df, PARTS).select("part_id", "l_orderkey", r("price", "price", 2), "rn", "n")


@query("w2_null_keys", with_views("production", f"""k AS (SELECT *, CASE WHEN part_id % 3 > 0 THEN part_id END AS k FROM production)
    SELECT k AS part_id, l_orderkey, {rs("price", "price", 2)}, row_number() OVER (PARTITION BY k ORDER BY ts, l_orderkey, l_linenumber, price) AS rn,
    count(*) OVER (PARTITION BY k) AS n FROM k"""))
def w2_null_keys(spark, sf_dir):
    # a third of the rows has no key: one series like any other
    df = production(spark, sf_dir).select("ts", "l_orderkey", "l_linenumber", "price", F.when(F.col("part_id") % 3 > 0, F.col("part_id")).alias("part_id"))
    return positions(df, PARTS).select("part_id", "l_orderkey", r("price", "price", 2), "rn", "n")


@query("w3_difference", with_views("prio", f"""SELECT series, {days("ts")}, {rs("d1", "d1")}, {rs("d2", "d2")} FROM (
    SELECT *, d1 - lag(d1) OVER (PARTITION BY series ORDER BY rn) AS d2 FROM (SELECT *,
    revenue - lag(revenue) OVER (PARTITION BY series ORDER BY rn) AS d1 FROM prio)) WHERE d1 IS NOT NULL"""))
def w3(spark, sf_dir):
    df = ordered.difference(prio(spark, sf_dir), DAILY, ["revenue"], 1, suffix="_d1")
    df = ordered.difference(df, DAILY, ["revenue"], 2, suffix="_d2")
    return df.filter("revenue_d1 is not null").select(
        "series", day("ts"), r("revenue_d1", "d1"), r("revenue_d2", "d2"))


@query("w4_seasonal_difference", with_views("prio", f"""SELECT series, {days("ts")}, {rs("d", "d")} FROM (SELECT *,
    revenue - lag(revenue, 7) OVER (PARTITION BY series ORDER BY rn) AS d FROM prio) WHERE d IS NOT NULL"""))
def w4(spark, sf_dir):
    df = ordered.difference(prio(spark, sf_dir), DAILY, ["revenue"], lag=7, suffix="_d")
    return df.filter("revenue_d is not null").select("series", day("ts"), r("revenue_d", "d"))


@query("w5_log_returns", with_views("prio", f"""SELECT series, {days("ts")},
    {rs("ln(sold + 1) - lag(ln(sold + 1)) OVER w", "sold", 6)}, {rs("ln(revenue + 1) - lag(ln(revenue + 1)) OVER w", "revenue", 6)}
    FROM prio WINDOW w AS (PARTITION BY series ORDER BY rn)"""))
def w5(spark, sf_dir):
    df = ordered.log_returns(prio(spark, sf_dir), DAILY, ["sold", "revenue"])
    return df.select("series", day("ts"), r("sold_ret", "sold", 6), r("revenue_ret", "revenue", 6))


@query("w6_cumulative_sum", with_views("gaps", f"""SELECT user_id, event_id, {rs("sum(v) OVER (PARTITION BY user_id ORDER BY rn)", "total")}
    FROM gaps"""))
def w6(spark, sf_dir):
    return ordered.cumulative_sum(gaps(spark, sf_dir), EVENTS, ["v"]).select(
        "user_id", "event_id", r("v_cum", "total"))


@query("w7_split_cumsum", with_views("prio", f"""SELECT series, {days("ts")}, split, {rs("total", "total", 3)} FROM (SELECT *,
    CASE WHEN split = 'train' THEN 2 ELSE 1 END * sum(sold) OVER (PARTITION BY series, split ORDER BY rn) AS total FROM (
    SELECT *, CASE WHEN rn <= round_even(0.7::DOUBLE * n, 0) THEN 'train' ELSE 'test' END AS split FROM prio))"""))
def w7(spark, sf_dir):
    df = folds.ordered_split(prio(spark, sf_dir), 0.3, "half_even")
    return ordered.split_cumsum(df, DAILY, ["sold"]).select("series", day("ts"), "split", r("sold_cum", "total", 3))


@query("w8_forward_fill", with_views("gaps", f"""SELECT user_id, event_id, {rs("last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "v")}
    FROM gaps"""))
def w8(spark, sf_dir):
    return ordered.forward_fill(gaps(spark, sf_dir), EVENTS, ["v"]).select("user_id", "event_id", r("v", "v"))


@query("w8_forward_fill_nan", with_views("gaps", f"""SELECT user_id, event_id, {rs("last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "v")}
    FROM gaps"""))
def w8_nan(spark, sf_dir):
    # what is missing comes as NaN
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(
        F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    df = positions(nan_as_null(e), EVENTS)
    return ordered.forward_fill(df, EVENTS, ["v"]).select("user_id", "event_id", r("v", "v"))


@query("w9_sequences_next", with_views("prio", f"""SELECT a.series, a.rn - 7 AS sample, {days("a.ts")}, {rs("a.sold", "label")},
    {rs("sum(b.sold)", "total")}, {rs("max(CASE WHEN b.rn = a.rn - 7 THEN b.revenue END)", "oldest")},
    {rs("max(CASE WHEN b.rn = a.rn - 1 THEN b.revenue END)", "latest")}
    FROM prio a JOIN prio b ON a.series = b.series AND b.rn BETWEEN a.rn - 7 AND a.rn - 1 WHERE a.rn > 7 GROUP BY 1, 2, 3, a.sold"""))
def w9(spark, sf_dir):
    seq = sequences(prio(spark, sf_dir), DAILY, ["sold", "revenue"], "sold", 7)
    total = F.aggregate("steps", F.lit(0.0), lambda acc, x: acc + x["sold"])
    return seq.select("series", "sample", day("ts"), r("label", "label"), r(total, "total"),
                      r(F.col("steps")[0]["revenue"], "oldest"), r(F.col("steps")[6]["revenue"], "latest"))


@query("w10_sequences_same_window", with_views("prio", f"""SELECT a.series, a.rn - 9 AS sample, {rs("sum(b.sold)", "total_in")},
    {rs("sum(b.revenue)", "total_label", 2)} FROM prio a JOIN prio b ON a.series = b.series AND b.rn BETWEEN a.rn - 9 AND a.rn
    WHERE a.rn >= 10 AND a.rn <= a.n - 2 GROUP BY 1, 2"""))
def w10(spark, sf_dir):
    seq = sequences(prio(spark, sf_dir), DAILY, ["sold", "revenue"], "revenue", 10, label="same_window")
    total = F.aggregate("steps", F.lit(0.0), lambda acc, x: acc + x["sold"])
    label = F.aggregate("label", F.lit(0.0), lambda acc, x: acc + x)
    return seq.select("series", "sample", r(total, "total_in"), r(label, "total_label", 2))


@query("w11_last_step", with_views("prio", f"""SELECT series, rn - 9 AS sample, {rs("revenue", "actual")}, {rs("prev", "predicted")}
    FROM (SELECT *, lag(revenue) OVER (PARTITION BY series ORDER BY rn) AS prev FROM prio) WHERE rn >= 10 AND rn <= n - 3"""))
def w11(spark, sf_dir):
    df = ordered.lags(prio(spark, sf_dir), DAILY, "revenue", [1], "prev")
    seq = sequences(df, DAILY, ["prev1", "revenue"], "revenue", 10, label="same_window")
    seq = seq.withColumns({"forecast": F.transform("steps", lambda x: x["prev1"]), "n_windows": F.col("n") - 11})
    return last_step(seq, "forecast").select("series", "sample", r("actual", "actual"), r("predicted", "predicted"))


@query("w12_ordered_split", with_views("prio", f"""SELECT series, {days("ts")}, CASE WHEN rn <= floor(n * 0.5) THEN 'train'
    ELSE 'test' END AS split FROM prio"""))
def w12(spark, sf_dir):
    return folds.ordered_split(prio(spark, sf_dir), 0.5).select("series", day("ts"), "split")


@query("w13_half_even_split", """SELECT part_id, split, count(*) AS "rows" FROM (SELECT l_partkey AS part_id,
    CASE WHEN row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)
    <= round_even(CAST(0.7 AS DOUBLE) * count(*) OVER (PARTITION BY l_partkey), 0) THEN 'train' ELSE 'test' END AS split FROM lineitem) GROUP BY 1, 2""")
def w13(spark, sf_dir):
    df = positions(production(spark, sf_dir), PARTS)
    return folds.ordered_split(df, 0.3, "half_even").groupBy("part_id", "split").agg(F.count(F.lit(1)).alias("rows"))


FOLDS = """folds AS (SELECT series, ts, rn, n, revenue, sold, prev, fold, CASE WHEN rn <= tr + (fold - 1) * size THEN 'train'
    ELSE 'test' END AS role FROM (SELECT *, CAST(floor(n * 0.5) AS BIGINT) AS tr, (n - CAST(floor(n * 0.5) AS BIGINT)) // 3 AS size,
    lag(revenue) OVER (PARTITION BY series ORDER BY rn) AS prev FROM prio), range(1, 4) f(fold) WHERE rn <= tr + fold * size)"""


@query("w14_expanding_folds", with_views("prio", f"""{FOLDS} SELECT series, fold, role, count(*) AS "rows", {days("min(ts)", "first_ts")},
    {days("max(ts)", "last_ts")} FROM folds GROUP BY 1, 2, 3""".replace("series, fold, role", "series, CAST(fold AS INT) AS fold, role")))
def w14(spark, sf_dir):
    return folds.expanding_folds(prio(spark, sf_dir)).groupBy("series", "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), day(F.min("ts"), "first_ts"), day(F.max("ts"), "last_ts"))


@query("u1_training_rows", with_views("prio", f"""{FOLDS} SELECT series, CAST(fold AS INT) AS fold, count(*) AS "rows",
    {rs("sum(revenue)", "revenue", 2)} FROM folds WHERE role = 'train' GROUP BY 1, 2"""))
def u1(spark, sf_dir):
    return folds.training_rows(folds.expanding_folds(prio(spark, sf_dir))).groupBy("series", "fold").agg(
        F.count(F.lit(1)).alias("rows"), r(F.sum("revenue"), "revenue", 2))


def _decompose_sql(period: int, trend: str) -> str:
    half = period // 2
    return with_views("prio", f"""t AS (SELECT *, CASE WHEN count(revenue) OVER (PARTITION BY series ORDER BY rn
    ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) = {2 * half + 1} THEN {trend} END AS trend, (rn - 1) % {period} AS phase FROM prio
    WINDOW w AS (PARTITION BY series ORDER BY rn)),
    ph AS (SELECT series, phase, avg(revenue - trend) AS m FROM t GROUP BY 1, 2),
    pc AS (SELECT series, phase, m - avg(m) OVER (PARTITION BY series) AS seasonal FROM ph)
    SELECT t.series, {days("ts")}, {rs("trend", "trend", 5)}, {rs("seasonal", "seasonal", 5)},
    {rs("revenue - trend - seasonal", "resid", 5)} FROM t JOIN pc ON t.series = pc.series AND t.phase = pc.phase""")


@query("w15_seasonal_decompose", _decompose_sql(7, "avg(revenue) OVER (PARTITION BY series ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"))
def w15(spark, sf_dir):
    return ordered.seasonal_decompose(prio(spark, sf_dir), DAILY, "revenue", 7).select(
        "series", day("ts"), r("trend", "trend", 5), r("seasonal", "seasonal", 5), r("resid", "resid", 5))


@query("w15_even_period", _decompose_sql(12, "(sum(revenue) OVER (PARTITION BY series ORDER BY rn ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)"
                                         " - (lag(revenue, 6) OVER w + lead(revenue, 6) OVER w) / 2) / 12"))
def w15_even(spark, sf_dir):
    return ordered.seasonal_decompose(prio(spark, sf_dir), DAILY, "revenue", 12).select(
        "series", day("ts"), r("trend", "trend", 5), r("seasonal", "seasonal", 5), r("resid", "resid", 5))


ACF = """c AS (SELECT series, rn, n, revenue - avg(revenue) OVER (PARTITION BY series) AS c FROM prio),
    acf AS (SELECT a.series, h.lag, sum(a.c * b.c) / max(v.ss) AS acf, max(a.n) AS n FROM c a
    JOIN range(1, 11) h(lag) ON true JOIN c b ON a.series = b.series AND b.rn = a.rn - h.lag
    JOIN (SELECT series, sum(c * c) AS ss FROM c GROUP BY 1) v ON v.series = a.series GROUP BY 1, 2)"""


@query("w16_autocorrelation", with_views("prio", f"""{ACF} SELECT series, CAST(lag AS INT) AS lag, {rs("acf", "acf", 6)}, n FROM acf"""))
def w16(spark, sf_dir):
    return ordered.autocorrelation(prio(spark, sf_dir), DAILY, "revenue", 10).select(
        "series", "lag", r("acf", "acf", 6), "n")


@query("w17_test_period", with_views("production weekly", """SELECT product, arg_min(year_week, rn) AS first_label,
    arg_max(year_week, rn) AS last_label, count(*) AS samples FROM weekly WHERE rn > 10 AND rn - 10 > floor((n - 10) * 0.7::DOUBLE) GROUP BY 1"""))
def w17(spark, sf_dir):
    return test_period(test_sequences(spark, sf_dir))


def weekly_samples(spark, sf_dir, features=tuple(MEASURES), length=10, p=0.7):
    """Weekly windows per product, split in order."""
    seq = sequences(weekly(spark, sf_dir), WEEKLY, list(features), "failure", length)
    train = F.floor((F.col("n") - length) * F.lit(p))
    return seq.withColumn("split", F.when(F.col("sample") <= train, "train").otherwise("test"))


def test_sequences(spark, sf_dir):
    return weekly_samples(spark, sf_dir).filter("split = 'test'")


def test_period(seq):
    return seq.groupBy("product").agg(
        F.min_by("year_week", "rn").alias("first_label"), F.max_by("year_week", "rn").alias("last_label"),
        F.count(F.lit(1)).alias("samples"))


@query("w18_validation_tail", with_views("prio", """SELECT series, is_validation, count(*) AS "rows" FROM (SELECT series,
    rn > floor(floor(n * 0.7::DOUBLE) * (1 - 0.2)) AS is_validation FROM prio WHERE rn <= floor(n * 0.7::DOUBLE)) GROUP BY 1, 2"""))
def w18(spark, sf_dir):
    df = folds.ordered_split(prio(spark, sf_dir), 0.7).filter("split = 'train'").withColumn(
        "train_n", folds.cut_point(0.7))
    return folds.validation_tail(df).groupBy("series", "is_validation").agg(F.count(F.lit(1)).alias("rows"))


# ---- scaling -----------------------------------------------------------------------------------

def _scale_sql(fit: str, expr: str, params: str) -> str:
    return with_views("prio", f"""p AS (SELECT series, {params} FROM prio {fit} GROUP BY 1)
    SELECT prio.series, {days("ts")}, {rs(expr, "revenue", 6)} FROM prio JOIN p ON prio.series = p.series""")


@query("n1_standard_scale", _scale_sql("", "(revenue - m) / s", "avg(revenue) AS m, stddev_pop(revenue) AS s"))
def n1(spark, sf_dir):
    return scaling.standard_scale(prio(spark, sf_dir), DAILY, ["revenue"]).select(
        "series", day("ts"), r("revenue", "revenue", 6))


@query("n1_standard_scale_train_fit", _scale_sql("WHERE rn <= floor(n * 0.5)", "(revenue - m) / s",
                                                 "avg(revenue) AS m, stddev_pop(revenue) AS s"))
def n1_train(spark, sf_dir):
    df = folds.ordered_split(prio(spark, sf_dir), 0.5)
    return scaling.standard_scale(df, DAILY, ["revenue"], fit_on="train").select(
        "series", day("ts"), r("revenue", "revenue", 6))


@query("n2_minmax_scale", _scale_sql("", "(revenue - lo) / (hi - lo)", "min(revenue) AS lo, max(revenue) AS hi"))
def n2(spark, sf_dir):
    return scaling.minmax_scale(prio(spark, sf_dir), DAILY, ["revenue"]).select(
        "series", day("ts"), r("revenue", "revenue", 6))


@query("n3_minmax_inverse", with_views("prio", f"SELECT series, {days('ts')}, {rs('revenue', 'revenue', 3)} FROM prio"))
def n3(spark, sf_dir):
    df = prio(spark, sf_dir)
    params = scaling.minmax_params(df, ["series"], ["revenue"])
    scaled = scaling.minmax_scale(df, DAILY, ["revenue"])
    return scaling.minmax_inverse(scaled, params, DAILY, "revenue", ["revenue"]).select(
        "series", day("ts"), r("revenue", "revenue", 3))


# ---- aggregates --------------------------------------------------------------------------------

def _weekly_sql(year: str) -> str:
    return with_views("production", f"""SELECT product, {year} || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS year_week,
    {rs("avg(quantity)", "quantity", 6)}, {rs("avg(price)", "price", 3)}, {rs("avg(discount)", "discount", 7)}, {rs("avg(failure)", "failure", 6)}
    FROM production GROUP BY product, {year}, week(ts)""")


def _weekly_out(df):
    return df.select("product", "year_week", r("quantity", "quantity", 6), r("price", "price", 3),
                     r("discount", "discount", 7), r("failure", "failure", 6))


@query("a1_weekly_mean", _weekly_sql("year(ts)"))
def a1(spark, sf_dir):
    return _weekly_out(agg.weekly_mean(production(spark, sf_dir), ["product"], "ts", [*MEASURES, "failure"]))


@query("a1_weekly_mean_iso", _weekly_sql("isoyear(ts)"))
def a1_iso(spark, sf_dir):
    return _weekly_out(agg.weekly_mean(production(spark, sf_dir), ["product"], "ts", [*MEASURES, "failure"], "iso_year"))


@query("a2_summary", with_views("production", f"""SELECT product, {rs("avg(price)", "mean", 3)}, {rs("median(price)", "median", 3)},
    {rs("stddev_samp(price)", "std", 3)}, {rs("min(price)", "min")}, {rs("max(price)", "max")} FROM production GROUP BY 1"""))
def a2(spark, sf_dir):
    s = agg.summary(production(spark, sf_dir), "price", ["product"])
    return s.select("product", r("mean", "mean", 3), r("median", "median", 3), r("std", "std", 3), r("min", "min"), r("max", "max"))


@query("a3_describe", f"""SELECT count(l_extendedprice) AS "count", {rs("avg(l_extendedprice)", "mean", 3)},
    {rs("stddev_samp(l_extendedprice)", "std", 3)}, {rs("min(l_extendedprice)", "min")},
    {rs("quantile_cont(l_extendedprice, 0.25)", "q25", 3)}, {rs("quantile_cont(l_extendedprice, 0.5)", "q50", 3)},
    {rs("quantile_cont(l_extendedprice, 0.75)", "q75", 3)}, {rs("max(l_extendedprice)", "max")} FROM lineitem""")
def a3(spark, sf_dir):
    d = agg.describe(load(spark, sf_dir, "lineitem"), "l_extendedprice")
    return d.select("count", r("mean", "mean", 3), r("std", "std", 3), r("min", "min"), r("q25", "q25", 3),
                    r("q50", "q50", 3), r("q75", "q75", 3), r("max", "max"))


@query("a4_null_profile", """SELECT * FROM (SELECT 'v' AS "column", count(*) AS missing FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'user_id', count(*) FROM events WHERE user_id % 5 = 0
    UNION ALL SELECT 'kind', count(*) FROM events WHERE event_type = 'view'
    UNION ALL SELECT 'half', count(*) FROM events WHERE event_type = 'error' OR event_id % 2 = 0) WHERE missing > 0""")
def a4(spark, sf_dir):
    # nulls in several columns, and a column with nulls and NaN
    e = load(spark, sf_dir, "events")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return agg.null_profile(e.select(
        "event_id", value.alias("v"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"),
        F.nullif("event_type", F.lit("view")).alias("kind"),
        F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(value).alias("half")))


@query("a5_profile", f"""SELECT l_returnflag, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols, {days("min(l_shipdate)", "first_ts")},
    {days("max(l_shipdate)", "last_ts")} FROM lineitem GROUP BY 1""")
def a5(spark, sf_dir):
    p = agg.profile(load(spark, sf_dir, "lineitem"), "l_shipdate", ["l_returnflag"])
    return p.select("l_returnflag", "n_rows", "n_cols", day("first_ts", "first_ts"), day("last_ts", "last_ts"))


@query("a6_distinct_keys", "SELECT DISTINCT l_partkey AS part_id FROM lineitem")
def a6(spark, sf_dir):
    return agg.distinct_keys(load(spark, sf_dir, "lineitem"), "l_partkey").withColumnRenamed("l_partkey", "part_id")


@query("a7_problem_type", with_views("production", """SELECT product, count(DISTINCT discount) AS n_distinct,
    CASE WHEN count(DISTINCT discount) <= 10 THEN 'classification' ELSE 'regression' END AS problem FROM production GROUP BY 1
    UNION ALL SELECT 'labels', count(DISTINCT label), 'classification' FROM embeddings"""))
def a7(spark, sf_dir):
    labels = agg.problem_type(load(spark, sf_dir, "embeddings"), "label").select(
        F.lit("labels").alias("product"), "n_distinct", "problem")
    return agg.problem_type(production(spark, sf_dir), "discount", ["product"]).unionByName(labels)


@query("a8_target_correlations", with_views("gaps production", f"""SELECT product AS series, 'price' AS feature, {rs("corr(price, failure)", "corr", 6)},
    count(*) AS n FROM production GROUP BY 1 UNION ALL SELECT product, 'quantity', {rs("corr(quantity, failure)", "corr", 6)}, count(*)
    FROM production GROUP BY 1 UNION ALL SELECT 'events', 'rn', {rs("corr(rn, v)", "corr", 6)}, count(v) FROM gaps"""))
def a8(spark, sf_dir):
    parts = agg.target_correlations(production(spark, sf_dir), "failure", ["price", "quantity"], ["product"])
    events = agg.target_correlations(gaps(spark, sf_dir), "v", ["rn"])
    return parts.select(F.col("product").alias("series"), "feature", r("corr", "corr", 6), "n").unionByName(
        events.select(F.lit("events").alias("series"), "feature", r("corr", "corr", 6), "n"))


CORR = """corrs AS (SELECT 'sold' AS feature, corr(sold, revenue) AS corr FROM cal UNION ALL SELECT 'avg_price', corr(avg_price, revenue) FROM cal
    UNION ALL SELECT 'urgent', corr(urgent, revenue) FROM cal UNION ALL SELECT 'month', corr(month(ts), revenue) FROM cal
    UNION ALL SELECT 'day_of_week', corr(isodow(ts) - 1, revenue) FROM cal UNION ALL SELECT 'day_of_year', corr(dayofyear(ts), revenue) FROM cal
    UNION ALL SELECT 'week_of_year', corr(week(ts), revenue) FROM cal)"""


@query("t3_top_correlations", with_views("daily", f"""cal AS (SELECT * FROM daily), {CORR}
    SELECT * FROM (SELECT 'positive' AS kind, feature, {rs("corr", "corr", 6)} FROM corrs ORDER BY corrs.corr DESC, feature LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'negative', feature, {rs("corr", "corr", 6)} FROM corrs ORDER BY corrs.corr, feature LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'absolute', feature, {rs("corr", "corr", 6)} FROM corrs ORDER BY abs(corrs.corr) DESC, feature LIMIT 5)"""))
def t3(spark, sf_dir):
    from tidemark.functions.calendar import calendar_features
    from tidemark.operators.columns import numeric_columns
    df = calendar_features(daily_sales(spark, sf_dir), "ts")
    corr = agg.target_correlations(df, "revenue", numeric_columns(df))
    parts = [agg.top_correlations(corr, "revenue", 5, kind).select(
        F.lit(kind).alias("kind"), "feature", r("corr", "corr", 6)) for kind in ("positive", "negative", "absolute")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fold_forecasts(spark, sf_dir):
    """Test rows of the folds, forecast by the previous value."""
    df = ordered.lags(prio(spark, sf_dir), DAILY, "revenue", [1], "prev")
    return folds.expanding_folds(df).filter("role = 'test'").select(
        "series", "fold", "rn", "ts", F.col("revenue").alias("actual"), F.col("prev1").alias("predicted"))


METRICS = """metrics AS (SELECT series, fold, count(*) AS n, avg((revenue - prev) ** 2) AS mse, sqrt(avg((revenue - prev) ** 2)) AS rmse,
    avg(abs(revenue - prev)) AS mae, 1 - sum((revenue - prev) ** 2) / (var_pop(revenue) * count(*)) AS r2,
    avg(abs((revenue - prev) / (revenue + 1e-8))) * 100 AS mape FROM folds WHERE role = 'test' GROUP BY 1, 2)"""


@query("a9_regression_metrics", with_views("prio", f"""{FOLDS}, {METRICS} SELECT series, CAST(fold AS INT) AS fold, n, {rs("mse / 1e6", "mse")}, {rs("rmse", "rmse", 3)},
    {rs("mae", "mae", 3)} FROM metrics"""))
def a9(spark, sf_dir):
    m = metrics.regression_metrics(fold_forecasts(spark, sf_dir), ["series", "fold"])
    return m.select("series", "fold", "n", r(F.col("mse") / 1e6, "mse"), r("rmse", "rmse", 3), r("mae", "mae", 3))


@query("a10_r_squared", with_views("prio", f"{FOLDS}, {METRICS} SELECT series, CAST(fold AS INT) AS fold, {rs('r2', 'r2', 6)} FROM metrics"))
def a10(spark, sf_dir):
    return metrics.regression_metrics(fold_forecasts(spark, sf_dir), ["series", "fold"]).select(
        "series", "fold", r("r2", "r2", 6))


@query("a11_mape", with_views("prio", f"{FOLDS}, {METRICS} SELECT series, CAST(fold AS INT) AS fold, {rs('mape', 'mape', 4)} FROM metrics"))
def a11(spark, sf_dir):
    return metrics.regression_metrics(fold_forecasts(spark, sf_dir), ["series", "fold"]).select(
        "series", "fold", r("mape", "mape", 4))


@query("a12_mae_percent", with_views("prio", f"""{FOLDS}, {METRICS} SELECT m.series, {rs("m.mae", "avg_mae", 3)}, {rs("t.mean", "target_mean", 3)},
    {rs("m.mae / t.mean * 100", "mae_percent", 6)} FROM (SELECT series, avg(mae) AS mae FROM metrics GROUP BY 1) m
    JOIN (SELECT series, avg(revenue) AS mean FROM prio GROUP BY 1) t ON m.series = t.series"""))
def a12(spark, sf_dir):
    m = metrics.regression_metrics(fold_forecasts(spark, sf_dir), ["series", "fold"])
    out = metrics.mae_percent(m, priority_sales(spark, sf_dir), "revenue", ["series"])
    return out.select("series", r("avg_mae", "avg_mae", 3), r("target_mean", "target_mean", 3),
                      r("mae_percent", "mae_percent", 6))


@query("a13_accuracy", f"SELECT {rs('avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END)', 'accuracy', 6)}, count(*) AS n FROM labels")
def a13(spark, sf_dir):
    df = load(spark, sf_dir, "labels").select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted"))
    return metrics.accuracy(df).select(r("accuracy", "accuracy", 6), "n")


@query("a14_fold_summary", with_views("prio", f"""{FOLDS}, {METRICS} SELECT series, metric, {rs("avg(v)", "mean", 3)}, {rs("stddev_pop(v)", "std", 3)} FROM (
    SELECT series, 'mse' AS metric, mse / 1e6 AS v FROM metrics UNION ALL SELECT series, 'mae', mae FROM metrics
    UNION ALL SELECT series, 'rmse', rmse FROM metrics UNION ALL SELECT series, 'r2', r2 FROM metrics) GROUP BY 1, 2"""))
def a14(spark, sf_dir):
    m = metrics.regression_metrics(fold_forecasts(spark, sf_dir), ["series", "fold"]).withColumn("mse", F.col("mse") / 1e6)
    return metrics.fold_summary(m, ["mse", "mae", "rmse", "r2"], ["series"]).select(
        "series", "metric", r("mean", "mean", 3), r("std", "std", 3))


@query("a15_batch_mean_loss", with_views("gaps", f"""SELECT user_id, {rs("avg(m)", "loss")}, count(*) AS batches FROM (SELECT user_id,
    avg(coalesce(v, 0) * coalesce(v, 0)) AS m FROM gaps WHERE rn < n GROUP BY user_id, floor((rn - 1) / 25)) GROUP BY 1"""))
def a15(spark, sf_dir):
    df = gap_events(spark, sf_dir).withColumn("loss", F.coalesce("v", F.lit(0.0)) * F.coalesce("v", F.lit(0.0)))
    return metrics.batch_mean_loss(df, EVENTS, "loss", 25).select("user_id", r("loss", "loss"), "batches")


TYPES = Series(("event_type",), ("ts", "event_id"), BLOCK_ROWS, "date_trunc('hour', ts)")


@query("a15_batches_of_1000", f"""WITH e AS (SELECT event_type, coalesce(value, 0) ** 2 AS l, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
    count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, {rs("avg(m)", "loss", 3)}, count(*) AS batches FROM (SELECT event_type, avg(l) AS m FROM e WHERE rn < n GROUP BY event_type, floor((rn - 1) / 1000)) GROUP BY 1""")
def a15_wide(spark, sf_dir):
    value = F.coalesce("value", F.lit(0.0))
    df = load(spark, sf_dir, "events").select("event_type", "ts", "event_id", (value * value).alias("loss"))
    return metrics.batch_mean_loss(df, TYPES, "loss").select("event_type", r("loss", "loss", 3), "batches")


@query("a8_pairwise_correlations", f"""WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings),
    w AS (SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN (vec_id * 7 + i) % 5 = 0 THEN NULL ELSE CAST(x AS DOUBLE) END AS x FROM v)
    SELECT a.i, b.i AS j, {rs("corr(a.x, b.x)", "corr", 6)}, count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS n
    FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2""")
def a8_pairs(spark, sf_dir):
    # 64 columns with a fifth of the values missing
    df = load(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x, i: F.when(
        (F.col("vec_id") * 7 + i) % 5 != 0, x.cast("double"))).alias("v"))
    return agg.pairwise_correlations(df, "v", 64).select("i", "j", r("corr", "corr", 6), "n")


@query("a19_density_histogram", with_views("production", f"""p AS (SELECT product, price FROM production UNION ALL SELECT 'constant', 5.0 FROM production WHERE part_id < 50),
    s0 AS (SELECT product, min(price) AS lo, max(price) AS hi, count(*) AS n, avg(price) AS mu, stddev_samp(price) AS sd FROM p GROUP BY 1),
    s AS (SELECT product, CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END AS lo, CASE WHEN hi > lo THEN hi ELSE hi + 0.5 END AS hi, n, mu, nullif(sd, 0) AS sd FROM s0),
    h AS (SELECT p.product, least(floor((price - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS c FROM p JOIN s ON p.product = s.product GROUP BY ALL),
    b AS (SELECT s.*, t.bin, coalesce(c, 0) AS c FROM s CROSS JOIN range(20) t(bin) LEFT JOIN h ON h.product = s.product AND h.bin = t.bin)
    SELECT product, {bigs("bin", "bin")}, {rs("lo + bin * ((hi - lo) / 20)", "bin_start", 5)}, {bigs("c", "count")}, {rs("c / (n * ((hi - lo) / 20)) * 1e6", "density", 4)},
    {rs("exp(-(((lo + (bin + 0.5) * ((hi - lo) / 20) - mu) / sd) ** 2) / 2) / (sd * sqrt(2 * pi())) * 1e6", "normal_density", 4)} FROM b"""))
def a19(spark, sf_dir):
    rows = production(spark, sf_dir)
    more = rows.filter("part_id < 50").select(F.lit("constant").alias("product"), F.lit(5.0).alias("price"))
    h = agg.density_histogram(rows.select("product", "price").union(more), "price", 20, ["product"])
    return h.select("product", big("bin", "bin"), r("bin_start", "bin_start", 5), "count",
                    r(F.col("density") * 1e6, "density", 4), r(F.col("normal_density") * 1e6, "normal_density", 4))


@query("a21_actual_range", with_views("prio", f"""{FOLDS} SELECT series, {rs("min(revenue)", "min_actual")}, {rs("max(revenue)", "max_actual")}
    FROM folds WHERE role = 'test' GROUP BY 1"""))
def a21(spark, sf_dir):
    return metrics.actual_range(fold_forecasts(spark, sf_dir), ["series"]).select(
        "series", r("min_actual", "min_actual"), r("max_actual", "max_actual"))


@query("a22_split_counts", with_views("gaps", """SELECT split, event_type, count(*) AS "rows" FROM (SELECT e.event_type,
    CASE WHEN g.rn <= floor(g.n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM gaps g JOIN events e ON g.event_id = e.event_id) GROUP BY 1, 2"""))
def a22(spark, sf_dir):
    df = folds.ordered_split(positions(load(spark, sf_dir, "events"), EVENTS), 0.7)
    return metrics.split_counts(df, extra=["event_type"]).select("split", "event_type", "rows")


# ---- the flagship: weekly means, AR(1) on the first part, one-step forecasts on the rest --------

@query("weekly_ar1_backtest", with_views("production weekly", f"""l AS (SELECT *, lag(quantity) OVER (PARTITION BY product ORDER BY rn) AS prev FROM weekly),
    b AS (SELECT product, regr_slope(quantity, prev) AS slope, regr_intercept(quantity, prev) AS icept FROM l WHERE rn <= floor(n * 0.7::DOUBLE) GROUP BY 1)
    SELECT l.product, count(*) AS n, {rs("avg((quantity - icept - slope * prev) ** 2)", "mse")}, {rs("sqrt(avg((quantity - icept - slope * prev) ** 2))", "rmse")},
    {rs("avg(abs(quantity - icept - slope * prev))", "mae")},
    {rs("1 - sum((quantity - icept - slope * prev) ** 2) / (var_pop(quantity) * count(*))", "r2")} FROM l JOIN b ON l.product = b.product
    WHERE rn > floor(n * 0.7::DOUBLE) GROUP BY 1"""))
def weekly_ar1(spark, sf_dir):
    df = ordered.lags(weekly(spark, sf_dir), WEEKLY, "quantity", [1], "prev")
    df = folds.ordered_split(df, 0.7)
    fit = df.filter("split = 'train'").groupBy("product").agg(
        F.regr_slope("quantity", "prev1").alias("slope"), F.regr_intercept("quantity", "prev1").alias("icept"))
    scored = ordered.attach(df.filter("split = 'test'"), fit, ["product"], ["year", "week"]).select(
        "product", F.col("quantity").alias("actual"),
        (F.col("icept") + F.col("slope") * F.col("prev1")).alias("predicted"))
    m = metrics.regression_metrics(scored, ["product"])
    return m.select("product", "n", r("mse", "mse"), r("rmse", "rmse"), r("mae", "mae"), r("r2", "r2"))
