"""Components, window regressors, search, attribution and the sinks that hold their results."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.functions.scalars import step_names
from tidemark.operators import attribution as att
from tidemark.operators import metrics, ordered, ranking, reduction, regress, search, shapley
from tidemark.operators.columns import assemble, flatten_steps, long_steps, step_labels
from tidemark.operators.filters import head_rows, keep_keys
from tidemark.operators.folds import cut_point, ordered_split, validation_tail
from tidemark.operators.ordered import Series, attach, positions
from tidemark.plans.projections import WINDOW_STEPS, sampled_parts
from tidemark.plans.registry import big, day, days, least_squares, query, r, rs
from tidemark.plans.series import prio, test_period, weekly_samples
from tidemark.plans.tables import DAILY, MEASURES, WEEKLY, inspection, load, production, weekly, with_views
from tidemark.sources import io
from tidemark.sources.shared import as_table, fresh_path

LENGTH = 10
IDS = ["product", "sample"]
STEP = ["product", "feature", "lag"]


# ---- principal components ----------------------------------------------------------------------

PLANE = """c AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount * 100) AS b, var_samp(l_discount * 100) AS d FROM lineitem),
    e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l2 FROM c),
    v AS (SELECT *, (l1 - d) / sqrt(b * b + (l1 - d) ** 2) AS x1, b / sqrt(b * b + (l1 - d) ** 2) AS y1,
    b / sqrt(b * b + (l2 - a) ** 2) AS x2, (l2 - a) / sqrt(b * b + (l2 - a) ** 2) AS y2 FROM e),
    s AS (SELECT *, CASE WHEN (CASE WHEN abs(x1) >= abs(y1) THEN x1 ELSE y1 END) < 0 THEN -1 ELSE 1 END AS s1,
    CASE WHEN (CASE WHEN abs(x2) >= abs(y2) THEN x2 ELSE y2 END) < 0 THEN -1 ELSE 1 END AS s2 FROM v)"""


def _plane(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("discount"))
    return assemble(li, ["l_quantity", "discount"])


@query("n4_pca_two_columns", f"""WITH {PLANE} SELECT l_orderkey, l_linenumber, {rs("s1 * (x1 * l_quantity + y1 * l_discount * 100)", "PC1")},
    {rs("s2 * (x2 * l_quantity + y2 * l_discount * 100)", "PC2")} FROM lineitem, s""")
def n4_plane(spark, sf_dir):
    rows = _plane(spark, sf_dir)
    fitted = reduction.pca(rows, "features", 2)
    return reduction.pca_scores(rows, fitted, ["l_orderkey", "l_linenumber"], 2).select(
        "l_orderkey", "l_linenumber", r("PC1", "PC1"), r("PC2", "PC2"))


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").withColumn("features", array_to_vector("embedding"))


@query("n4_pca")
def n4(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return reduction.pca_scores(rows, reduction.pca(rows, "features", 10), ["vec_id", "label"], 10)


@query("n5_pca_scores")
def n5(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return reduction.pca_scores(rows, reduction.pca(rows, "features", 10), ["label"], 3)


@query("a20_explained_variance", f"""WITH {PLANE} SELECT 'PC1' AS component, {rs("l1 / (l1 + l2)", "ratio", 6)} FROM e
    UNION ALL SELECT 'PC2', {rs("l2 / (l1 + l2)", "ratio", 6)} FROM e""")
def a20(spark, sf_dir):
    return reduction.pca(_plane(spark, sf_dir), "features", 2).explained(spark).select("component", r("ratio", "ratio", 6))


# ---- window regressors -------------------------------------------------------------------------

# windows of seven days of both inputs; revenue in 100,000 keeps the equations well scaled
LAGS7 = ", ".join(f"lag(sold, {h}) OVER w, lag(revenue, {h}) OVER w / 1e5" for h in range(7, 0, -1))
LINEAR = f"""win AS (SELECT series, rn, n, sold AS y, list_value(1.0::DOUBLE, {LAGS7}) AS x FROM prio WINDOW w AS (PARTITION BY series ORDER BY rn)),
    tr AS (SELECT 0 AS k, x, y FROM win WHERE rn > 7 AND rn - 7 <= floor((n - 7) * 0.7::DOUBLE)),
    {least_squares("fit", "tr", 15)},
    e AS (SELECT series, rn, y, list_dot_product(x, beta) AS p FROM win, fit WHERE rn > 7 AND rn - 7 > floor((n - 7) * 0.7::DOUBLE))"""


def _linear_windows(spark, sf_dir):
    model = regress.SequenceRegressor(LinearRegression(), ("sold", "revenue"), "sold", 7)
    windows = regress.sample_split(model.windows(prio(spark, sf_dir), DAILY), 7, 0.7)
    return model, windows


@query("m7_sequence_regressor_linear", with_views("prio", f"""{LINEAR} SELECT series, count(*) AS n, {rs("avg((y - p) ** 2)", "mse", 6)},
    {rs("avg(abs(y - p))", "mae", 6)} FROM e GROUP BY 1"""))
def m7_linear(spark, sf_dir):
    model, windows = _linear_windows(spark, sf_dir)
    fitted = model.fit(windows.filter("split = 'train'"))
    scored = fitted.transform(windows.filter("split = 'test'"))
    m = metrics.regression_metrics(scored, ["series"], "label", "prediction")
    return m.select("series", "n", r("mse", "mse", 6), r("mae", "mae", 6))


@query("m7_sequence_regressor_forest")
def m7_forest(spark, sf_dir):
    model = regress.SequenceRegressor(
        RandomForestRegressor(numTrees=100, maxDepth=4, seed=42), ("sold", "revenue"), "revenue", 7)
    windows = regress.sample_split(model.windows(prio(spark, sf_dir), DAILY), 7, 0.7)
    fitted = model.fit(windows.filter("split = 'train'"))
    return metrics.regression_metrics(
        fitted.transform(windows.filter("split = 'test'")), ["series"], "label", "prediction")


@query("m8_early_stopped_boosting")
def m8(spark, sf_dir):
    gbt = regress.stopped_boosting(maxIter=20, maxDepth=3, seed=42, tolerance=0.01)
    model = regress.SequenceRegressor(gbt, ("sold",), "sold", 7)
    windows = ordered_split(model.windows(prio(spark, sf_dir), DAILY), 0.7)
    train = validation_tail(windows.filter("split = 'train'").withColumn("train_n", cut_point(0.7)))
    fitted = model.fit(train)
    scored = fitted.transform(windows.filter("split = 'test'").withColumn("is_validation", F.lit(False)))
    return metrics.regression_metrics(scored, ["series"], "label", "prediction").withColumn(
        "trees", F.lit(fitted.stages[0].getNumTrees))


@query("m8_patience")
def m8_patience(spark, sf_dir):
    # the training windows but their last fifth fit, that fifth validates, the best state scores the test windows
    model = regress.SequenceRegressor(LinearRegression(), ("sold", "revenue"), "sold", 7)
    windows = regress.sample_split(model.windows(prio(spark, sf_dir), DAILY), 7, 0.7)
    marked = as_table(validation_tail(windows.withColumn("train_n", cut_point(0.7))), "windows")
    train = marked.filter("split = 'train'")
    found = regress.patient_boosting(train.filter("NOT is_validation"), train.filter("is_validation"), patience=5, rounds=64, maxDepth=3, seed=42)
    scored = found.model.transform(marked.filter("split = 'test'"))
    return metrics.regression_metrics(scored, ["series"], "label", "prediction").withColumns(
        {"trees": F.lit(found.kept), "rounds": F.lit(len(found.losses))})


SCALED7 = ", ".join(f"lag(zx, {h}) OVER w, lag(u, {h}) OVER w" for h in range(7, 0, -1))
WALK = f"""z0 AS (SELECT *, (sold - avg(sold) OVER s) / stddev_pop(sold) OVER s AS zx, min(revenue) OVER s AS lo, max(revenue) OVER s AS hi,
    n // 2 AS tr, (n - n // 2) // 3 AS size FROM prio WINDOW s AS (PARTITION BY series)),
    z AS (SELECT *, (revenue - lo) / (hi - lo) AS u FROM z0),
    l AS (SELECT *, list_value(1.0::DOUBLE, {SCALED7}) AS x FROM z WINDOW w AS (PARTITION BY series ORDER BY rn)),
    f AS (SELECT l.*, fold, tr + (fold - 1) * size AS start FROM l, range(1, 4) t(fold) WHERE rn > 7),
    before AS (SELECT fold AS k, x, u AS y FROM f WHERE rn <= start),
    {least_squares("fit", "before", 15)},
    e AS (SELECT series, f.fold, revenue AS y, list_dot_product(x, beta) * (hi - lo) + lo AS p FROM f JOIN fit ON f.fold = k WHERE rn > start + 7 AND rn <= start + size)"""


@query("m9_walk_forward_ml", with_views("prio", f"""{WALK} SELECT series, CAST(fold AS INT) AS fold, count(*) AS n, {rs("sqrt(avg((y - p) ** 2))", "rmse", 2)}, {rs("avg(abs(y - p))", "mae", 2)},
    {rs("1 - sum((y - p) ** 2) / (var_pop(y) * count(*))", "r2", 6)} FROM e GROUP BY 1, 2"""))
def m9(spark, sf_dir):
    _, scores = regress.walk_forward_linear(prio(spark, sf_dir), DAILY, ["sold", "revenue"], "revenue", 7)
    return scores.select("series", "fold", "n", r("rmse", "rmse", 2), r("mae", "mae", 2), r("r2", "r2", 6))


@query("m10_auto_classifier")
def m10(spark, sf_dir):
    df = ordered.lags(prio(spark, sf_dir), DAILY, "revenue", [1], "prev").withColumn(
        "up", (F.col("revenue") > F.col("prev1")).cast("int"))
    windows = ordered_split(regress.window_vectors(df, DAILY, ["sold", "revenue"], "up", 7).filter("label IS NOT NULL"), 0.7)
    estimator = regress.auto_estimator(windows, "label", numTrees=20)
    fitted = estimator.fit(windows.filter("split = 'train'"))
    return metrics.accuracy(fitted.transform(windows.filter("split = 'test'")), ["series"], "label", "prediction")


def _sampled_rows(spark, sf_dir):
    rows = production(spark, sf_dir)
    return keep_keys(rows, sampled_parts(spark, sf_dir), "part_id", bounded=True)


@query("m11_forest")
def m11(spark, sf_dir):
    # trained on the sampled parts, scored on all
    model = regress.forest(_sampled_rows(spark, sf_dir), MEASURES, "failure")
    scored = model.transform(production(spark, sf_dir))
    return metrics.accuracy(scored, ["product"], "failure", "prediction")


OTHER7 = ", ".join(f"lag(sold, {h}) OVER w, lag(revenue, {h}) OVER w / 1e5" for h in range(7, 0, -1))


@query("m12_score_external", with_views("prio inspection", f"""{LINEAR}, o0 AS (SELECT rn, n, accepted / 250 AS sold, failed * 4000 AS revenue FROM inspection),
    o AS (SELECT rn, sold AS y, list_value(1.0::DOUBLE, {OTHER7}) AS x FROM o0 WINDOW w AS (ORDER BY rn)),
    oe AS (SELECT row_number() OVER (ORDER BY rn) AS i, count(*) OVER () AS m, y, list_dot_product(x, beta) AS p FROM o, fit WHERE rn > 7 AND y IS NOT NULL AND len(list_filter(x, lambda v: v IS NULL)) = 0),
    bm AS (SELECT avg((y - p) ** 2) AS l FROM oe WHERE i < m GROUP BY floor((i - 1) / 1000))
    SELECT 'all' AS series, (SELECT {rs("avg(l)", "loss", 4).removesuffix(" AS loss")} FROM bm) AS loss, count(*) AS n, {rs("avg((y - p) ** 2)", "mse", 4)},
    {rs("1 - sum((y - p) ** 2) / (var_pop(y) * count(*))", "r2", 6)} FROM oe"""))
def m12(spark, sf_dir):
    model, windows = _linear_windows(spark, sf_dir)
    fitted = model.fit(windows.filter("split = 'train'"))
    other = positions(inspection(spark, sf_dir), DAILY).withColumn("sold", F.col("accepted") / 250).withColumn("revenue", F.col("failed") * 4000)
    new = model.windows(other, DAILY)
    loss, scores = regress.score_external(fitted, new, DAILY)
    return loss.join(scores, "series").select("series", r("loss", "loss", 4), "n", r("mse", "mse", 4), r("r2", "r2", 6))


SEARCH_SPACE = {
    "sequence_length": search.categorical(7, 14, 21),
    "regParam": search.categorical(0.0001, 0.001, 0.01),
    "elasticNetParam": search.stepped(0.1, 0.5, 0.1),
    "maxIter": search.categorical(50, 100),
}


def _elastic(params):
    return LinearRegression(regParam=params["regParam"], elasticNetParam=params["elasticNetParam"],
                            maxIter=params["maxIter"])


@query("m13_random_search")
def m13(spark, sf_dir):
    df = as_table(prio(spark, sf_dir), "series")
    return search.random_search(df, DAILY, ["sold", "revenue"], "revenue", SEARCH_SPACE, _elastic, n_trials=10, seed=42)


@query("m14_fixed_run", with_views("prio", f"""{WALK}, m AS (SELECT series, fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse,
    1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY 1, 2)
    SELECT 'mae' AS metric, {rs("avg(mae)", "mean", 2)}, {rs("stddev_pop(mae)", "std", 2)} FROM m
    UNION ALL SELECT 'rmse', {rs("avg(rmse)", "mean", 2)}, {rs("stddev_pop(rmse)", "std", 2)} FROM m
    UNION ALL SELECT 'r2', {rs("avg(r2)", "mean", 2)}, {rs("stddev_pop(r2)", "std", 2)} FROM m"""))
def m14(spark, sf_dir):
    params = {"sequence_length": 7, "regParam": 0.0, "elasticNetParam": 0.0, "maxIter": 100}
    out = search.run(prio(spark, sf_dir), DAILY, ["sold", "revenue"], "revenue", params, _elastic)
    return out.filter("metric <> 'mse'").select("metric", r("mean", "mean", 2), r("std", "std", 2))


TRIALS = """tr AS (SELECT series, len AS sequence_length, sqrt(avg((a.revenue - b.revenue) ** 2)) AS rmse FROM (SELECT * FROM prio, (VALUES (7), (14), (21)) v(len)) a
    JOIN prio b USING (series) WHERE b.rn = a.rn - a.len AND a.rn > floor(a.n * 0.5) GROUP BY 1, 2),
    best AS (SELECT series, arg_min(sequence_length, rmse) AS sequence_length, min(rmse) AS rmse FROM tr GROUP BY 1)"""


def _naive_trials(spark, sf_dir):
    """Seasonal naive forecasts with three lengths, one trial per series and length."""
    df = ordered.lags(prio(spark, sf_dir), DAILY, "revenue", [7, 14, 21], "p").filter(F.col("rn") > cut_point(0.5))
    rows = ranking.grid({"sequence_length": [7, 14, 21]}, df).withColumn(
        "predicted", F.coalesce(*[F.when(F.col("sequence_length") == n, F.col(f"p{n}")) for n in (7, 14, 21)]))
    scores = metrics.regression_metrics(rows, ["series", "sequence_length"], "revenue")
    return scores.select("series", F.col("sequence_length").alias("trial"), "sequence_length", "rmse")


@query("t7_best_trial", with_views("prio", f"{TRIALS} SELECT series, sequence_length, {rs('rmse', 'rmse', 3)} FROM best"))
def t7(spark, sf_dir):
    return search.best_trial(_naive_trials(spark, sf_dir), ["series"]).select("series", "sequence_length", r("rmse", "rmse", 3))


# ---- attribution -------------------------------------------------------------------------------

PHI = f"""{WINDOW_STEPS},
    tall AS (SELECT product, sample, lag, CAST(floor((n - 10) * 0.7::DOUBLE) AS BIGINT) AS nt, year_week, label, unnest(['quantity', 'price', 'discount', 'tax']) AS feature,
    unnest([quantity, price, discount, tax]) AS value FROM steps),
    coef AS (SELECT product, feature, lag, regr_slope(label, value) AS beta FROM tall WHERE sample <= nt GROUP BY 1, 2, 3),
    base AS (SELECT product, feature, lag, avg(value) AS base FROM tall WHERE sample > nt GROUP BY 1, 2, 3),
    phi AS (SELECT t.product, t.sample, t.feature, t.lag, t.value, t.year_week, beta * base AS expected, beta * (value - base) AS phi FROM tall t
    JOIN coef c ON t.product = c.product AND t.feature = c.feature AND t.lag = c.lag
    JOIN base b ON t.product = b.product AND t.feature = b.feature AND t.lag = b.lag WHERE t.sample > nt)"""


def linear_phi(spark, sf_dir):
    """Attribution of a linear scorer with one slope per (product, feature, lag): all test windows, against all of them."""
    tall = long_steps(weekly_samples(spark, sf_dir), MEASURES, LENGTH, [*IDS, "split", "year_week", "label"])
    slopes = tall.filter("split = 'train'").groupBy(*STEP).agg(F.regr_slope("label", "value").alias("beta"))
    test = tall.filter("split = 'test'")
    return att.shapley_linear(test, slopes, test.select(*STEP, "value"), STEP, ["sample"])


@query("x1_shapley_linear", with_views("production weekly", f"""{PHI} SELECT product, sample, feature, CAST(lag AS INT) AS lag, {rs("phi * 1000", "phi", 6)} FROM phi"""))
def x1(spark, sf_dir):
    return linear_phi(spark, sf_dir).select(
        "product", "sample", "feature", F.col("lag").cast("int").alias("lag"), r(F.col("phi") * 1000, "phi", 6))


@query("a16_attribution_summary", with_views("production weekly", f"""{PHI} SELECT product, feature, CAST(lag AS INT) AS lag, {rs("avg(phi) * 1000", "mean_phi", 6)},
    {rs("stddev_pop(phi) * 1000", "std_phi", 6)}, {rs("avg(abs(phi)) * 1000", "mean_abs_phi", 6)} FROM phi GROUP BY 1, 2, 3"""))
def a16(spark, sf_dir):
    s = att.attribution_summary(linear_phi(spark, sf_dir), STEP)
    return s.select("product", "feature", F.col("lag").cast("int").alias("lag"),
                    *[r(F.col(c) * 1000, c, 6) for c in ("mean_phi", "std_phi", "mean_abs_phi")])


BY_FEATURE = """imp AS (SELECT product, feature, avg(m) AS importance FROM (SELECT product, feature, lag, avg(abs(phi)) AS m FROM phi GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("a17_attribution_by_feature", with_views("production weekly", f"""{PHI}, {BY_FEATURE} SELECT product, feature, {rs("importance * 1000", "importance", 6)} FROM imp"""))
def a17(spark, sf_dir):
    return att.attribution_by_feature(linear_phi(spark, sf_dir), ["product"]).select(
        "product", "feature", r(F.col("importance") * 1000, "importance", 6))


@query("a18_attribution_by_lag", with_views("production weekly", f"""{PHI}, {BY_FEATURE}, top AS (SELECT product, feature FROM imp
    QUALIFY row_number() OVER (PARTITION BY product ORDER BY importance DESC, feature) <= 3)
    SELECT product, feature, CAST(lag AS INT) AS lag, {rs("avg(abs(phi)) * 1000", "mean_abs_phi", 6)} FROM phi SEMI JOIN top USING (product, feature) GROUP BY 1, 2, 3"""))
def a18(spark, sf_dir):
    return att.attribution_by_lag(linear_phi(spark, sf_dir), ["product"], 3).select(
        "product", "feature", F.col("lag").cast("int").alias("lag"), r(F.col("mean_abs_phi") * 1000, "mean_abs_phi", 6))


@query("t4_top_attributions", with_views("production weekly", f"""{PHI} SELECT feature || '_t-' || lag AS name, product, {rs("m * 1000", "mean_abs_phi", 6)} FROM (
    SELECT product, feature, lag, avg(abs(phi)) AS m FROM phi GROUP BY 1, 2, 3) ORDER BY m DESC, product, feature, lag LIMIT 10"""))
def t4_phi(spark, sf_dir):
    s = att.attribution_summary(linear_phi(spark, sf_dir), STEP)
    top = ranking.top_k(s, "mean_abs_phi", 10, ties=["product", "feature", "lag"])
    return step_labels(top).select("name", "product", r(F.col("mean_abs_phi") * 1000, "mean_abs_phi", 6))


@query("x5_dependence", with_views("production weekly", f"""{PHI}, top AS (SELECT product, feature FROM (SELECT product, feature, avg(abs(phi)) AS m FROM phi GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY product ORDER BY m DESC, feature) <= 3)
    SELECT product, sample, feature, CAST(lag AS INT) AS lag, {rs("value", "value")}, {rs("phi * 1000", "phi", 6)} FROM phi SEMI JOIN top USING (product, feature)"""))
def x5(spark, sf_dir):
    return att.dependence(linear_phi(spark, sf_dir), ["product"], 3).select(
        "product", "sample", "feature", F.col("lag").cast("int").alias("lag"), r("value", "value"), r(F.col("phi") * 1000, "phi", 6))


@query("x6_ranking", with_views("production weekly", f"""{PHI}, {BY_FEATURE} SELECT product, feature,
    CAST(row_number() OVER (PARTITION BY product ORDER BY importance DESC, feature) AS INT) AS rank FROM imp"""))
def x6(spark, sf_dir):
    from pyspark.sql import Window
    imp = att.attribution_by_feature(linear_phi(spark, sf_dir), ["product"])
    # one row per input column of a product
    w = Window.partitionBy("product").orderBy(F.col("importance").desc(), "feature")
    return imp.select("product", "feature", F.row_number().over(w).alias("rank"))


def _window_rows(spark, sf_dir):
    """Weekly windows, and the test windows of each product as background; a product's weeks are bounded by the calendar."""
    seq = flatten_steps(weekly_samples(spark, sf_dir), MEASURES).select(
        *IDS, "split", F.col("label").cast("double").alias("label"), "features")
    seq = as_table(seq, "windows")
    return seq, shapley.background_table(seq.filter("split = 'test'"), ["product"], ["sample"], block_rows=None)


# each test window takes part in the background of its product
WINDOW_DRAWS = """bg AS (SELECT product, lag, feature, sample, value, dense_rank() OVER (PARTITION BY product, feature, lag ORDER BY sample) - 1 AS no,
    count(*) OVER (PARTITION BY product, feature, lag) AS size FROM tall WHERE sample > nt),
    drawn AS (SELECT b.product, b.sample, feature, lag, value, CAST('0x' || md5(concat_ws('-', {seed}, product, sample, k))[1:15] AS BIGINT) % size AS no
    FROM bg b, range({draws}) t(k)),
    means AS (SELECT d.product, d.sample, d.feature, d.lag, d.value, avg(b.value) AS mean FROM drawn d JOIN bg b
    ON b.product = d.product AND b.feature = d.feature AND b.lag = d.lag AND b.no = d.no GROUP BY ALL),
    slopes AS (SELECT *, CASE feature WHEN 'quantity' THEN 1 WHEN 'price' THEN -0.001 WHEN 'discount' THEN 30 ELSE -20 END * (11 - lag) AS beta FROM means)"""
SLOPES = {"quantity": 1.0, "price": -0.001, "discount": 30.0, "tax": -20.0}


def _additive_score(df):
    """A scorer of all 40 window inputs that is known in closed form; the inputs come oldest step first."""
    betas = [SLOPES[m] * (11 - lag) for lag in range(LENGTH - 1, -1, -1) for m in MEASURES]
    weights = F.split(F.lit(",".join(map(repr, betas))), ",").cast("array<double>")
    products = F.zip_with(vector_to_array("features"), weights, lambda x, b: x * b)
    return df.withColumn("fx", F.array(F.aggregate(products, F.lit(0.0), lambda a, x: a + x)))


@query("x2_coalitions", with_views("production weekly", f"""{PHI}, {WINDOW_DRAWS.format(seed=3, draws=8)} SELECT product, sample, feature, CAST(lag AS INT) AS lag,
    {rs("beta * (value - mean)", "phi", 3)}, {rs("sum(beta * mean) OVER (PARTITION BY product, sample)", "base_value", 2)},
    {rs("sum(beta * value) OVER (PARTITION BY product, sample)", "fx", 2)} FROM slopes"""))
def x2_coalitions(spark, sf_dir):
    # 40 inputs: weighted coalitions in place of all 2^40
    seq, background = _window_rows(spark, sf_dir)
    phi = shapley.shapley(seq.filter("split = 'test'"), background, IDS, ["product"], step_names(MEASURES, LENGTH),
                          _additive_score, draws=8, budget=240, seed=3)
    return shapley.split_step_names(phi).select(*IDS, "feature", "lag", r("phi", "phi", 3), r("base_value", "base_value", 2), r("fx", "fx", 2))


@query("x2_orders", with_views("production weekly", f"""{PHI}, {WINDOW_DRAWS.format(seed=5, draws=32)} SELECT product, sample, feature, CAST(lag AS INT) AS lag,
    {rs("beta * (value - mean)", "phi", 3)}, {rs("sum(beta * mean) OVER (PARTITION BY product, sample)", "base_value", 2)},
    {rs("sum(beta * value) OVER (PARTITION BY product, sample)", "fx", 2)} FROM slopes"""))
def x2_orders(spark, sf_dir):
    # 32 orders, each with a background row of its own
    seq, background = _window_rows(spark, sf_dir)
    phi = shapley.shapley_sampled(seq.filter("split = 'test'"), background, IDS, ["product"], step_names(MEASURES, LENGTH),
                                  _additive_score, n_perm=32, seed=5)
    return shapley.split_step_names(phi).select(*IDS, "feature", "lag", r("phi", "phi", 3), r("base_value", "base_value", 2), r("fx", "fx", 2))


@query("x2_shapley_sampled")
def x2(spark, sf_dir):
    seq, background = _window_rows(spark, sf_dir)
    model = RandomForestRegressor(numTrees=100, maxDepth=4, seed=42).fit(seq.filter("split = 'train'"))
    phi = shapley.shapley_sampled(seq.filter("split = 'test'"), background, IDS, ["product"], step_names(MEASURES, LENGTH),
                                  shapley.regression_score(model), n_perm=32, seed=1)
    return shapley.split_step_names(phi)


@query("x2_additivity", with_views("production weekly", f"""SELECT product, rn - 10 AS sample, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS fx_gap, 40::BIGINT AS inputs FROM weekly
    WHERE rn - 10 > floor((n - 10) * 0.7::DOUBLE)"""))
def x2_additivity(spark, sf_dir):
    # the values of a row add up to its prediction minus its mean background prediction
    seq, background = _window_rows(spark, sf_dir)
    model = LinearRegression(regParam=0.01).fit(seq.filter("split = 'train'"))
    rows = seq.filter("split = 'test'")
    phi = shapley.shapley_sampled(rows, background, IDS, ["product"], step_names(MEASURES, LENGTH),
                                  shapley.regression_score(model), n_perm=4, seed=1)
    sums = phi.groupBy(*IDS).agg(F.sum("phi").alias("total"), F.max("fx").alias("fx"),
                                 F.max("base_value").alias("base"), F.count(F.lit(1)).alias("inputs"))
    scored = model.transform(rows).select(*IDS, "prediction")
    return sums.join(scored, IDS).select(*IDS, r(F.col("total") - F.col("fx") + F.col("base"), "gap", 6),
                                         r(F.col("fx") - F.col("prediction"), "fx_gap", 6), "inputs")


def _forest_phi(spark, sf_dir, trees=100):
    rows = assemble(_sampled_rows(spark, sf_dir), MEASURES).withColumn(
        "row_id", F.concat_ws("-", "part_id", "l_orderkey", "l_linenumber", "price"))
    rows = as_table(rows.select("row_id", "failure", "features", F.lit(0).alias("all")), "rows")
    model = RandomForestClassifier(labelCol="failure", numTrees=trees, maxDepth=4, seed=42).fit(rows)
    background = shapley.background_table(rows, ["all"], ["row_id"])
    return shapley.shapley_exact(rows, background, ["row_id"], ["all"], MEASURES, shapley.class_score(model), outputs=2)


POLYNOMIAL = """keys AS (SELECT DISTINCT p_partkey AS part_id FROM part ORDER BY md5('42-' || CAST(p_partkey AS VARCHAR)), part_id LIMIT 100),
    rows AS (SELECT part_id, l_orderkey, l_linenumber, max(quantity) AS q, max(discount) AS d FROM production WHERE part_id IN (SELECT part_id FROM keys) GROUP BY 1, 2, 3),
    bg AS (SELECT q AS bq, d AS bd, row_number() OVER (ORDER BY part_id, l_orderkey, l_linenumber) - 1 AS no FROM rows),
    drawn AS (SELECT rows.*, CAST('0x' || md5(concat_ws('-', {seed}, part_id, l_orderkey, l_linenumber, k))[1:15] AS BIGINT) % (SELECT count(*) FROM rows) AS no
    FROM rows, range({draws}) t(k)),
    m AS (SELECT part_id, l_orderkey, l_linenumber, q, d, avg(bq) AS mq, avg(bd) AS md, avg(bq * bd) AS mqd FROM drawn JOIN bg USING (no) GROUP BY ALL)"""


def _polynomial(spark, sf_dir, score, explain):
    """Rows of the sampled parts explained under a scorer known in closed form, against rows drawn out of all of them."""
    rows = _sampled_rows(spark, sf_dir).groupBy("part_id", "l_orderkey", "l_linenumber").agg(
        F.max("quantity").alias("q"), F.max("discount").alias("d"))
    rows = as_table(assemble(rows, ["q", "d"]).withColumn("all", F.lit(0)), "rows")
    ids = ["part_id", "l_orderkey", "l_linenumber"]
    background = shapley.background_table(rows, ["all"], ids)
    scorer = lambda df: df.withColumn("_v", vector_to_array("features")).withColumn(
        "fx", F.array(score(F.col("_v")[0], F.col("_v")[1]))).drop("_v")
    phi = explain(rows, background, ids, ["all"], ["q", "d"], scorer)
    return phi.select(*ids, "feature", r("phi", "phi"), r("base_value", "base_value"), r("fx", "fx"))


@query("x2_linear_exact", with_views("production", f"""{POLYNOMIAL.format(seed=1, draws=32)} SELECT part_id, l_orderkey, l_linenumber, feature,
    {rs("CASE WHEN feature = 'q' THEN 2 * (q - mq) ELSE -300 * (d - md) END", "phi")}, {rs("2 * mq - 300 * md", "base_value")}, {rs("2 * q - 300 * d", "fx")}
    FROM m, (SELECT unnest(['q', 'd']) AS feature)"""))
def x2_linear(spark, sf_dir):
    # sampled orders are exact for a linear scorer
    return _polynomial(spark, sf_dir, lambda q, d: 2 * q - 300 * d,
                       lambda *a: shapley.shapley_sampled(*a, n_perm=32, seed=1))


@query("x3_product_exact", with_views("production", f"""{POLYNOMIAL.format(seed=0, draws=20)} SELECT part_id, l_orderkey, l_linenumber, feature,
    {rs("CASE WHEN feature = 'q' THEN 2 * (q - mq) + 5 * ((q * md - mqd) + (q * d - d * mq)) ELSE 5 * ((d * mq - mqd) + (q * d - q * md)) END", "phi")},
    {rs("2 * mq + 10 * mqd", "base_value")}, {rs("2 * q + 10 * q * d", "fx")}
    FROM m, (SELECT unnest(['q', 'd']) AS feature)"""))
def x3_product(spark, sf_dir):
    return _polynomial(spark, sf_dir, lambda q, d: 2 * q + 10 * q * d, shapley.shapley_exact)


@query("x3_forest_shapley")
def x3(spark, sf_dir):
    return _forest_phi(spark, sf_dir)


@query("x3_class_balance", """WITH keys AS (SELECT DISTINCT p_partkey AS part_id FROM part ORDER BY md5('42-' || CAST(p_partkey AS VARCHAR)), part_id LIMIT 100)
    SELECT CAST(count(DISTINCT concat_ws('-', l_partkey, l_orderkey, l_linenumber, l_extendedprice)) AS BIGINT) AS "rows", 0.0::DOUBLE AS worst_gap, 0.0::DOUBLE AS worst_sum
    FROM lineitem WHERE l_partkey IN (SELECT part_id FROM keys)""")
def x3_balance(spark, sf_dir):
    # per class the values add up to the prediction; over both classes they cancel
    phi = _forest_phi(spark, sf_dir)
    per_class = phi.groupBy("row_id", "output").agg(
        (F.sum("phi") - F.max("fx") + F.max("base_value")).alias("gap"), F.sum("phi").alias("total"))
    per_row = per_class.groupBy("row_id").agg(F.max(F.abs("gap")).alias("gap"), F.abs(F.sum("total")).alias("total"))
    return per_row.agg(F.count(F.lit(1)).alias("rows"), r(F.max("gap"), "worst_gap", 6), r(F.max("total"), "worst_sum", 6))


@query("x4_explain_row", with_views("production weekly", f"""{PHI}, one AS (SELECT product, min(sample) AS sample FROM phi GROUP BY 1)
    SELECT product, sample, feature || '_t-' || lag AS name, {rs("phi * 1000", "phi", 6)}, {rs("sum(expected) OVER () * 1000", "base_value", 6)}
    FROM phi JOIN one USING (product, sample) WHERE product = 'PROMO'"""))
def x4(spark, sf_dir):
    phi = step_labels(linear_phi(spark, sf_dir))
    # the scorer's mean output over the background: one term per input, the same for every sample
    first = phi.groupBy("product").agg(F.min("sample").alias("_first"))
    base = phi.join(first, "product").filter("sample = _first").groupBy("product").agg(
        F.sum(F.col("beta") * F.col("base")).alias("base_value"), F.min("_first").alias("_first"))
    parts = att.explain_row(phi, base, {"product": "PROMO"}, ["product"]).filter("sample = _first")
    return parts.select("product", "sample", "name", r(F.col("phi") * 1000, "phi", 6),
                        r(F.col("base_value") * 1000, "base_value", 6))


# ---- sinks -------------------------------------------------------------------------------------

@query("s3_csv_sink", with_views("production weekly", f"""{PHI} SELECT product, CAST(sample AS BIGINT) AS sample, {rs("max(CASE WHEN feature = 'quantity' THEN phi END) * 1000", "SHAP_quantity", 6)},
    {rs("max(CASE WHEN feature = 'price' THEN phi END) * 1000", "SHAP_price", 6)} FROM phi WHERE lag = 0 GROUP BY 1, 2"""))
def s3(spark, sf_dir):
    wide = att.wide_attribution(linear_phi(spark, sf_dir).filter("lag = 0"), IDS, MEASURES)
    path = fresh_path(spark, "attributed-rows")
    io.write_csv(wide, path)
    back = io.read_delimited(spark, path, ",", wide.schema)
    return back.select("product", big("sample", "sample"), r(F.col("SHAP_quantity") * 1000, "SHAP_quantity", 6),
                       r(F.col("SHAP_price") * 1000, "SHAP_price", 6))


@query("s4_attribution_sink", with_views("production weekly", f"""{PHI}, {BY_FEATURE}, per AS (SELECT product, arg_min(year_week, rn) || ' to ' || arg_max(year_week, rn) AS period
    FROM weekly WHERE rn > 10 AND rn - 10 > floor((n - 10) * 0.7::DOUBLE) GROUP BY 1)
    SELECT i.product AS "ProductDesignation", feature AS "Feature", {rs("importance * 1000", "SHAP_Importance", 6)}, period AS "Test_Period" FROM imp i JOIN per ON i.product = per.product"""))
def s4(spark, sf_dir):
    imp = att.attribution_by_feature(linear_phi(spark, sf_dir), ["product"])
    periods = test_period(weekly_samples(spark, sf_dir).filter("split = 'test'"))
    path = fresh_path(spark, "attribution")
    io.write_attribution(imp, periods, path)
    back = io.read_delimited(spark, path, ",", "Feature string, SHAP_Importance double, Test_Period string, ProductDesignation string")
    return back.select("ProductDesignation", "Feature", r(F.col("SHAP_Importance") * 1000, "SHAP_Importance", 6), "Test_Period")


@query("s5_predictions_sink", with_views("production weekly", f"""l AS (SELECT *, lag(quantity) OVER (PARTITION BY product ORDER BY rn) AS prev FROM weekly)
    SELECT product, year_week AS week, {rs("quantity", "actual", 6)}, {rs("prev", "predicted", 6)} FROM l WHERE rn > floor(n * 0.7::DOUBLE)"""))
def s5(spark, sf_dir):
    df = ordered.lags(weekly(spark, sf_dir), WEEKLY, "quantity", [1], "prev").filter("rn > floor(n * 0.7::DOUBLE)")
    path = fresh_path(spark, "predictions")
    io.write_predictions(df.select("product", "year_week", F.col("quantity").alias("actual"), F.col("prev1").alias("predicted")),
                         path, ["product"])
    back = io.read_delimited(spark, path, ",", "week string, actual double, predicted double, product string")
    return back.select("product", "week", r("actual", "actual", 6), r("predicted", "predicted", 6))


@query("s6_best_params_sink", with_views("prio", f"{TRIALS} SELECT series, CAST(sequence_length AS BIGINT) AS sequence_length, {rs('rmse', 'rmse', 3)} FROM best"))
def s6(spark, sf_dir):
    path = fresh_path(spark, "best-params")
    io.write_best_params(search.best_trial(_naive_trials(spark, sf_dir), ["series"]), path)
    return spark.read.schema("series string, sequence_length bigint, rmse double").json(path).select(
        "series", "sequence_length", r("rmse", "rmse", 3))


@query("s7_model_round_trip", with_views("prio", f"{LINEAR} SELECT series, rn, {rs('y', 'actual')}, {rs('p', 'predicted', 6)} FROM e"))
def s7(spark, sf_dir):
    model, windows = _linear_windows(spark, sf_dir)
    path = fresh_path(spark, "model")
    io.save_model(model.fit(windows.filter("split = 'train'")), path)
    scored = io.load_model(path).transform(windows.filter("split = 'test'"))
    return scored.select("series", "rn", r("label", "actual"), r("prediction", "predicted", 6))
