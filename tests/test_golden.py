"""Small frames with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import year_week
from tidemark.functions.clean import decimal_comma, map_flag, map_yes_no, parse_dmy
from tidemark.functions.scalars import argmax_class, one_hot, safe_ratio, step_names
from tidemark.operators import aggregates, columns, filters, folds, metrics, ordered, residuals, scaling
from tidemark.operators import seasonal
from tidemark.operators.ordered import Series, positions
from tidemark.operators.sequences import sequences

S = Series(("k",), ("t",))


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i + 1, None if v is None else float(v)) for i, v in enumerate(values)],
                                 "k string, t int, y double")


def values(df, col, order="t"):
    return [row[col] for row in df.orderBy(order).collect()]


def test_week_labels_around_new_year(spark):
    days = [dt.date(2021, 1, 1), dt.date(2021, 1, 4), dt.date(2024, 12, 30), dt.date(2024, 12, 31)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, ts date")
    rows = df.select("i", year_week("ts").alias("c"), year_week("ts", "iso_year").alias("w")).orderBy("i").collect()
    assert [x.c for x in rows] == ["2021-W53", "2021-W01", "2024-W01", "2024-W01"]
    assert [x.w for x in rows] == ["2020-W53", "2021-W01", "2025-W01", "2025-W01"]


def test_dates(spark):
    df = spark.createDataFrame([("01.02.2020",), ("1.2.2020",), ("x",)], "c string")
    got = [row[0] for row in df.select(parse_dmy("c", strict=False)).collect()]
    assert got == [dt.date(2020, 2, 1), dt.date(2020, 2, 1), None]
    with pytest.raises(Exception):
        df.select(parse_dmy("c")).collect()


def test_decimal_comma(spark):
    df = spark.createDataFrame([(1, "3,5"), (2, "nan"), (3, ""), (4, "1.234,5")], "t int, c string")
    assert values(decimal_comma(df, ["c", "absent"]), "c") == [3.5, None, None, None]
    with pytest.raises(Exception):
        decimal_comma(df, ["c"], strict=True).collect()
    assert values(decimal_comma(df.filter("t < 4"), ["c"], strict=True), "c") == [3.5, None, None]


def test_flags(spark):
    df = spark.createDataFrame([(1, "True", True, "yes"), (2, "False", False, "no"), (3, "true", None, "Yes")],
                               "t int, a string, b boolean, c string")
    out = map_yes_no(map_flag(df, ["a", "b", "absent"]), ["c"])
    assert values(out, "a") == [1, 0, None]
    assert values(out, "b") == [1, 0, None]
    assert values(out, "c") == [1, 0, None]
    with pytest.raises(Exception):
        map_yes_no(df, ["absent"]).collect()


def test_one_hot(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0, 1, 2, 3, 4, -1, None])], "t int, c int")
    assert values(df.withColumn("v", one_hot("c")), "v") == [
        [0, 0, 0, 1], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], None, None, None]
    with pytest.raises(Exception):
        df.filter("c = 4").select(one_hot("c", strict=True)).collect()
    assert df.filter("c = 3").select(one_hot("c", strict=True)).first()[0] == [0, 0, 1, 0]


def test_scalars(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, [0.2, 0.5, 0.5])], "t int, a double, b double, p array<double>")
    row = df.select(safe_ratio(F.col("a"), F.col("b")).alias("r"), argmax_class(F.col("p")).alias("c")).first()
    assert row.r == pytest.approx(1e8) and row.c == 1
    assert step_names(["x", "z"], 2) == ["x_t-1", "z_t-1", "x_t-0", "z_t-0"]


def test_scaling(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 5.0), ("a", 2, 2.0, 5.0), ("a", 3, 4.0, 5.0)],
                               "k string, t int, y double, c double")
    z = scaling.standard_scale(df, S, ["y", "c"])
    sd = (14 / 9) ** 0.5
    assert values(z, "y") == pytest.approx([(v - 7 / 3) / sd for v in (1, 2, 4)])
    assert values(z, "c") == [0.0, 0.0, 0.0]
    u = scaling.minmax_scale(df, S, ["y", "c"])
    assert values(u, "y") == pytest.approx([0, 1 / 3, 1]) and values(u, "c") == [0.0, 0.0, 0.0]
    for c in ("y", "c"):
        back = scaling.minmax_inverse(u, scaling.minmax_params(df, ["k"], [c]), S, c, [c])
        assert values(back, c) == pytest.approx(values(df, c))


def test_scaling_fitted_on_train_part(spark):
    df = folds.ordered_split(positions(series(spark, [0, 10, 20, 40]), S), 0.5)
    assert values(scaling.minmax_scale(df, S, ["y"], fit_on="train"), "y") == [0.0, 1.0, 2.0, 4.0]


def test_moments(spark):
    df = series(spark, [1, 2, 4, 9])
    m = residuals.residual_moments(df, ["k"], "y").first()
    assert m.skewness == pytest.approx(0.76842, abs=1e-5) and m.kurtosis == pytest.approx(-1.0, abs=1e-5)
    d = aggregates.describe(df, "y", ["k"]).first()
    assert (d["count"], d.mean, d.min, d.max) == (4, 4.0, 1.0, 9.0)
    assert d["std"] == pytest.approx(3.55903, abs=1e-5)
    assert (d.q25, d.q50, d.q75) == (1.75, 3.0, 5.25)
    assert aggregates.summary(df, "y").first().median == 3.0


def test_next_step_sequences(spark):
    seq = sequences(positions(series(spark, range(1, 7)), S), S, ["y"], "y", 3)
    rows = seq.orderBy("sample").collect()
    assert [x.label for x in rows] == [4.0, 5.0, 6.0]
    assert [[v.y for v in x.steps] for x in rows] == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]


def test_same_window_sequences(spark):
    seq = sequences(positions(series(spark, range(1, 7)), S), S, ["y"], "y", 3, label="same_window", trim=1)
    rows = seq.orderBy("sample").collect()
    assert [list(x.label) for x in rows] == [[1, 2, 3], [2, 3, 4]]
    assert [x.sample for x in rows] == [1, 2]


def test_flatten_and_restore(spark):
    seq = sequences(positions(series(spark, range(1, 7)), S), S, ["y", "t"], "y", 3)
    flat = columns.flatten_steps(seq, ["y", "t"])
    assert flat.orderBy("sample").first().features.toArray().tolist() == [1, 1, 2, 2, 3, 3]
    back = columns.restore_steps(flat.drop("steps"), ["y", "t"], 3).orderBy("sample").first()
    assert [(v.y, v.t) for v in back.steps] == [(1, 1), (2, 2), (3, 3)]
    tall = columns.step_labels(columns.long_steps(seq, ["y"], 3, ["sample"]))
    assert {x.name: x.value for x in tall.filter("sample = 1").collect()} == {"y_t-2": 1, "y_t-1": 2, "y_t-0": 3}


def test_expanding_folds(spark):
    out = folds.expanding_folds(positions(series(spark, range(20)), S), 0.5, 3)
    spans = {(x.fold, x.role): (x.lo, x.hi) for x in out.groupBy("fold", "role").agg(
        F.min("rn").alias("lo"), F.max("rn").alias("hi")).collect()}
    assert spans == {(1, "train"): (1, 10), (2, "train"): (1, 13), (3, "train"): (1, 16),
                     (1, "test"): (11, 13), (2, "test"): (14, 16), (3, "test"): (17, 19)}
    assert folds.training_rows(out, 2).count() == 13


@pytest.mark.parametrize("n,train", [(5, 4), (15, 10)])
def test_half_even_split(spark, n, train):
    out = folds.ordered_split(positions(series(spark, range(n)), S), 0.3, "half_even")
    assert out.filter("split = 'train'").count() == train


def test_floor_split_uses_double_product(spark):
    for n in (10, 30, 70, 90, 130):
        out = folds.ordered_split(positions(series(spark, range(n)), S), 0.7)
        assert out.filter("split = 'train'").count() == int(n * 0.7)


def test_forward_fill(spark):
    df = positions(series(spark, [None, 1, None, None, 4]), S)
    assert values(ordered.forward_fill(df, S, ["y"]), "y") == [None, 1, 1, 1, 4]


def test_gap_sequences(spark):
    df = positions(series(spark, [1, 2, 3, None, 5, 6, 7, 8]), S)
    whole = filters.drop_gap_sequences(sequences(df, S, ["y"], "y", 2), ["y"])
    assert values(whole, "label", "sample") == [3.0, 7.0, 8.0]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "actual double, predicted double")
    m = metrics.regression_metrics(df).first()
    assert (m.mse, m.mae, m.r2) == pytest.approx((1 / 3, 1 / 3, 0.5))
    assert m.mape == pytest.approx(100 / 9)
    flat = df.withColumn("actual", F.lit(2.0))
    assert metrics.regression_metrics(flat).first().r2 == 0.0


def test_candidate_counts(spark):
    lengths = spark.createDataFrame([("a", 30), ("b", 60), ("c", 200), ("d", 20), ("e", 8)], "k string, n long")
    c = seasonal.order_candidates(lengths, 7)
    count = {x.k: x["count"] for x in c.groupBy("k").count().collect()}
    assert count == {"a": 16, "b": 144, "c": 144, "d": 8, "e": 8}
    kept = {x.k: x["count"] for x in seasonal.prune_candidates(c).groupBy("k").count().collect()}
    assert (kept["a"], kept["b"], kept["c"]) == (15, 137, 144)
    # a season longer than a third of the series switches seasonality off
    flat = seasonal.order_candidates(lengths.filter("k = 'b'"), 30)
    assert flat.count() == 18 and flat.select("season").distinct().first()[0] == 1


def test_batch_mean_loss(spark):
    df = series(spark, [1, 2, 3, 4, 100])
    out = metrics.batch_mean_loss(df, S, "y", 2).first()
    assert out.loss == pytest.approx((1.5 + 3.5) / 2) and out.batches == 2


def test_split_cumsum(spark):
    df = positions(series(spark, [1, 2, 3, 4]), S)
    out = ordered.split_cumsum(folds.ordered_split(df, 0.5), S, ["y"])
    assert values(out, "y_cum") == [2.0, 6.0, 3.0, 7.0]


def test_label_codes(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 2.0), (3, 10.0), (4, None)], "t int, y double")
    codes = columns.label_codes(df, "y")
    assert values(columns.label_encode(df, codes, "y", ["t"]), "code") == [1, 0, 1, None]
    other = spark.createDataFrame([(1, 3.0)], "t int, y double")
    with pytest.raises(Exception):
        columns.label_encode(other, codes, "y", ["t"]).collect()
    assert columns.label_encode(other, codes, "y", ["t"], strict=False).first().code is None


def test_filter_equals_requires_rows(spark):
    df = series(spark, [1, 2])
    assert filters.filter_equals(df, "k", "a", required=True).count() == 2
    with pytest.raises(ValueError):
        filters.filter_equals(df, "k", "zz", required=True)


def test_validation_tail(spark):
    df = positions(series(spark, range(10)), S).withColumn("train_n", F.lit(10))
    assert values(folds.validation_tail(df), "is_validation") == [False] * 8 + [True] * 2


def test_constant_correlation_is_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (3.0, 5.0, 3.0)], "y double, c double, g double")
    got = {x.feature: (x["corr"], x.n) for x in aggregates.target_correlations(df, "y", ["c", "g"]).collect()}
    assert got["c"] == (None, 3) and got["g"][0] == pytest.approx(1.0) and got["g"][1] == 2
