"""Null keys are keys, and NaN is missing."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.clean import nan_as_null
from tidemark.operators import aggregates, gram, ordered
from tidemark.operators.ordered import Series
from tidemark.sources import io

WINDOW = Series(("a", "b"), ("t",))
FORMS = [Series(("a", "b"), ("t",), 4), Series(("a", "b"), ("t",), 4, "floor(t / 3)"), Series(("a", "b"), ("t",), 4, "CAST(NULL AS INT)")]


@pytest.fixture(scope="module")
def rows(spark):
    # keys with a null in either place or in both, values with gaps
    return spark.range(60).selectExpr("if(id % 3 = 0, NULL, id % 2) AS a", "if(id % 4 = 0, NULL, 'x') AS b", "id AS t",
                                      "if(id % 5 < 2, NULL, CAST(id AS DOUBLE)) AS v")


def sorted_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("form", FORMS)
def test_blocks_equal_windows(rows, form):
    def all_of(s):
        df = ordered.positions(rows, s)
        df = ordered.cumulative_sum(df, s, ["v"])
        df = ordered.forward_fill(df, s, ["v"])
        return ordered.lags(df, s, "v", [1, 3]).select("a", "b", "t", "rn", "n", "v", "v_cum", "lag1", "lag3")

    got = all_of(form)
    assert got.count() == 60
    assert sorted_rows(got) == sorted_rows(all_of(WINDOW))


def test_attach_keeps_null_keys(rows):
    stats = rows.groupBy("a", "b").agg(F.count("*").alias("m"))
    assert ordered.attach(rows, stats, ["a", "b"], ["t"], how="inner").where("m IS NOT NULL").count() == 60


def test_wide_and_narrow_gramians_agree(rows, monkeypatch):
    df = rows.selectExpr("a", "b", "1D AS one", "CAST(t AS DOUBLE) AS x")
    narrow = gram.gramian(df, ["a", "b"], ["one", "x"])
    monkeypatch.setattr(gram, "MAX_SUMS", 0)
    monkeypatch.setattr(gram, "MAX_CELLS", 4)
    assert sorted_rows(gram.gramian(df, ["a", "b"], ["one", "x"])) == sorted_rows(narrow)


def test_exact_quantiles_of_null_keys(rows):
    exact = {(r.a, r.b): r.median for r in aggregates.summary(rows, "v", ["a", "b"]).collect()}
    plain = {(r.a, r.b): r.m for r in rows.groupBy("a", "b").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert exact == plain and len(plain) == 5


def test_nan_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, "NaN"), (2, float("nan"), "x"), (3, None, None)], "i int, v double, s string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    for read in (nan_as_null(df), io.load_table(spark, str(tmp_path), "t"), io.try_load(spark, str(tmp_path / "t.parquet"))):
        assert {r.i: (r.v, r.s) for r in read.collect()} == {1: (1.0, "NaN"), 2: (None, "x"), 3: (None, None)}
    assert {r.column: r.missing for r in aggregates.null_profile(df).collect()} == {"v": 2, "s": 1}


def test_histogram_has_all_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 10.0), (None, 3.0), (None, 3.0), ("n", None)], "k string, v double")
    got = aggregates.density_histogram(df, "v", 4, ["k"]).collect()
    assert sorted((r.k or "", r.bin, r["count"]) for r in got) == sorted(
        [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("", 0, 0), ("", 1, 0), ("", 2, 2), ("", 3, 0)])
    assert {r.normal_density for r in got if r.k is None} == {None}
