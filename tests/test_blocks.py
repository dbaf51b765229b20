"""The block form of ordered operators gives what one window per key gives."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import aggregates, columns, ordered
from tidemark.operators.ordered import Series, positions
from tidemark.operators.sequences import sequences
from tidemark.operators.stationarity import adf_test, differenced_variants

PLAIN = Series(("k",), ("t", "i"))
BLOCKS = replace(PLAIN, block_rows=16)


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, one has a single row; times are tied."""
    rng = random.Random(5)
    data = []
    for key, n in (("hot", 400), ("mid", 37), ("one", 1), ("two", 16)):
        for i in range(n):
            v = None if rng.random() < 0.3 else round(rng.uniform(-5, 5), 3)
            data.append((key, i // 3, i, v, rng.uniform(1, 9)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t int, i int, v double, y double").repartition(5).cache()


def same(a, b):
    cols = sorted(a.columns)
    order = ["k", "t", "i"] if "i" in cols else cols[:3]

    def clean(df):
        return [tuple(round(x, 9) if isinstance(x, float) else str(x) for x in row)
                for row in df.select(*cols).orderBy(*order).collect()]

    assert clean(a) == clean(b)


def both(rows, make):
    return [make(positions(rows, s), s) for s in (PLAIN, BLOCKS)]


def test_positions(rows):
    same(*both(rows, lambda df, s: df))


@pytest.mark.parametrize("size", [8, 16, 37, 1000])
def test_positions_in_buckets(rows, size):
    # all series long, some, one (the null key and the hot one), none; rows of one time are one bucket
    named = rows.unionByName(rows.filter("k = 'mid'").withColumn("k", F.lit(None).cast("string")))
    bucketed = Series(("k",), ("t", "i"), size, "t")
    same(positions(named, PLAIN).fillna("null", ["k"]), positions(named, bucketed).fillna("null", ["k"]))


def test_positions_of_short_series_shuffle_once(rows):
    # counts of every (key, bucket) were shuffled twice besides the rows
    text = positions(rows, Series(("k",), ("t", "i"), 1000, "t"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "_bucket" not in text


def test_running(rows):
    same(*both(rows, lambda df, s: ordered.running(df, s, sums={"total": "v"}, fills={"last": "v"})))


def test_forward_fill_is_idempotent(rows):
    once = both(rows, lambda df, s: ordered.forward_fill(df, s, ["v"]))
    same(*once)
    same(once[1], ordered.forward_fill(once[1], BLOCKS, ["v"]))


def test_split_cumsum(rows):
    def make(df, s):
        df = df.withColumn("split", F.when(F.col("rn") <= F.floor(F.col("n") * 0.6), "train").otherwise("test"))
        return ordered.split_cumsum(df, s, ["y"])
    same(*both(rows, make))


def test_differences(rows):
    def make(df, s):
        df = ordered.difference(df, s, ["y"], order=3, suffix="_d3")
        df = ordered.difference(df, s, ["y"], lag=7, suffix="_s")
        return ordered.log_returns(df, s, ["y"])
    same(*both(rows, make))


def test_sequences(rows):
    for label in ("next", "same_window"):
        same(*both(rows, lambda df, s, label=label: sequences(df, s, ["y", "v"], "y", 5, label=label)))


def test_decompose_and_acf(rows):
    for period in (7, 12):
        same(*both(rows, lambda df, s, period=period: ordered.seasonal_decompose(df, s, "y", period)))
    same(*both(rows, lambda df, s: ordered.autocorrelation(df, s, "y", 6).withColumn("t", F.lit(0))))


def test_decomposition_parts_add_up(rows):
    out = ordered.seasonal_decompose(positions(rows, BLOCKS), BLOCKS, "y", 7).filter("trend is not null")
    assert out.count() > 0
    assert out.filter("abs(trend + seasonal + resid - y) > 1e-9").count() == 0


def test_variants_and_adf(rows):
    long = rows.filter("k in ('hot', 'mid')")
    blocks = replace(PLAIN, block_rows=32)

    def both(df, make):
        return [make(positions(df, s), s) for s in (PLAIN, blocks)]

    same(*both(long, lambda df, s: differenced_variants(df, s, "y", 7, 2, 1).withColumnRenamed("rn", "i").withColumn(
        "t", F.col("d") * 10 + F.col("sd"))))
    same(*both(long, lambda df, s: adf_test(df, s, "y").select("k", "statistic", "used_lag", "n_obs", "p_value")))


def test_cumsum_of_difference_restores(rows):
    df = positions(rows, BLOCKS)
    d = ordered.difference(df, BLOCKS, ["y"], suffix="_d").withColumn("y_d", F.coalesce("y_d", "y"))
    out = ordered.cumulative_sum(d, BLOCKS, ["y_d"])
    assert out.filter("abs(y_d_cum - y) > 1e-9").count() == 0


def test_frame_longer_than_block_is_refused(rows):
    with pytest.raises(ValueError):
        ordered.difference(positions(rows, BLOCKS), BLOCKS, ["y"], lag=17)


def test_result_does_not_depend_on_partitioning(rows):
    outs = [ordered.forward_fill(positions(rows.repartition(n), BLOCKS), BLOCKS, ["v"]) for n in (1, 8)]
    same(*outs)


def test_label_codes_in_blocks(rows):
    a = columns.label_codes(rows, "y").orderBy("y").collect()
    b = columns.label_codes(rows, "y", block_rows=16).orderBy("y").collect()
    assert a == b


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-4, 4)), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, data):
    df = spark.createDataFrame([(k, float(v)) for k, v in data], "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(x.k, x.prob): x.value for x in aggregates.quantiles(df, ["k"], "v", probs).collect()}
    for key in {k for k, _ in data}:
        own = [float(v) for k, v in data if k == key]
        for p in probs:
            assert got[key, p] == pytest.approx(np.quantile(own, p))
    whole = {x.prob: x.value for x in aggregates.quantiles(df, [], "v", probs).collect()}
    assert whole[0.25] == pytest.approx(np.quantile([float(v) for _, v in data], 0.25))


@pytest.mark.parametrize("sketch,sorted_rows", [(1000, 1 << 20), (1000, 5), (2, 1 << 20), (8, 20)])
def test_bracketed_quantiles_match_numpy(spark, sketch, sorted_rows):
    rng = np.random.default_rng(6)
    groups = {"wide": rng.normal(size=700), "ties": np.repeat([1.0, 2.0, 3.0], [300, 20, 400]), "one": np.array([4.0]),
              "two": np.array([1.0, 2.0]), "same": np.full(50, 7.0), None: rng.integers(0, 5, 90).astype(float)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("wide", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.51, 0.999, 1.0]
    got = {(x.k, x.prob): x.value for x in aggregates.quantiles(df, ["k"], "v", probs, sketch, sorted_rows).collect()}
    assert len(got) == 7 * 7 and all(got["none", p] is None for p in probs)
    for key, own in groups.items():
        assert [got[key, p] for p in probs] == pytest.approx(np.quantile(own, probs).tolist())
    whole = {x.prob: x.value for x in aggregates.quantiles(df, [], "v", probs, sketch, sorted_rows).collect()}
    assert [whole[p] for p in probs] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), probs).tolist())


def test_a_rank_outside_its_bracket_is_looked_up_again(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", float(i)) for i in range(50)], "k string, _v double")
    wrong = spark.createDataFrame([("a", 100, [10.0], [12.0]), ("b", 50, [20.0], [30.0])], "k string, _n long, _lo array<double>, _hi array<double>")
    got = {r.k: r._q for r in aggregates._ranked(df, aggregates._Held(wrong, True, "wrong"), ["k"], [0.5]).collect()}
    assert got == {"a": [None], "b": [24.5]}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert aggregates.quantiles(df, ["k"], "v", [0.5]).count() == 0
    assert aggregates.quantiles(df, [], "v", [0.5]).count() == aggregates.describe(df, "v").count() == 0
    assert [r.value for r in aggregates.quantiles(spark.createDataFrame([(None,)], "v double"), [], "v", [0.5]).collect()] == [None]


def test_pairwise_correlations_with_missing_values(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 7)) + 1e4
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 5] = 3.0
    x[1:, 6] = np.nan
    rows = [("ab"[i % 2], [None if np.isnan(v) and i % 3 else float(v) for v in row]) for i, row in enumerate(x)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(4)
    for block in (256, 3):
        got = {(r.k, r.i, r.j): r for r in aggregates.pairwise_correlations(df, "v", 7, ["k"], block).collect()}
        assert len(got) == 2 * 21
        for k, own in (("a", x[::2]), ("b", x[1::2])):
            want = pd.DataFrame(own).corr(min_periods=2)
            for i in range(7):
                for j in range(i + 1, 7):
                    r = got[k, i, j]
                    assert r.n == int((~np.isnan(own[:, [i, j]])).all(axis=1).sum())
                    if j >= 5:
                        assert r.corr is None
                    else:
                        assert r.corr == pytest.approx(want.loc[i, j], abs=1e-9)
    assert aggregates.pairwise_correlations(df, "v", 7).count() == 21
