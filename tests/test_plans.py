"""Physical plans: what reaches the scan, what is shuffled, what stays in the JVM."""

import os
import re
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, attribution, filters, ordered
from tidemark.operators.ordered import Series, positions
from tidemark.plans.catalog import QUERIES
from tidemark.plans.tables import DAILY, load, priority_sales
from tidemark.sources import io, shared

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    df = io.load_table(spark, SF_DIR, "lineitem").filter("l_returnflag = 'R'")
    text = plan(aggregates.weekly_mean(df, ["l_partkey"], "l_shipdate", ["l_quantity"]))
    assert "EqualTo(l_returnflag,R)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_partkey", "l_shipdate", "l_quantity", "l_returnflag"}


def test_weekly_mean_aggregates_before_its_only_shuffle(spark):
    df = load(spark, SF_DIR, "lineitem")
    text = plan(aggregates.weekly_mean(df, ["l_partkey"], "l_shipdate", ["l_quantity"]))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_avg" in text


def test_windows_of_one_series_share_one_sort(spark):
    df = positions(priority_sales(spark, SF_DIR), DAILY)
    df = ordered.log_returns(ordered.difference(df, DAILY, ["revenue"]), DAILY, ["sold"])
    text = plan(ordered.cumulative_sum(df, DAILY, ["sold"]))
    # one shuffle for the daily groups, one for the series
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Sort [") == 1


def test_head_rows_are_cut_before_the_shuffle(spark):
    df = filters.head_rows(load(spark, SF_DIR, "events"), Series(("user_id",), ("ts", "event_id")), 3)
    assert plan(df).count("WindowGroupLimit") == 2


def test_sampled_keys_need_no_global_window(spark):
    from tidemark.operators.ranking import sample_keys
    text = plan(sample_keys(load(spark, SF_DIR, "part"), "p_partkey", 100, 1))
    assert "TakeOrderedAndProject" in text and "Window" not in text


def test_long_series_never_form_one_group(spark):
    s = Series(("user_id",), ("ts", "event_id"), 8)
    df = ordered.forward_fill(positions(load(spark, SF_DIR, "events"), s), s, ["value"])
    windows = re.findall(r"Window \[[^\n]*", plan(df))
    rows = [w for w in windows if "last(value" in w]
    assert rows and all("_block" in w for w in rows)


def session_like(named, master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named or default), sparkContext=context)


def test_shared_folder_is_the_one_the_session_names():
    assert shared.shared_dir(session_like("hdfs://nn/shared/", "yarn")) == "hdfs://nn/shared"
    # a cluster without the setting gets no machine-local folder
    with pytest.raises(RuntimeError):
        shared.shared_dir(session_like(None, "spark://host:7077"))


def test_written_table_keeps_rows_and_schema(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 0.5)
    out = shared.as_table(df, "x")
    assert out.schema.names == df.schema.names and out.agg(F.sum("v")).first()[0] == 2475.0


def test_written_tables_can_be_dropped(spark):
    # on its own record: other tests still read theirs
    kept, shared._written = shared._written, []
    try:
        path = shared.as_table(spark.range(3), "y").inputFiles()[0]
        assert shared.drop_tables(spark) == 1 and not shared._written
        assert not os.path.exists(path.removeprefix("file://"))
    finally:
        shared._written = kept


def test_try_load(spark):
    assert io.try_load(spark, f"{SF_DIR}/absent.parquet") is None
    assert io.try_load(spark, f"{SF_DIR}/part.parquet").agg(F.count("*")).first()[0] > 0


def test_python_workers_need_no_copy_of_the_package():
    """A driver started elsewhere can run the operators that use Python workers."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from tidemark.session import local_session
from tidemark.operators.residuals import _chi2_tails
from tidemark.operators.gram import gramian
spark = local_session(2, 2)
df = spark.createDataFrame([("a", float(i), i * i + 1.0) for i in range(9)], "k string, x double, y double")
assert df.limit(1).select(_chi2_tails("y", "y")).count() == 1
names = ["x", "y"] * 7
wide = df.select("k", *[df[c].alias(f"{{c}}{{i}}") for i, c in enumerate(names)])
print("rows", len(gramian(wide, ["k"], wide.columns[1:]).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=180)
    assert "rows 1" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("name", ["f1_filter_equals", "t4_top_k"])
def test_line_items_are_summed_before_the_join(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    joined = text.index("Join")
    assert "partial_sum" in text[joined:] or "partial_count" in text[joined:]
    assert text.count("lineitem.parquet") == 1


def test_split_columns_need_no_other_table(spark):
    text = plan(QUERIES["p11_split_features_target"](spark, SF_DIR))
    assert "part.parquet" not in text and "p_type" not in text


def test_attribution_by_lag_reads_its_input_once(spark):
    phi = spark.range(100).selectExpr("id % 2 AS k", "concat('f', id % 5) AS feature", "id % 4 AS lag", "id * 0.5D AS phi")
    found = attribution.attribution_by_lag(phi, ["k"], n=2)
    assert plan(found).count("Range (0, 100") == 1
    top = {(r.k, r.feature) for r in found.collect()}
    assert len(top) == 4
    # of each key the two features of the largest mean over lags of the mean absolute value
    means = {}
    for r in phi.collect():
        means.setdefault((r.k, r.feature), {}).setdefault(r.lag, []).append(abs(r.phi))
    worth = {f: sum(sum(v) / len(v) for v in by.values()) / len(by) for f, by in means.items()}
    want = {f for k in (0, 1) for f in sorted((f for f in worth if f[0] == k), key=lambda f: (-worth[f], f[1]))[:2]}
    assert top == want


def test_sinks_are_dropped_too(spark):
    path = shared.fresh_path(spark, "sink")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file:"))
    shared.drop_tables(spark)
    assert not os.path.isdir(path.removeprefix("file:"))
