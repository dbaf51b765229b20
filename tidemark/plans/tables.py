"""Series views over the given tables, in Spark and as SQL text.

Daily and weekly views have one row per key and calendar step, so a plain window
per key holds however large the tables grow. Views of raw rows are read in blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregates import weekly_mean
from tidemark.operators.ordered import Series, positions

BLOCK_ROWS = 1 << 14

DAILY = Series(("series",), ("ts",))
WEEKLY = Series(("product",), ("year", "week"))
EVENTS = Series(("user_id",), ("ts", "event_id"), BLOCK_ROWS, "date_trunc('hour', ts)")
PARTS = Series(("part_id",), ("ts", "l_orderkey", "l_linenumber", "price"), BLOCK_ROWS, "ts")

MEASURES = ["quantity", "price", "discount", "tax"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day as one series."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("sold"), F.sum("o_totalprice").alias("revenue"),
        F.avg("o_totalprice").alias("avg_price"),
        F.sum(F.col("o_orderpriority").startswith("1").cast("int")).cast("double").alias("urgent"),
    ).withColumn("series", F.lit("all"))


def priority_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day and priority: one series per priority."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("sold"),
        F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the names the queries use."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_id"), F.to_date("l_shipdate").alias("ts"), "l_orderkey",
        "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("failure"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their types."""
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_type").alias("product"))


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the type of their part."""
    # the part table grows with the data, so it is neither hinted nor copied: Spark broadcasts
    # it below its threshold, and splits the partition of a hot part in a sort-merge join
    return line_items(spark, sf_dir).join(products(spark, sf_dir), "part_id")


def weekly(spark: SparkSession, sf_dir: str, mode: str = "calendar_year") -> DataFrame:
    """Weekly means per product with position and length."""
    means = weekly_mean(production(spark, sf_dir), ["product"], "ts", [*MEASURES, "failure"], mode)
    return positions(means, WEEKLY)


def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and failed quantity per ship day; missing on days without any."""
    li = load(spark, sf_dir, "lineitem")
    failed = F.col("l_returnflag") == "R"
    return li.groupBy(F.to_date("l_shipdate").alias("ts")).agg(
        F.sum(F.when(~failed, F.col("l_quantity"))).alias("accepted"),
        F.sum(F.when(failed, F.col("l_quantity"))).alias("failed"),
    ).withColumn("series", F.lit("all"))


def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user, the value missing for errors."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts",
                    F.when(F.col("event_type") != "error", F.col("value")).alias("v"))


VIEWS = {
    "daily": """daily AS (SELECT 'all' AS series, CAST(o_orderdate AS DATE) AS ts,
        CAST(count(*) AS DOUBLE) AS sold, sum(o_totalprice) AS revenue, avg(o_totalprice) AS avg_price,
        CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS DOUBLE) AS urgent
        FROM orders GROUP BY 2)""",
    "prio": """prio0 AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ts,
        CAST(count(*) AS DOUBLE) AS sold, round(sum(o_totalprice), 2) AS revenue
        FROM orders GROUP BY 1, 2),
        prio AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn,
        count(*) OVER (PARTITION BY series) AS n FROM prio0)""",
    "production": """production AS (SELECT p_type AS product, l_partkey AS part_id,
        CAST(l_shipdate AS DATE) AS ts, l_orderkey, l_linenumber, l_quantity AS quantity,
        l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS failure
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "weekly": """weekly0 AS (SELECT product, CAST(year(ts) AS INT) AS year, CAST(week(ts) AS INT) AS week,
        avg(quantity) AS quantity, avg(price) AS price, avg(discount) AS discount, avg(tax) AS tax,
        avg(failure) AS failure, year(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS year_week
        FROM production GROUP BY product, year(ts), week(ts)),
        weekly AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY year, week) AS rn,
        count(*) OVER (PARTITION BY product) AS n FROM weekly0)""",
    "inspection": """inspection0 AS (SELECT 'all' AS series, CAST(l_shipdate AS DATE) AS ts,
        sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS accepted,
        sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS failed FROM lineitem GROUP BY 2),
        inspection AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n
        FROM inspection0)""",
    "gaps": """gaps AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
        count(*) OVER (PARTITION BY user_id) AS n FROM events)""",
}


def with_views(names: str, body: str) -> str:
    """SQL of the named views followed by ``body``, which starts with SELECT or more CTEs."""
    heads = ",\n".join(VIEWS[v] for v in names.split())
    joint = ",\n" if not body.lstrip().upper().startswith("SELECT") else "\n"
    return f"WITH RECURSIVE {heads}{joint}{body.lstrip()}"
