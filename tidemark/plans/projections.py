"""Sources, cleaning, scalar functions, filters and joins."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_features, cyclic_features, year_week
from tidemark.functions.clean import decimal_comma, map_flag, map_yes_no, parse_dmy, parse_ts
from tidemark.functions.scalars import argmax_class, log1p_cols, one_hot, safe_ratio
from tidemark.operators import columns as cols
from tidemark.operators import filters, ranking
from tidemark.operators.aggregates import unpivot_row
from tidemark.operators.folds import ordered_split
from tidemark.operators.metrics import split_counts
from tidemark.operators.ordered import Series, lags, positions
from tidemark.operators.sequences import sequences
from tidemark.plans.registry import big, bigs, day, days, query, r, rs
from tidemark.plans.tables import (
    EVENTS, MEASURES, PARTS, WEEKLY, daily_sales, gap_events, line_items, load, priority_sales, production,
    products, weekly, with_views)
from tidemark.sources import io
from tidemark.sources.shared import fresh_path


def raw_sales(spark, sf_dir):
    """Orders as the text a delimited export would hold."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("Date"),
        F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")).alias("price"),
        F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "False")
        .otherwise("unknown").alias("flag"),
        F.when(F.col("o_orderpriority").startswith("1"), "yes").otherwise("no").alias("holiday"))


@query("s1_delimited_scan", f"""SELECT o_orderkey AS id, {days("o_orderdate", "day")},
    {rs("o_totalprice", "price")}, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS DOUBLE) AS flag,
    {bigs("CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END", "holiday")} FROM orders""")
def s1(spark, sf_dir):
    path = fresh_path(spark, "sales")
    raw_sales(spark, sf_dir).write.option("sep", ";").option("header", True).csv(path)
    df = io.read_delimited(spark, path, ";", "id string, Date string, price string, flag string, holiday string")
    df = map_yes_no(map_flag(decimal_comma(df, ["price", "absent"]), ["flag"]), ["holiday"])
    return df.select(big("id", "id"), day(parse_dmy("Date"), "day"), r("price", "price"),
                     F.col("flag").cast("double").alias("flag"), big("holiday", "holiday"))


@query("s2_table_scan", f"""SELECT p_partkey AS part_id, p_name AS name, p_type AS product,
    {rs("p_retailprice", "price")} FROM part WHERE p_size >= 10""")
def s2(spark, sf_dir):
    return io.load_table(spark, sf_dir, "part").filter("p_size >= 10").select(
        F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("product"), r("p_retailprice", "price"))


@query("s8_missing_input", """SELECT 'orders' AS source, count(*) AS n FROM orders
    UNION ALL SELECT 'external', 0""")
def s8(spark, sf_dir):
    # an absent data set is left out instead of ending the run
    base = load(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("orders").alias("source"), "n")
    external = io.try_load(spark, f"{sf_dir}/no_such_table.parquet")
    found = base.select(F.lit("external").alias("source"), F.lit(0).cast("long").alias("n")) \
        if external is None else external.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("external").alias("source"), "n")
    return base.unionByName(found)


DMY = """CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 3 = 0
    THEN day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate)
    ELSE strftime(o_orderdate, '%d.%m.%Y') END"""


@query("p1_parse_dmy", f"""SELECT o_orderkey, {days(f"try_strptime({DMY}, '%d.%m.%Y')", "day")} FROM orders""")
def p1(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 7 == 0, "x").when(key % 3 == 0, F.date_format("o_orderdate", "d.M.yyyy")).otherwise(
        F.date_format("o_orderdate", "dd.MM.yyyy"))
    return load(spark, sf_dir, "orders").withColumn("text", text).select(
        "o_orderkey", day(parse_dmy("text", strict=False), "day"))


@query("p2_parse_timestamp", """SELECT event_id, strftime(try_strptime(CASE WHEN event_id % 11 = 0 THEN 'bad'
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, '%Y-%m-%d %H:%M:%S.%f'), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events""")
def p2(spark, sf_dir):
    text = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("ts").cast("string"))
    return load(spark, sf_dir, "events").withColumn("text", text).select(
        "event_id", F.date_format(parse_ts("text", strict=False), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("p3_decimal_comma", f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL
    ELSE round(o_totalprice, 2) + 0.0 END AS price FROM orders""")
def p3(spark, sf_dir):
    text = F.when(F.col("id") % 5 == 0, "nan").otherwise(F.col("price"))
    return decimal_comma(raw_sales(spark, sf_dir).withColumn("price", text), ["price", "absent"]).select(
        big("id", "id"), r("price", "price"))


@query("p4_map_flag", """SELECT o_orderkey AS id, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END
    AS DOUBLE) AS flag, CAST(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS DOUBLE) AS large FROM orders""")
def p4(spark, sf_dir):
    df = raw_sales(spark, sf_dir).withColumn("large", F.replace("price", F.lit(","), F.lit(".")).cast("double") > 100000)
    return map_flag(df, ["flag", "large", "absent"]).select(
        big("id", "id"), F.col("flag").cast("double").alias("flag"), F.col("large").cast("double").alias("large"))


@query("p5_map_yes_no", """SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS holiday
    FROM orders""")
def p5(spark, sf_dir):
    return map_yes_no(raw_sales(spark, sf_dir), ["holiday"]).select(big("id", "id"), "holiday")


@query("p6_numeric_columns", """SELECT 'l_suppkey' AS "column", count(l_suppkey) AS present FROM lineitem
    UNION ALL SELECT 'l_linenumber', count(l_linenumber) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', count(l_extendedprice) FROM lineitem
    UNION ALL SELECT 'l_discount', count(l_discount) FROM lineitem
    UNION ALL SELECT 'l_tax', count(l_tax) FROM lineitem
    UNION ALL SELECT 'l_partkey', count(l_partkey) FROM lineitem""")
def p6(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    names = cols.numeric_columns(li, exclude=["l_quantity"], exclude_prefix=["l_order"])
    return unpivot_row(li.agg(*[F.count(c).alias(c) for c in names]), names, value="present")


@query("p7_keep_numeric", f"SELECT p_partkey, p_size, {rs('p_retailprice', 'p_retailprice')} FROM part")
def p7(spark, sf_dir):
    kept, _dropped = cols.keep_numeric(load(spark, sf_dir, "part"))
    return kept.withColumns({"p_retailprice": r("p_retailprice", "p_retailprice")})


@query("p8_calendar_features", with_views("daily", f"""SELECT {days("ts")}, {bigs("dayofyear(ts)", "day_of_year")},
    {bigs("month(ts)", "month")}, {bigs("isodow(ts) - 1", "day_of_week")}, {bigs("week(ts)", "week_of_year")}
    FROM daily"""))
def p8(spark, sf_dir):
    df = calendar_features(daily_sales(spark, sf_dir), "ts")
    return df.select(day("ts"), *[big(c, c) for c in ("day_of_year", "month", "day_of_week", "week_of_year")])


@query("p9_cyclic_features", with_views("daily", f"""SELECT {days("ts")},
    {rs("sin(2 * pi() * dayofyear(ts) / 365.25)", "sin_day", 6)}, {rs("cos(2 * pi() * dayofyear(ts) / 365.25)", "cos_day", 6)},
    {rs("sin(2 * pi() * week(ts) / 52.0)", "sin_week", 6)}, {rs("cos(2 * pi() * week(ts) / 52.0)", "cos_week", 6)}
    FROM daily"""))
def p9(spark, sf_dir):
    df = cyclic_features(calendar_features(daily_sales(spark, sf_dir), "ts"))
    return df.select(day("ts"), r("sin_day_of_year", "sin_day", 6), r("cos_day_of_year", "cos_day", 6),
                     r("sin_week", "sin_week", 6), r("cos_week", "cos_week", 6))


@query("p10_year_week", """SELECT year(l_shipdate) || '-W' || lpad(CAST(week(l_shipdate) AS VARCHAR), 2, '0') AS calendar_label,
    isoyear(l_shipdate) || '-W' || lpad(CAST(week(l_shipdate) AS VARCHAR), 2, '0') AS iso_label, count(*) AS n
    FROM lineitem GROUP BY 1, 2""")
def p10(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(
        year_week("l_shipdate").alias("calendar_label"),
        year_week("l_shipdate", "iso_year").alias("iso_label")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_split_features_target", """SELECT part_id, count(*) AS n, sum(quantity) AS quantity,
    CAST(sum(failure) AS BIGINT) AS failures FROM (SELECT l_partkey AS part_id, l_quantity AS quantity,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS failure FROM lineitem) GROUP BY part_id""")
def p11(spark, sf_dir):
    x, y = cols.split_xy(line_items(spark, sf_dir), ["quantity"], "failure", ids=["part_id"])
    x = x.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))
    y = y.groupBy("part_id").agg(F.sum("failure").alias("failures"))
    return x.join(y, "part_id")


@query("p12_one_hot", """SELECT code, CASE code WHEN 0 THEN '0,0,0,1' WHEN 1 THEN '1,0,0,0' WHEN 2 THEN '0,1,0,0'
    WHEN 3 THEN '0,0,1,0' END AS vector, count(*) AS n FROM (SELECT l_linenumber % 6 AS code FROM lineitem) GROUP BY 1, 2""")
def p12(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 6).alias("code"))
    hot = F.array_join(F.transform(one_hot("code"), lambda x: x.cast("string")), ",")
    return df.groupBy("code", hot.alias("vector")).agg(F.count(F.lit(1)).alias("n"))


@query("p13_log1p", f"""SELECT l_orderkey, l_linenumber, {rs("ln(l_quantity + 1)", "quantity", 6)},
    {rs("ln(l_extendedprice + 1)", "price", 6)} FROM lineitem""")
def p13(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return log1p_cols(li, ["quantity", "price"]).select(
        "l_orderkey", "l_linenumber", r("quantity", "quantity", 6), r("price", "price", 6))


@query("p14_assemble_vector", with_views("daily", f"""SELECT {days("ts")}, {rs("sold", "v1")}, {rs("revenue", "v2")},
    {rs("urgent", "v3")} FROM daily"""))
def p14(spark, sf_dir):
    df = cols.assemble(daily_sales(spark, sf_dir), ["sold", "revenue", "urgent"])
    v = vector_to_array("features")
    return df.select(day("ts"), *[r(v[i], f"v{i + 1}") for i in range(3)])


@query("p15_vector_to_columns", f"""SELECT vec_id, label, {rs("embedding[1]", "PC1", 6)}, {rs("embedding[2]", "PC2", 6)},
    {rs("embedding[3]", "PC3", 6)} FROM embeddings""")
def p15(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    df = load(spark, sf_dir, "embeddings").withColumn("v", array_to_vector("embedding"))
    return cols.vector_to_columns(df, "v", 3, keep=["vec_id", "label"]).select(
        "vec_id", "label", *[r(f"PC{i}", f"PC{i}", 6) for i in (1, 2, 3)])


@query("p16_label_encode", """SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code
    FROM events""")
def p16(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return cols.encode_target(e, "event_type", e, ["event_id"]).select("event_id", "event_type", "code")


WINDOW_STEPS = """steps AS (SELECT a.product, a.rn - 10 AS sample, a.rn - 1 - b.rn AS lag, a.n, a.year_week,
    a.failure AS label, b.quantity, b.price, b.discount, b.tax
    FROM weekly a JOIN weekly b ON a.product = b.product AND b.rn BETWEEN a.rn - 10 AND a.rn - 1 WHERE a.rn > 10)"""


@query("p17_lag_names", with_views("production weekly", f"""{WINDOW_STEPS}
    SELECT product, feature || '_t-' || lag AS name, {rs("avg(value)", "mean", 6)}, count(*) AS n FROM (
    SELECT product, lag, 'quantity' AS feature, quantity AS value FROM steps
    UNION ALL SELECT product, lag, 'price', price FROM steps) GROUP BY product, 2"""))
def p17(spark, sf_dir):
    seq = sequences(weekly(spark, sf_dir), WEEKLY, ["quantity", "price"], "failure", 10)
    tall = cols.step_labels(cols.long_steps(seq, ["quantity", "price"], 10, ["product", "sample"]))
    return tall.groupBy("product", "name").agg(r(F.avg("value"), "mean", 6), F.count(F.lit(1)).alias("n"))


@query("p18_flatten_window", with_views("production weekly", f"""{WINDOW_STEPS}
    SELECT product, sample, {rs("max(CASE WHEN lag = 9 THEN quantity END)", "first_quantity")},
    {rs("max(CASE WHEN lag = 0 THEN tax END)", "last_tax", 6)}, CAST(40 AS BIGINT) AS width FROM steps GROUP BY product, sample"""))
def p18(spark, sf_dir):
    seq = sequences(weekly(spark, sf_dir), WEEKLY, MEASURES, "failure", 10)
    flat = cols.flatten_steps(seq, MEASURES).drop("steps")
    back = cols.restore_steps(flat, MEASURES, 10)
    return back.select("product", "sample", r(F.col("steps")[0]["quantity"], "first_quantity"),
                       r(F.col("steps")[9]["tax"], "last_tax", 6),
                       big(F.size(vector_to_array("features")), "width"))


@query("p19_argmax", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings""")
def p19(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", argmax_class(F.col("embedding")).alias("best"))


@query("p20_safe_ratio", f"""SELECT l_orderkey, l_linenumber, {rs("CASE WHEN l_tax - 0.02 + 1e-8 = 0 THEN NULL ELSE (l_discount - 0.05) / (l_tax - 0.02 + 1e-8) END", "ratio", 3)},
    {rs("sqrt(abs(l_discount - 0.05))", "root", 6)}, {rs("exp(l_tax)", "grown", 6)} FROM lineitem""")
def p20(spark, sf_dir):
    discount, tax = F.col("l_discount") - 0.05, F.col("l_tax") - 0.02
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r(safe_ratio(discount, tax), "ratio", 3),
        r(F.sqrt(F.abs(discount)), "root", 6), r(F.exp("l_tax"), "grown", 6))


@query("p21_split_fraction", with_views("production weekly", f"""SELECT product, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
    ELSE 'test' END AS split, count(*) AS "rows", {rs("100.0 * count(*) / max(n)", "percent")} FROM weekly GROUP BY 1, 2"""))
def p21(spark, sf_dir):
    out = split_counts(ordered_split(weekly(spark, sf_dir), 0.7), ["product"])
    return out.select("product", "split", "rows", r("percent", "percent"))


# ---- filters -----------------------------------------------------------------------------------

@query("f1_filter_equals", with_views("production", f"""SELECT part_id, count(*) AS n, {rs("avg(price)", "avg_price", 3)}
    FROM production WHERE product = 'PROMO' GROUP BY part_id"""))
def f1(spark, sf_dir):
    # summed by part before the join, so a hot part reaches it as one row
    sums = line_items(spark, sf_dir).groupBy("part_id").agg(F.count("*").alias("m"), F.sum("price").alias("s"), F.count("price").alias("k"))
    kept = sums.join(filters.filter_equals(products(spark, sf_dir), "product", "PROMO"), "part_id")
    return kept.groupBy("part_id").agg(F.sum("m").alias("n"), r(F.sum("s") / F.sum("k"), "avg_price", 3))


SAMPLE = """keys AS (SELECT DISTINCT p_partkey AS part_id FROM part
    ORDER BY md5('42-' || CAST(p_partkey AS VARCHAR)), part_id LIMIT 100)"""


def sampled_parts(spark, sf_dir, k=100, seed=42):
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"))
    return ranking.sample_keys(parts, "part_id", k, seed)


def part_rows(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_id"), "l_orderkey", "l_linenumber", "l_quantity")


@query("f2_keep_sampled_keys", f"""WITH {SAMPLE} SELECT l_partkey AS part_id, l_orderkey, l_linenumber, l_quantity
    FROM lineitem WHERE l_partkey IN (SELECT part_id FROM keys)""")
def f2(spark, sf_dir):
    return filters.keep_keys(part_rows(spark, sf_dir), sampled_parts(spark, sf_dir), "part_id", bounded=True)


@query("f3_rank_threshold", """SELECT p_partkey AS part_id, rank FROM (SELECT p_partkey,
    CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part) WHERE rank <= 100""")
def f3(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return filters.top_ranked(part, [F.col("p_retailprice").desc(), F.col("p_partkey")], 100).select(
        F.col("p_partkey").alias("part_id"), "rank")


@query("f4_drop_missing", with_views("gaps", "SELECT event_id, user_id, v FROM gaps WHERE v IS NOT NULL"))
def f4(spark, sf_dir):
    return filters.drop_missing(gap_events(spark, sf_dir), ["v"]).select("event_id", "user_id", "v")


@query("f5_drop_gap_sequences", with_views("gaps", f"""l AS (SELECT user_id, rn, v, lag(v, 1) OVER w AS a,
    lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY rn))
    SELECT user_id, rn - 3 AS sample, {rs("a + b + c", "total")}, {rs("v", "label")} FROM l
    WHERE rn > 3 AND v IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""))
def f5(spark, sf_dir):
    seq = sequences(positions(gap_events(spark, sf_dir), EVENTS), EVENTS, ["v"], "v", 3)
    whole = filters.drop_gap_sequences(seq, ["v"])
    total = F.aggregate("steps", F.lit(0.0), lambda acc, x: acc + x["v"])
    return whole.select("user_id", "sample", r(total, "total"), r("label", "label"))


@query("f6_min_length", """SELECT l_partkey AS part_id, count(*) AS n, CASE WHEN count(*) > 25 THEN 'ok'
    ELSE 'too_short' END AS status FROM lineitem GROUP BY 1""")
def f6(spark, sf_dir):
    return filters.series_status(part_rows(spark, sf_dir), Series(("part_id",), ("l_orderkey",)), 25)


@query("f6_long_series_rows", """SELECT l_partkey AS part_id, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
    GROUP BY 1 HAVING count(*) > 25""")
def f6_rows(spark, sf_dir):
    rows = filters.min_length(part_rows(spark, sf_dir), Series(("part_id",), ("l_orderkey",)), 25)
    return rows.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("f8_head_rows", with_views("gaps", "SELECT user_id, event_id, v FROM gaps WHERE rn <= 3"))
def f8(spark, sf_dir):
    return filters.head_rows(gap_events(spark, sf_dir), Series(("user_id",), ("ts", "event_id")), 3).select(
        "user_id", "event_id", "v")


# ---- joins -------------------------------------------------------------------------------------

@query("j1_semi_join", f"""WITH {SAMPLE} SELECT l_partkey AS part_id, count(*) AS n, sum(l_quantity) AS quantity
    FROM lineitem SEMI JOIN keys ON l_partkey = part_id GROUP BY 1""")
def j1(spark, sf_dir):
    kept = filters.keep_keys(part_rows(spark, sf_dir), sampled_parts(spark, sf_dir), "part_id", bounded=True)
    return kept.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("j2_attach_columns", with_views("daily inspection", f"""SELECT {days("d.ts")}, {rs("sold", "sold")},
    {rs("accepted", "accepted")} FROM daily d JOIN inspection i ON d.ts = i.ts"""))
def j2(spark, sf_dir):
    from tidemark.plans.tables import inspection
    both = cols.attach_columns(daily_sales(spark, sf_dir), inspection(spark, sf_dir), ["series", "ts"])
    return both.select(day("ts"), r("sold", "sold"), r("accepted", "accepted"))


@query("j3_align_predictions", with_views("prio", f"""SELECT a.series, {days("a.ts")}, {rs("a.revenue", "actual")},
    {rs("b.revenue", "predicted")} FROM prio a JOIN prio b ON a.series = b.series AND b.rn = a.rn - 7"""))
def j3(spark, sf_dir):
    s = Series(("series",), ("ts",))
    df = positions(priority_sales(spark, sf_dir), s)
    predicted = lags(df, s, "revenue", [7], "predicted").filter("rn > 7").select("series", "rn", "predicted7")
    actual = df.select("series", "rn", "ts", "revenue")
    both = cols.align_predictions(predicted, actual, ["series", "rn"])
    return both.select("series", day("ts"), r("revenue", "actual"), r("predicted7", "predicted"))


@query("j4_grid", """WITH lengths AS (SELECT l_partkey AS part_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT part_id, n, CAST(p AS INT) AS p, CAST(d AS INT) AS d, CAST(q AS INT) AS q FROM lengths,
    range(3) a(p), range(2) b(d), range(3) c(q)""")
def j4(spark, sf_dir):
    lengths = part_rows(spark, sf_dir).groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))
    return ranking.grid({"p": [0, 1, 2], "d": [0, 1], "q": [0, 1, 2]}, lengths)


# ---- sorts, limits, set operations -------------------------------------------------------------

@query("t1_order_by_time", with_views("daily", f"SELECT {days('ts')}, {rs('sold', 'sold')} FROM daily ORDER BY ts"))
def t1(spark, sf_dir):
    return ranking.order_by_time(daily_sales(spark, sf_dir), "ts").select(day("ts"), r("sold", "sold"))


@query("t2_order_by_week", with_views("production weekly", f"""SELECT product, year_week, {rs("quantity", "quantity", 6)}
    FROM weekly ORDER BY product, year, week"""))
def t2(spark, sf_dir):
    return weekly(spark, sf_dir).orderBy("product", "year", "week").select(
        "product", "year_week", r("quantity", "quantity", 6))


@query("t4_top_k", with_views("production", f"""SELECT product, part_id, {rs("total", "total", 2)} FROM (SELECT *,
    row_number() OVER (PARTITION BY product ORDER BY total DESC, part_id) AS k FROM (SELECT product, part_id,
    round(sum(price), 2) AS total FROM production GROUP BY 1, 2)) WHERE k <= 5"""))
def t4(spark, sf_dir):
    # summed by part before the join, so a hot part reaches it as one row
    sums = line_items(spark, sf_dir).groupBy("part_id").agg(F.sum("price").alias("s"))
    totals = sums.join(products(spark, sf_dir), "part_id").groupBy("product", "part_id").agg(F.round(F.sum("s"), 2).alias("total"))
    return ranking.top_k(totals, "total", 5, by=["product"], ties=["part_id"]).select(
        "product", "part_id", r("total", "total", 2))


@query("t5_sample_keys", f"WITH {SAMPLE} SELECT part_id FROM keys")
def t5(spark, sf_dir):
    return sampled_parts(spark, sf_dir)


@query("w1_random_rank", f"""SELECT user_id, CAST(row_number() OVER (ORDER BY md5('7-' || CAST(user_id AS VARCHAR)), user_id)
    AS INT) AS rank FROM (SELECT DISTINCT user_id FROM events) QUALIFY rank <= 100""")
def w1(spark, sf_dir):
    users = load(spark, sf_dir, "events").select("user_id").distinct()
    order = [F.md5(F.concat(F.lit("7-"), F.col("user_id").cast("string"))), F.col("user_id")]
    return filters.top_ranked(users, order, 100).select("user_id", "rank")


@query("u2_concat_frames", with_views("prio", f"""SELECT series, fold, {days("ts")}, {rs("revenue", "actual")} FROM (
    SELECT series, 1 AS fold, ts, revenue FROM prio WHERE rn % 2 = 0
    UNION ALL SELECT series, 2, ts, revenue FROM prio WHERE rn % 2 = 1)"""))
def u2(spark, sf_dir):
    s = Series(("series",), ("ts",))
    df = positions(priority_sales(spark, sf_dir), s)
    even = df.filter("rn % 2 = 0").withColumn("fold", F.lit(1))
    odd = df.filter("rn % 2 = 1").withColumn("fold", F.lit(2))
    return ranking.concat_frames(even, odd).select("series", "fold", day("ts"), r("revenue", "actual"))
