"""Grouped and whole-table summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clean import missing
from tidemark.functions.calendar import week_year, year_week
from tidemark.operators.ordered import attach, join_keys, keyed
from tidemark.sources.shared import as_table


# sums of a pair: rows with both, each side's values and squares there, products
SUMS = ["_n", "_si", "_sj", "_qi", "_qj", "_p"]


def weekly_mean(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                mode: str = "calendar_year") -> DataFrame:
    """Mean of ``cols`` per key and week, with the label ``year_week``."""
    return df.groupBy(*keys, week_year(ts, mode).alias("year"), F.weekofyear(ts).alias("week")).agg(
        *[F.avg(c).alias(c) for c in cols], F.min(year_week(ts, mode)).alias("year_week"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def profile(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row count, column count and time range in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def unpivot_row(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
                name: str = "column", value: str = "value") -> DataFrame:
    """Columns to rows ``(keys, name, value)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in cols])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def null_profile(df: DataFrame) -> DataFrame:
    """Missing count of each column that has any, in one pass."""
    counts = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in df.columns])
    return unpivot_row(counts, df.columns, value="missing").filter("missing > 0")


def target_correlations(df: DataFrame, target: str, cols: Sequence[str],
                        keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each column with the target over rows where both are known.

    ``(keys, feature, corr, n)``; missing where either side is constant.
    """
    aggs: list[Column] = []
    y = F.col(target)
    for c in cols:
        x = F.col(c)
        own, other = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        # the built-in corr fails on a constant column under ANSI arithmetic
        r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(own)) * F.sqrt(F.var_pop(other)))
        aggs += [r.alias(f"r_{c}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n_{c}")]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r_{c}").alias("corr"),
                              F.col(f"n_{c}").alias("n")) for c in cols])
    return wide.select(*keys, F.explode(rows).alias("_p")).select(*keys, "_p.feature", "_p.corr", "_p.n")


def pairwise_correlations(df: DataFrame, vector: str, width: int, keys: Sequence[str] = (), block: int = 256) -> DataFrame:
    """Pearson correlation of every two places of an array column, each over the rows where both are known.

    ``(keys, i, j, corr, n)`` for i < j; missing where either side is constant or fewer than two rows know both.
    Tasks hold matrices instead of an aggregate for each pair: cross products of the values, of values with the other
    side's presence, of squares with it, and of the presences, missing values counting as 0. Wide arrays are cut
    into blocks of ``block`` places, and each two blocks are one pair of small matrices. Values are taken relative to
    their place's mean first, which keeps the sums short. Null and NaN are missing; a null array is left out.
    """
    df, on = keyed(df, keys)
    known = df.filter(F.col(vector).isNotNull()).select(*on, F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(
        ~F.isnan(x), x)).alias("_v"))
    # one row a key and place
    means = known.select(*on, F.posexplode("_v").alias("_i", "_x")).groupBy(*on, "_i").agg(F.avg("_x").alias("_m")).groupBy(*on).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", F.coalesce("_m", F.lit(0.0))))).alias("_c"))
    centred = attach(known, means, on, ["_v"], how="inner").select(*on, F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("_v", i) - F.element_at("_c", i)).alias("_v"))
    starts = range(0, width, block)
    schema = T.StructType([*[centred.schema[c] for c in on], *[T.StructField(c, T.IntegerType()) for c in ("i", "j")],
                           *[T.StructField(c, T.DoubleType()) for c in SUMS]])
    key_list = list(on)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(key_list, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                x = np.array([np.asarray(v, float) for v in part["_v"]])
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                sums = held.setdefault(key, {})
                for a in starts:
                    for b in starts:
                        if b < a:
                            continue
                        u, v, mu, mv = x[:, a:a + block], x[:, b:b + block], m[:, a:a + block], m[:, b:b + block]
                        new = np.stack([mu.T @ mv, u.T @ mv, mu.T @ v, (u * u).T @ mv, mu.T @ (v * v), u.T @ v])
                        sums[a, b] = sums[a, b] + new if (a, b) in sums else new
        for key, sums in held.items():
            for (a, b), total in sums.items():
                i, j = (g.ravel() for g in np.meshgrid(np.arange(a, a + total.shape[1]), np.arange(b, b + total.shape[2]), indexing="ij"))
                out = pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32")} | {c: total[n].ravel() for n, c in enumerate(SUMS)})
                for c, k in zip(key_list, key):
                    out[c] = k
                yield out[out["i"] < out["j"]][schema.names]

    sums = centred.mapInPandas(partial, schema).groupBy(*on, "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])
    n, si, sj, qi, qj, p = (F.col(c) for c in SUMS)
    spread = F.greatest(n * qi - si * si, F.lit(0.0)) * F.greatest(n * qj - sj * sj, F.lit(0.0))
    # a constant side leaves nothing but rounding
    flat = (n * qi - si * si <= 1e-12 * n * qi) | (n * qj - sj * sj <= 1e-12 * n * qj) | (n < 2)
    return sums.select(*keys, "i", "j", F.when(~flat, (n * p - si * sj) / F.sqrt(spread)).alias("corr"), n.cast("long").alias("n"))


def top_correlations(corr: DataFrame, target: str, n: int, by: str = "positive") -> DataFrame:
    """The ``n`` largest, smallest or absolutely largest correlations, without the target itself."""
    others = corr.filter((F.col("feature") != target) & F.col("corr").isNotNull())
    order = {"positive": F.col("corr").desc(), "negative": F.col("corr").asc(),
             "absolute": F.abs("corr").desc()}[by]
    return others.orderBy(order, "feature").limit(n)


# relative rank error of the first sketch; cells of the later ones; rows of a group that one task may sort
SKETCH, CELLS, SORTED_ROWS = 1000, 128, 1 << 20


def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], sketch: int = SKETCH,
              sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row ``(keys, prob, value)`` each, null for a group without values.

    The built-in exact percentile gathers all distinct values of a group in one task. Here a sketch brackets each
    quantile; a second pass counts, in the map tasks, what lies between the brackets and keeps apart only the values
    inside, which alone are shuffled and sorted. If they would be more than ``sorted_rows`` of a group, sketches of
    the bracketed values narrow the brackets first. A rank that falls outside its bracket is looked up again with
    wider ones. Missing values (null, NaN) take no part.
    """
    found = _with_quantiles(df, keys, col, {}, probs, sketch, sorted_rows)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.get("_q", F.lit(i)).alias("value")) for i, p in enumerate(probs)])
    return found.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.prob", "_p.value")


class _Held:
    """A table of one row a key: written, or without keys its one row on the driver."""

    def __init__(self, df: DataFrame, apart: bool, name: str):
        self.rows = None if apart else df.collect()
        self.frame = as_table(df, name) if apart else df.sparkSession.createDataFrame(self.rows, df.schema)

    def largest(self, col: str) -> int:
        one = self.frame.agg(F.max(col)).first() if self.rows is None else self.rows[0] if self.rows else [None]
        return (one[0] if self.rows is None else one[col] if self.rows else 0) or 0

    def beside(self, rows: DataFrame, on: list[str]) -> DataFrame:
        """``rows`` with the columns of their key; without keys they are literals."""
        if self.rows is None:
            return attach(rows, self.frame, on, ["_v"], how="inner")
        if not self.rows:
            return join_keys(rows, self.frame, on)
        return rows.withColumns({f.name: F.lit(self.rows[0][f.name]).cast(f.dataType) for f in self.frame.schema.fields if f.name not in on})


def _ranks(probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """Lower and upper rank from 0 of each quantile, and the share of the upper."""
    out = []
    for p in probs:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        out.append((F.floor(at), F.ceil(at), at - F.floor(at)))
    return out


def _with_quantiles(df: DataFrame, keys: Sequence[str], col: str, aggs: dict[str, Column], probs: Sequence[float],
                    sketch: int = SKETCH, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """(keys, ``aggs``, _q): one row a key, the exact quantiles in ``_q``. Runs jobs."""
    df, on = keyed(df, keys)
    apart = bool(keys)
    known = df.withColumn("_v", F.when(~missing(df, col), F.col(col).cast("double")))
    rows = known.filter("_v IS NOT NULL").select(*on, "_v")
    slack, result = 2.0 / sketch, None
    edges = [float(x) for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    at = F.percentile_approx("_v", F.array(*map(F.lit, edges)), sketch)
    first = _Held(known.groupBy(*on).agg(*[v.alias(k) for k, v in aggs.items()], F.count("_v").alias("_n"), at.alias("_e")), apart, "brackets")
    # a sketch does not promise the ends
    lo = [F.lit(float("-inf")) if p <= slack else F.get("_e", F.lit(2 * i)) for i, p in enumerate(probs)]
    hi = [F.lit(float("inf")) if p + slack >= 1 else F.get("_e", F.lit(2 * i + 1)) for i, p in enumerate(probs)]
    brackets = _Held(first.frame.filter("_n > 0").select(*on, "_n", F.array(*lo).alias("_lo"), F.array(*hi).alias("_hi")), apart, "brackets")
    inside = 3 * slack * first.largest("_n")
    while inside > sorted_rows:
        brackets = _Held(_narrowed(rows, brackets, on, probs), apart, "brackets")
        inside *= 6 / CELLS
    while True:
        # one row a key and nothing else; null where a rank lay outside its bracket
        ranked = _Held(_ranked(rows, brackets, on, probs), apart, "quantiles")
        result = _merged(result, ranked.frame, on)
        missed = ranked.frame.filter("exists(_q, x -> x IS NULL)")
        if missed.isEmpty() if apart else not any(None in r._q for r in ranked.rows):
            break
        # the brackets that failed give way to all values
        wide = join_keys(brackets.frame, missed.select(*on, F.transform("_q", lambda x: x.isNull()).alias("_m")), on)
        brackets = _Held(wide.select(
            *on, "_n", F.zip_with("_lo", "_m", lambda x, m: F.when(m, float("-inf")).otherwise(x)).alias("_lo"),
            F.zip_with("_hi", "_m", lambda x, m: F.when(m, float("inf")).otherwise(x)).alias("_hi")), apart, "brackets")
    return join_keys(first.frame.select(*on, *aggs), result, on, "left").select(*keys, *aggs, "_q")


def _narrowed(rows: DataFrame, brackets: _Held, on: list[str], probs: Sequence[float]) -> DataFrame:
    """Brackets from sketches of the values inside the former ones, around the cells of the wanted ranks."""
    grid = F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)])
    aggs = [F.max("_n").alias("_n"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    for i in range(len(probs)):
        lo, hi = F.get("_lo", F.lit(i)), F.get("_hi", F.lit(i))
        within = F.col("_v").between(lo, hi)
        aggs += [F.count_if(F.col("_v") < lo).alias(f"_below{i}"), F.count_if(within).alias(f"_in{i}"),
                 F.percentile_approx(F.when(within, F.col("_v")), grid, 10 * CELLS).alias(f"_g{i}")]
    wide = brackets.beside(rows, on).groupBy(*on).agg(*aggs)
    los, his = [], []
    for i, (lower, upper, _) in enumerate(_ranks(probs)):
        first = F.floor((lower - F.col(f"_below{i}")) * CELLS / F.col(f"_in{i}")).cast("int") - 1
        last = F.ceil((upper - F.col(f"_below{i}") + 1) * CELLS / F.col(f"_in{i}")).cast("int") + 1
        los.append(F.when((F.col(f"_in{i}") > 0) & (first > 0), F.get(f"_g{i}", first)).otherwise(F.get("_lo", F.lit(i))))
        his.append(F.when((F.col(f"_in{i}") > 0) & (last < CELLS), F.get(f"_g{i}", last)).otherwise(F.get("_hi", F.lit(i))))
    return wide.select(*on, "_n", F.array(*los).alias("_lo"), F.array(*his).alias("_hi"))


def _ranked(rows: DataFrame, brackets: _Held, on: list[str], probs: Sequence[float]) -> DataFrame:
    """(on, _q): the quantiles that lie in their brackets, null for the others."""
    v = F.col("_v")
    inside, gap = F.lit(False), F.lit(0)
    for i in range(len(probs)):
        inside = inside | v.between(F.get("_lo", F.lit(i)), F.get("_hi", F.lit(i)))
        gap = gap + (F.get("_hi", F.lit(i)) < v).cast("int")
    cells = brackets.beside(rows, on).groupBy(*on, "_n", gap.alias("_gap"), F.when(inside, v).alias("_in")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v"))
    # the gaps between brackets are one row each; what is inside is bounded by the brackets
    upto = cells.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*on).orderBy("_v")))
    aggs = []
    for i, (lower, upper, share) in enumerate(_ranks(probs)):
        held = [F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")), F.col("_in"))) for rank in (lower, upper)]
        aggs += [held[0].alias(f"_l{i}"), held[1].alias(f"_h{i}"), F.max(share).alias(f"_s{i}")]
    value = [F.col(f"_l{i}") + F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}") * (F.col(f"_h{i}") - F.col(f"_l{i}"))).otherwise(0.0)
             for i in range(len(probs))]
    return upto.groupBy(*on).agg(*aggs).select(*on, F.array(*value).alias("_q"))


def _merged(result: DataFrame | None, ranked: DataFrame, on: list[str]) -> DataFrame:
    """The quantiles of all keys, those looked up again in place of the missed ones."""
    if result is None:
        return ranked
    again = ranked.select(*on, F.col("_q").alias("_again"))
    return join_keys(result, again, on, "left").select(*on, F.coalesce("_again", "_q").alias("_q"))


def _summarised(df: DataFrame, keys: Sequence[str], col: str, aggs: dict[str, Column],
                names: dict[str, float], exact: bool) -> DataFrame:
    if not exact:
        return df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()], *[
            F.percentile_approx(col, p, 10000).alias(k) for k, p in names.items()])
    found = _with_quantiles(df, keys, col, aggs, list(names.values()))
    return found.select(*keys, *aggs, *[F.get("_q", F.lit(i)).alias(k) for i, k in enumerate(names)])


def summary(df: DataFrame, col: str, keys: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Mean, sample std, min, max and median."""
    aggs = {"mean": F.avg(col), "std": F.stddev_samp(col), "min": F.min(col), "max": F.max(col)}
    return _summarised(df, keys, col, aggs, {"median": 0.5}, exact)


def describe(df: DataFrame, col: str, keys: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, max and the quartiles."""
    aggs = {"count": F.count(col), "mean": F.avg(col), "std": F.stddev_samp(col),
            "min": F.min(col), "max": F.max(col)}
    return _summarised(df, keys, col, aggs, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact)


def problem_type(df: DataFrame, target: str, keys: Sequence[str] = (), max_classes: int = 10,
                 exact: bool = True) -> DataFrame:
    """Distinct targets, and classification when there are at most ``max_classes``."""
    counted = F.count_distinct(target) if exact else F.approx_count_distinct(target)
    return df.groupBy(*keys).agg(counted.alias("n_distinct")).withColumn(
        "problem", F.when(F.col("n_distinct") <= max_classes, "classification").otherwise("regression"))


def density_histogram(df: DataFrame, col: str, bins: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over min..max with density, and the normal density at the bin centre.

    Every group with a value has all ``bins`` bins, empty ones too; the last bin is closed. A constant group spans
    half a unit to either side of its value and has no normal density.
    """
    df, on = keyed(df, keys)
    lo, hi = F.min(col).cast("double"), F.max(col).cast("double")
    stats = df.groupBy(*on).agg(
        F.when(hi > lo, lo).otherwise(lo - 0.5).alias("_lo"), F.when(hi > lo, hi).otherwise(hi + 0.5).alias("_hi"),
        F.count(col).alias("_n"), F.avg(col).alias("_mu"), F.stddev_samp(col).alias("_sd")).filter("_n > 0")
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = attach(df.filter(F.col(col).isNotNull()).select(*on, col), stats.select(*on, "_lo", "_hi"), on, [col], how="inner")
    at = F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))
    # at most ``bins`` partial counts of a group leave a map task
    counts = rows.groupBy(*on, at.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    every = stats.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    binned = join_keys(every, counts, [*on, "bin"], "left").withColumn("count", F.coalesce("_c", F.lit(0).cast("bigint")))
    centre = F.col("_lo") + (F.col("bin") + 0.5) * width
    z = F.try_divide(centre - F.col("_mu"), F.col("_sd"))
    return binned.select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "count",
        (F.col("count") / (F.col("_n") * width)).alias("density"),
        F.try_divide(F.exp(-z * z / 2), F.col("_sd") * F.sqrt(2 * F.pi())).alias("normal_density"))
