"""Ordered operators over many keyed series.

A window over ``(keys) order by (time)`` puts a whole series into one task. That
is right for series with one row per calendar step, whose length is bounded by the
calendar, and wrong for raw rows, where one key may hold a third of the table.
``Series.block_rows`` chooses between the two:

* ``None`` - one window per key (calendar steps);
* a number - the series is cut into blocks of that many consecutive rows and each
  block is one group. Bounded frames see copies of the neighbouring rows; running
  values are carried over from per-block totals. Results are the same.

A null key is a key like any other, in both forms.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.sources.shared import as_table

SALTS = 16


@dataclass(frozen=True)
class Series:
    """How rows form series: key columns, and order columns unique within a key."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    block_rows: int | None = None
    # SQL of a value that never falls along the order, such as the hour: rows are numbered bucket by bucket
    bucket: str | None = None

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def keyed_by(self, *more: str) -> Series:
        return replace(self, keys=(*self.keys, *more))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; ``right`` brings its other columns.

    The keys are compared as one struct, whose fields may be null, so the join stays an equality join
    and shares its partitioning with a window over the same struct.
    """
    at = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return left.withColumn("_on", at).join(right.withColumn("_on", at).drop(*keys), "_on", how).drop("_on")


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], spread: Sequence[str],
           how: str = "left", salts: int = SALTS) -> DataFrame:
    """Put the one-row-per-key columns of ``stats`` beside every row.

    The rows of one key are spread over ``salts`` join keys by a hash of the
    ``spread`` columns, so that a hot key is not one join partition. The salted
    partitioning never serves a later grouping, so adaptive execution is free to
    split partitions that are still too large. A small ``stats`` is broadcast by
    Spark under its own size threshold, known statically or at run time.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_keys(salted, copies, [*keys, "_salt"], how).drop("_salt")


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` and its keys; a frame without keys gets a constant one."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def positions(df: DataFrame, s: Series) -> DataFrame:
    """Add ``rn`` (1-based position in its series) and ``n`` (series length)."""
    if s.block_rows is None:
        return df.withColumn("rn", F.row_number().over(s.window()).cast("long")).withColumn(
            "n", F.count(F.lit(1)).over(Window.partitionBy(*s.keys)))
    if s.bucket is not None:
        return _bucket_positions(df, s)
    ordered = as_table(
        df.repartitionByRange(*s.keys, *s.order)
        .sortWithinPartitions(*s.keys, *s.order)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "ordered")
    # the id carries the range partition in its upper bits and the row in its lower 33
    ordered = ordered.withColumn("_part", F.shiftright("_pos", 33))
    part_keys = [*s.keys, "_part"]
    sizes = ordered.groupBy(*part_keys).agg(
        F.count(F.lit(1)).alias("_m"), F.min("_pos").alias("_first"))
    starts = _offsets(sizes, s.keys, "_part", "_first")
    return join_keys(ordered, starts, part_keys).withColumn(
        "rn", F.col("_before") + F.col("_pos") - F.col("_first") + 1
    ).select(*df.columns, "rn", "n")


def _offsets(sizes: DataFrame, keys: Sequence[str], part: str, *more: str) -> DataFrame:
    """Rows of a key before each of its parts (``_before``) and in all of them (``n``)."""
    by_key = Window.partitionBy(*keys)
    return sizes.select(
        *keys, part, *more,
        F.coalesce(F.sum("_m").over(by_key.orderBy(part).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_m").over(by_key).alias("n"))


def _bucket_positions(df: DataFrame, s: Series) -> DataFrame:
    """Series of at most ``block_rows`` rows are one window each; longer ones are numbered bucket by bucket.

    The keys of longer series, of which there is at most one for ``block_rows`` rows, are counted first and written.
    Rows are shuffled once, those of a short series by its keys, where a later grouping by key finds them.
    """
    sizes = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"))
    long = as_table(sizes.filter(F.col("n") > s.block_rows).select(*s.keys), "long-series")
    if not long.limit(1).count():
        return positions(df, replace(s, block_rows=None))
    short = positions(join_keys(df, long, s.keys, "left_anti"), replace(s, block_rows=None))
    return short.union(_inside_buckets(join_keys(df, long, s.keys, "left_semi"), s))


def _inside_buckets(df: DataFrame, s: Series) -> DataFrame:
    """Numbers inside each (key, bucket), then what comes before the bucket is added.

    Rows are shuffled once; the counts are summed in the map tasks, one row per key and bucket.
    """
    rows = df.withColumn("_bucket", F.expr(s.bucket))
    sizes = rows.groupBy(*s.keys, "_bucket").agg(F.count(F.lit(1)).alias("_m"))
    keys = [*s.keys, "_bucket"]
    at = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    starts = _offsets(sizes, s.keys, "_bucket").select(at.alias("_on"), "_before", "n")
    # the window and the join share the partitioning by the struct of key and bucket
    inside = F.row_number().over(Window.partitionBy("_on").orderBy(*s.order))
    return (rows.withColumn("_on", at).withColumn("_inside", inside).join(starts, "_on")
            .withColumn("rn", F.col("_before") + F.col("_inside")).select(*df.columns, "rn", "n"))


def _block(s: Series) -> Column:
    return F.floor((F.col("rn") - 1) / F.lit(s.block_rows)).cast("long")


def framed(df: DataFrame, s: Series, before: int, after: int,
           columns: Callable[[WindowSpec], Mapping[str, Column]]) -> DataFrame:
    """Add columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` gets the ordered window and returns the new columns. The block
    form needs ``rn`` from :func:`positions`.
    """
    if s.block_rows is None:
        return df.withColumns(columns(s.window()))
    size = s.block_rows
    if max(before, after) > size:
        raise ValueError(f"frame of {max(before, after)} rows exceeds the block of {size}")
    at = F.pmod(F.col("rn") - 1, F.lit(size))
    homes = [F.col("_own")]
    if before:
        homes.append(F.when(at >= size - before, F.col("_own") + 1))
    if after:
        homes.append(F.when(at < after, F.col("_own") - 1))
    spread = df.withColumn("_own", _block(s)).withColumn(
        "_block", F.explode(F.array_compact(F.array(*homes))))
    within = Window.partitionBy(*s.keys, "_block").orderBy("rn")
    return spread.withColumns(columns(within)).filter("_block = _own").drop("_block", "_own")


def running(df: DataFrame, s: Series, sums: Mapping[str, str] | None = None,
            fills: Mapping[str, str] | None = None) -> DataFrame:
    """Add running sums and last-known values from the series start to each row.

    ``sums`` and ``fills`` map a new column to the column it is made of. The block
    form needs ``rn`` from :func:`positions`.
    """
    sums, fills = dict(sums or {}), dict(fills or {})

    def over(w: WindowSpec) -> dict[str, Column]:
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        made = {new: F.sum(old).over(upto) for new, old in sums.items()}
        made |= {new: F.last(old, ignorenulls=True).over(upto) for new, old in fills.items()}
        return made

    if s.block_rows is None:
        return df.withColumns(over(s.window()))
    df = df.withColumn("_block", _block(s))
    block_keys = [*s.keys, "_block"]
    totals = df.groupBy(*block_keys).agg(
        *[F.sum(old).alias(f"_t_{new}") for new, old in sums.items()],
        *[F.max_by(old, F.when(F.col(old).isNotNull(), F.col("rn"))).alias(f"_t_{new}")
          for new, old in fills.items()])
    earlier = Window.partitionBy(*s.keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    carries = totals.select(
        *block_keys,
        *[F.sum(f"_t_{new}").over(earlier).alias(f"_c_{new}") for new in sums],
        *[F.last(f"_t_{new}", ignorenulls=True).over(earlier).alias(f"_c_{new}")
          for new in fills])
    inside = df.withColumns(over(Window.partitionBy(*block_keys).orderBy("rn")))
    out = join_keys(inside, carries, block_keys)
    joined = {new: F.when(F.col(f"_c_{new}").isNull(), F.col(new)).otherwise(
        F.col(f"_c_{new}") + F.coalesce(F.col(new), F.lit(0))) for new in sums}
    joined |= {new: F.coalesce(F.col(new), F.col(f"_c_{new}")) for new in fills}
    return out.withColumns(joined).select(*[c for c in df.columns if c != "_block"],
                                          *sums, *fills)


def difference(df: DataFrame, s: Series, cols: Sequence[str], order: int = 1, lag: int = 1,
               suffix: str = "_diff") -> DataFrame:
    """Difference at ``lag`` (1 regular, s seasonal), repeated ``order`` times.

    Written out with binomial weights, so any order needs one window. The leading
    rows without a full history get null.
    """
    weights = [1.0]
    for _ in range(order):
        weights = [a - b for a, b in zip([*weights, 0.0], [0.0, *weights], strict=True)]

    def made(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in cols:
            total = F.col(c) * F.lit(weights[0])
            for i, weight in enumerate(weights[1:], start=1):
                total = total + F.lag(c, i * lag).over(w) * F.lit(weight)
            out[c + suffix] = total
        return out

    return framed(df, s, order * lag, 0, made)


def log_returns(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Change of ln(x + 1) against the previous row, one ``<col>_ret`` per column."""
    return framed(df, s, 1, 0, lambda w: {
        f"{c}_ret": F.log1p(c) - F.lag(F.log1p(c), 1).over(w) for c in cols})


def cumulative_sum(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Running sum from the series start, one ``<col>_cum`` per column."""
    return running(df, s, sums={f"{c}_cum": c for c in cols})


def split_cumsum(df: DataFrame, s: Series, cols: Sequence[str], train_scale: float = 2.0) -> DataFrame:
    """Running sum that restarts in each ``split``; the train part is scaled."""
    out = cumulative_sum(df, s.keyed_by("split"), cols)
    return out.withColumns({f"{c}_cum": F.when(F.col("split") == "train", F.lit(train_scale))
                            .otherwise(F.lit(1.0)) * F.col(f"{c}_cum") for c in cols})


def forward_fill(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Replace a missing value by the last known one; leading gaps stay missing."""
    out = running(df, s, fills={f"_f_{c}": c for c in cols})
    return out.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def lags(df: DataFrame, s: Series, col: str, steps: Sequence[int], prefix: str = "lag") -> DataFrame:
    """Add ``<prefix><h>``, the value ``h`` rows earlier, for each step."""
    return framed(df, s, max(steps), 0, lambda w: {
        f"{prefix}{h}": F.lag(col, h).over(w) for h in steps})


def autocorrelation(df: DataFrame, s: Series, col: str, max_lag: int) -> DataFrame:
    """One row ``(keys, lag, acf, n)`` per series and lag 1..max_lag; ``df`` has ``rn``."""
    means = df.groupBy(*s.keys).agg(F.avg(col).alias("_mean"), F.count(col).alias("_n"))
    centred = attach(df, means, s.keys, s.order).withColumn("_c", F.col(col) - F.col("_mean"))
    lagged = lags(centred, s, "_c", range(1, max_lag + 1), "_l")
    sums = lagged.groupBy(*s.keys).agg(
        F.max("_n").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_ss"),
        *[F.sum(F.col("_c") * F.col(f"_l{h}")).alias(f"_p{h}") for h in range(1, max_lag + 1)])
    pairs = F.array(*[F.struct(F.lit(h).alias("lag"), F.col(f"_p{h}").alias("p"))
                      for h in range(1, max_lag + 1)])
    return sums.withColumn("_e", F.explode(pairs)).select(
        *s.keys, F.col("_e.lag").alias("lag"),
        F.try_divide(F.col("_e.p"), F.col("_ss")).alias("acf"), "n")


def seasonal_decompose(df: DataFrame, s: Series, col: str, period: int) -> DataFrame:
    """Additive trend, seasonal and residual parts; series of at most 2 periods are left out.

    ``df`` has ``rn`` and ``n``. The trend is the centred moving average, missing at
    both ends; the seasonal part is the phase mean of the detrended values, centred
    to zero over the phases.
    """
    half = period // 2
    df = df.filter(F.col("n") > 2 * period)

    def trend(w: WindowSpec) -> dict[str, Column]:
        full = F.count(col).over(w.rowsBetween(-half, half)) == 2 * half + 1
        if period % 2:
            mean = F.avg(col).over(w.rowsBetween(-half, half))
        else:
            total = F.sum(col).over(w.rowsBetween(-half, half))
            ends = F.lag(col, half).over(w) + F.lead(col, half).over(w)
            mean = (total - ends / 2) / period
        return {"trend": F.when(full, mean)}

    out = framed(df, s, half, half, trend).withColumn("_phase", F.pmod(F.col("rn") - 1, F.lit(period)))
    phases = out.groupBy(*s.keys, "_phase").agg(F.avg(F.col(col) - F.col("trend")).alias("_pm"))
    centred = phases.withColumn(
        "seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy(*s.keys))).drop("_pm")
    return attach(out, centred, [*s.keys, "_phase"], s.order).withColumn(
        "resid", F.col(col) - F.col("trend") - F.col("seasonal")).drop("_phase")
