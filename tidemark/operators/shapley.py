"""Shapley values of any MLlib model, by scoring mixed rows in one transform.

A mixed row takes some inputs from the explained row and the rest from a background
row. Every mixed row's score enters the values linearly, so scores are summed as they
are made, in the map tasks, and no coalition table is kept. Background rows are drawn out of
all rows of the group, one for each draw or order, by a join on their number.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Series, attach, join_keys, positions

Score = Callable[[DataFrame], DataFrame]

MAX_EXACT = 10


def regression_score(model) -> Score:
    """Scores ``fx`` = array with the prediction of a fitted regressor."""
    return lambda df: model.transform(df).withColumn("fx", F.array("prediction"))


def class_score(model) -> Score:
    """Scores ``fx`` = class probabilities of a fitted classifier."""
    return lambda df: model.transform(df).withColumn("fx", vector_to_array("probability"))


def background_table(df: DataFrame, group: Sequence[str], order: Sequence[str],
                     block_rows: int | None = 1 << 14) -> DataFrame:
    """Every row's vector under its number in its group: ``(group, _no, _n, _b)``, from 0, with the group's size.

    Numbers come from partition totals (:func:`tidemark.operators.ordered.positions`), so a group of any size is
    never one list or one window; ``order`` must be unique within a group. ``block_rows=None`` is for groups that a
    calendar bounds.
    """
    named = df.select(*dict.fromkeys([*group, *order]), vector_to_array("features").alias("_b"))
    at = positions(named, Series(tuple(group), tuple(order), block_rows))
    return at.select(*group, (F.col("rn") - 1).alias("_no"), F.col("n").alias("_n"), "_b")


def _draws(rows: DataFrame, background: DataFrame, ids: Sequence[str], group: Sequence[str], n: int, seed: int) -> DataFrame:
    """Each explained row ``n`` times, ``_draw`` = 0, 1, ..., beside a background row of its group, drawn out of all.

    The number drawn is the md5 of seed, ids and ``_draw``, so it depends on nothing else.
    """
    x = rows.select(*dict.fromkeys([*ids, *group]), vector_to_array("features").alias("_x"))
    # sizes are the same in all rows of a group; no row is a group of its own, so the sums are made in the map tasks
    sizes = background.groupBy(*group).agg(F.max("_n").alias("_n"))
    drawn = attach(x, sizes, group, ids, how="inner").withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *ids, "_draw").cast("binary"))
    drawn = drawn.withColumn("_no", F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.col("_n")))
    both = join_keys(drawn.drop("_n"), background.drop("_n"), [*group, "_no"])
    # few rows become very many: spread them before they multiply
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.select(*ids, "_draw", "_x", "_b").repartition(tasks, *ids)


def _mixed(df: DataFrame, takes: Callable[[Column], Column]) -> DataFrame:
    """Add the mixed ``features``; ``takes(j)`` says if input j comes from the explained row."""
    mixed = F.transform("_x", lambda v, j: F.when(takes(j), v).otherwise(F.get("_b", j)))
    return df.withColumn("features", array_to_vector(mixed))


def shapley_exact(rows: DataFrame, background: DataFrame, ids: Sequence[str], group: Sequence[str],
                  names: Sequence[str], score: Score, outputs: int = 1, draws: int = 20, seed: int = 0) -> DataFrame:
    """Values over all 2^F coalitions, for at most 10 inputs; :func:`shapley_coalitions` takes more.

    ``rows`` has ids, group and ``features``; ``background`` comes from :func:`background_table`. An explained row
    is held against ``draws`` rows drawn out of all of its group. Result: ``(ids, output, feature, phi,
    base_value, fx)``, where the phi of a row sum to fx - base_value.
    """
    width = len(names)
    if width > MAX_EXACT:
        raise ValueError(f"{width} inputs need shapley_coalitions or shapley_sampled")
    full = 2 ** width - 1
    each = _draws(rows, background, ids, group, draws, seed).withColumn("_mask", F.explode(
        F.sequence(F.lit(0), F.lit(full))))
    mixed = _mixed(each, lambda j: F.call_function("getbit", F.col("_mask"), j.cast("int")) == 1)
    scored = score(mixed.select(*ids, "_mask", "features"))
    # weight of a coalition of k inputs when one more joins
    weight = F.array(*[F.lit(math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width))
                       for k in range(width)], F.lit(0.0))
    members = F.bit_count("_mask")

    def share(j: int) -> Column:
        inside = F.col("_mask").bitwiseAND(F.lit(1 << j)) != 0
        return F.when(inside, F.get(weight, members - 1)).otherwise(-F.get(weight, members))

    sums = []
    for c in range(outputs):
        fx = F.get("fx", F.lit(c)) / draws
        sums += [F.sum(share(j) * fx).alias(f"_phi{c}_{j}") for j in range(width)]
        sums += [F.sum(F.when(F.col("_mask") == 0, fx)).alias(f"_base{c}"),
                 F.sum(F.when(F.col("_mask") == full, fx)).alias(f"_fx{c}")]
    wide = scored.groupBy(*ids).agg(*sums)
    values = F.array(*[F.struct(
        F.lit(c).alias("output"), F.lit(name).alias("feature"), F.col(f"_phi{c}_{j}").alias("phi"),
        F.col(f"_base{c}").alias("base_value"), F.col(f"_fx{c}").alias("fx"))
        for c in range(outputs) for j, name in enumerate(names)])
    return wide.select(*ids, F.explode(values).alias("_v")).select(*ids, "_v.*")


def coalition_design(width: int, budget: int, seed: int = 0) -> tuple[list[str], np.ndarray]:
    """Coalitions as strings of 0 and 1, and their weights in the regression; neither the empty nor the full one.

    A coalition of s inputs has the Shapley kernel's weight (F - 1) / (C(F, s) s (F - s)). Sizes are taken whole
    from the outside in, s with F - s, as long as the budget lasts. What is left of it draws coalitions of the
    inner sizes by hash, in proportion to the kernel and each with its complement; they share the inner weight.
    """
    def share(s: int) -> float:
        return (width - 1) / (s * (width - s))

    found: dict[int, float] = {}
    size, left, full = 1, budget, 2 ** width - 1
    while 2 * size <= width:
        pair = {size, width - size}
        count = len(pair) * math.comb(width, size)
        if count > left:
            break
        for s in pair:
            for chosen in itertools.combinations(range(width), s):
                found[sum(1 << j for j in chosen)] = share(s) / math.comb(width, s)
        left -= count
        size += 1
    inner = list(range(size, width - size + 1))
    if inner and left > 1:
        upto = np.cumsum([share(s) for s in inner])
        drawn: dict[int, int] = {}
        for i in range(left // 2):
            at = int(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:12], 16) / 16 ** 12 * upto[-1]
            s = inner[min(int(np.searchsorted(upto, at, side="right")), len(inner) - 1)]
            order = sorted(range(width), key=lambda j: hashlib.md5(f"{seed}-{i}-{j}".encode()).hexdigest())
            mask = sum(1 << j for j in order[:s])
            for m in (mask, full - mask):
                drawn[m] = drawn.get(m, 0) + 1
        for m, times in drawn.items():
            found[m] = upto[-1] * times / (left // 2 * 2)
    masks = sorted(found)
    return [format(m, f"0{width}b")[::-1] for m in masks], np.array([found[m] for m in masks])


def _solution(masks: Sequence[str], weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The regression solved once for all rows: phi = k @ b - k0 * base + c * (fx - base), with b_j the weighted
    sum of the scores of the coalitions that hold j. The phi are bound to sum to fx - base."""
    z = np.array([[c == "1" for c in m] for m in masks], float).reshape(len(masks), width)
    p = np.linalg.pinv(z.T @ (z * weights[:, None])) if len(masks) else np.eye(width)
    ones = np.ones(width)
    c = p @ ones / (ones @ p @ ones)
    k = p - np.outer(c, ones @ p)
    return k, k @ (z.T @ weights), c


def shapley_coalitions(rows: DataFrame, background: DataFrame, ids: Sequence[str], group: Sequence[str],
                       names: Sequence[str], score: Score, outputs: int = 1, draws: int = 20, budget: int = 2048,
                       seed: int = 0) -> DataFrame:
    """Values by weighted least squares over ``budget`` coalitions, for any number of inputs.

    The values of a row are the weights of a linear model of its coalitions' mean scores, under the kernel that makes
    them Shapley values, bound to sum to fx - base_value. All rows share the coalitions, so one small matrix is
    solved on the driver and a row's values are sums of its scores. With a budget of 2^F - 2 they equal
    :func:`shapley_exact`; they are exact for any budget of at least 2 F if the scorer is additive.
    """
    width = len(names)
    masks, weights = coalition_design(width, budget, seed)
    k, k0, c = _solution(masks, weights, width)
    # the empty and the full coalition come first
    all_masks = F.split(F.lit(",".join(["0" * width, "1" * width, *masks])), ",")
    all_weights = F.split(F.lit(",".join(map(repr, [0.0, 0.0, *weights.tolist()]))), ",").cast("array<double>")
    each = _draws(rows, background, ids, group, draws, seed).withColumn(
        "_z", F.explode(F.sequence(F.lit(0), F.lit(len(masks) + 1)))).withColumn("_mask", F.get(all_masks, F.col("_z")))
    mixed = _mixed(each, lambda j: F.substr("_mask", j + 1, F.lit(1)) == "1")
    scored = score(mixed.select(*ids, "_z", "_mask", "features")).withColumn("_w", F.get(all_weights, F.col("_z")))
    sums = []
    for o in range(outputs):
        fx = F.get("fx", F.lit(o)) / draws
        sums += [F.sum(F.when(F.substring("_mask", j + 1, 1) == "1", F.col("_w") * fx).otherwise(0.0)).alias(f"_b{o}_{j}")
                 for j in range(width)]
        sums += [F.sum(F.when(F.col("_z") == 0, fx)).alias(f"_base{o}"), F.sum(F.when(F.col("_z") == 1, fx)).alias(f"_fx{o}")]
    wide = scored.groupBy(*ids).agg(*sums)
    matrix = F.from_json(F.lit(json.dumps([[*k[j].tolist(), float(k0[j]), float(c[j])] for j in range(width)])),
                         "array<array<double>>")
    labels = F.array(*[F.lit(n) for n in names])
    values = []
    for o in range(outputs):
        base, fx = F.col(f"_base{o}"), F.col(f"_fx{o}")
        terms = F.array(*[F.col(f"_b{o}_{j}") for j in range(width)], -base, fx - base)
        phi = F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, terms, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
        values.append(F.transform(F.arrays_zip(labels.alias("feature"), phi.alias("phi")), lambda v: F.struct(
            F.lit(o).alias("output"), v["feature"].alias("feature"), v["phi"].alias("phi"), base.alias("base_value"), fx.alias("fx"))))
    return wide.select(*ids, F.explode(F.concat(*values)).alias("_v")).select(*ids, "_v.*")


def shapley(rows: DataFrame, background: DataFrame, ids: Sequence[str], group: Sequence[str], names: Sequence[str],
            score: Score, outputs: int = 1, draws: int = 20, budget: int = 2048, seed: int = 0) -> DataFrame:
    """All coalitions for up to 10 inputs, weighted coalitions for more."""
    if len(names) <= MAX_EXACT:
        return shapley_exact(rows, background, ids, group, names, score, outputs, draws, seed)
    return shapley_coalitions(rows, background, ids, group, names, score, outputs, draws, budget, seed)


def shapley_sampled(rows: DataFrame, background: DataFrame, ids: Sequence[str], group: Sequence[str],
                    names: Sequence[str], score: Score, n_perm: int = 32, seed: int = 0) -> DataFrame:
    """Values averaged over seeded random input orders; first output only.

    Each order adds the inputs of the explained row one by one to a background row of its own, drawn out of all.
    Orders are drawn by hashing, so they do not depend on partitioning. The phi of a
    row sum exactly to fx - base_value.
    """
    width = len(names)
    draws = _draws(rows, background, ids, group, n_perm, seed).withColumnRenamed("_draw", "_perm")
    keyed = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.struct(
        F.xxhash64(F.lit(seed), *ids, F.col("_perm"), j).alias("h"), j.alias("j")))
    draws = draws.withColumn("_order", F.transform(F.array_sort(keyed), lambda e: e["j"]))
    draws = draws.withColumn("_rank", F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.array_position("_order", j)))
    each = draws.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    mixed = _mixed(each, lambda j: F.get("_rank", j) <= F.col("_step"))
    step = F.col("_step")
    mixed = mixed.select(*ids, "features", step, F.get("_order", step - 1).alias("_in"),
                         F.get("_order", step).alias("_next"))
    scored = score(mixed).withColumn("_f", F.get("fx", F.lit(0)) / n_perm)
    # the score after an input joined counts for it, and against the input that joins next
    terms = F.array_compact(F.array(
        F.when(step > 0, F.struct(F.col("_in").alias("j"), F.col("_f").alias("v"))),
        F.when(step < width, F.struct(F.col("_next").alias("j"), (-F.col("_f")).alias("v"))),
        F.when(step == 0, F.struct(F.lit(-1).alias("j"), F.col("_f").alias("v"))),
        F.when(step == width, F.struct(F.lit(-2).alias("j"), F.col("_f").alias("v")))))
    sums = scored.select(*ids, F.explode(terms).alias("_t")).groupBy(*ids, F.col("_t.j").alias("_j")).agg(
        F.sum("_t.v").alias("_v"))
    # width + 2 sums per explained row
    per_row = sums.groupBy(*ids).agg(
        F.max(F.when(F.col("_j") == -1, F.col("_v"))).alias("base_value"),
        F.max(F.when(F.col("_j") == -2, F.col("_v"))).alias("fx"),
        F.collect_list(F.when(F.col("_j") >= 0, F.struct("_j", "_v"))).alias("_all"))
    labels = F.array(*[F.lit(n) for n in names])
    return per_row.select(*ids, "base_value", "fx", F.explode("_all").alias("_a")).select(
        *ids, F.lit(0).alias("output"), F.get(labels, F.col("_a._j")).alias("feature"),
        F.col("_a._v").alias("phi"), "base_value", "fx")


def split_step_names(phi: DataFrame) -> DataFrame:
    """Turn window input names ``<feature>_t-<lag>`` into ``feature`` and ``lag`` columns."""
    at = F.regexp_extract("feature", r"^(.*)_t-(\d+)$", 2).cast("int")
    return phi.withColumn("lag", at).withColumn(
        "feature", F.regexp_extract("feature", r"^(.*)_t-(\d+)$", 1))
