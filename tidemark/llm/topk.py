"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.sources.shared import as_table

# rows of a block of vectors, and the most bytes of query blocks sent to every executor at once
BLOCK, SENT_BYTES = 1024, 8 << 20
BINS = 256
HALF = 1 << 63


def quantize(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", factor: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>): floor(factor * x) of every component, x as double. Rows with a null id or vector,
    or a null or non-finite component, are left out."""
    named = pick(vectors, vec_id=f"{vec_id} bigint", v=f"{embedding} array<double>")
    # NaN and the infinities are not below the largest double; a null makes the condition null
    whole = "vec_id IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) <= 1.7976931348623157E308D)"
    return named.where(whole).select("vec_id", F.expr(f"transform(v, x -> CAST(floor({factor} * x) AS BIGINT))").alias("v"))


def _blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(ids binary, values binary, n int, dim int): up to ``size`` vectors of one length in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            ids = np.array([i for i, _ in part], "<i8").tobytes()
            values = np.array([v for _, v in part], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([values], pa.binary()),
                                               pa.array([len(part)], pa.int32()), pa.array([dim], pa.int32())],
                                              names=["ids", "vals", "n", "dim"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "ids binary, vals binary, n int, dim int")


def _matrix(values: bytes, n: int, dim: int, wide: bool) -> np.ndarray:
    m = np.frombuffer(values, "<i8").reshape(n, dim)
    return m if wide else m.astype(np.float64)


def _scores(q: np.ndarray, c: np.ndarray, own: np.ndarray, bound: int) -> np.ndarray:
    """Integer inner products plus ``bound``, unsigned: by floating point where all sums stay below 2^52, else by integers.

    Integers wrap around, so a score that fits 64 bits is right whatever its terms are. Where the bound allows larger
    ones, scores near the limit are worked out in whole; a score beyond it, but for that of a vector with itself, raises.
    """
    score = (q @ c.T).astype(np.int64)
    if bound == HALF:
        near = (np.abs(q.astype(np.float64) @ c.T.astype(np.float64)) > 0.99 * HALF) & ~own
        for i, j in zip(*np.nonzero(near)):
            if not -HALF <= sum(int(a) * int(b) for a, b in zip(q[i], c[j])) < HALF:
                raise OverflowError("a score does not fit 64 bits")
    return score.view(np.uint64) + np.uint64(bound)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding",
          factor: int = 256, sent_bytes: int = SENT_BYTES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank int, vec_id, score): the ``k`` largest integer inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates all rows of another id and the same length;
    fewer than k candidates: all of them. Rows with nulls or non-finite components take no part (:func:`quantize`).
    Of rows alike in id one is the query (the smallest vector), all are candidates. Empty table: no rows. A score that
    does not fit 64 bits raises an error, and so does a component of 2^63 or more after scaling.

    Queries go to the executors in groups of blocks of at most ``sent_bytes``, and candidates stream by in blocks.
    Every pass scores everything. The first passes count scores in ``BINS`` bins of each query's open range, which
    shrinks to the bin of the k-th largest score, until it is one value; the last pass keeps what lies above it
    and, of the ties at it, each task's k smallest ids, which hold the k smallest of all.
    """
    spark = vectors.sparkSession
    rows = as_table(quantize(vectors, vec_id, embedding, factor), "topk-rows")
    cands = as_table(_blocks(rows, block), "topk-candidates")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    # the numbers are written with the blocks, so all passes see the same ones
    qblocks = as_table(_blocks(asked, min(block, 256)).withColumn("qb", F.monotonically_increasing_id()), "topk-queries")
    sizes = qblocks.select("qb", F.length("vals").alias("b")).orderBy("qb").collect()  # one row per 256 queries
    largest = rows.select(F.max(F.expr("aggregate(v, 0L, (a, x) -> greatest(a, abs(x)))")).alias("m"),
                          F.max(F.size("v")).alias("d")).first()
    if not sizes or largest.m is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if largest.m == HALF - 1:
        raise OverflowError("a component does not fit 64 bits")
    # no score is beyond the bound in either direction; from 2^62 on all 64 bits are searched
    bound = int(largest.m) ** 2 * int(largest.d)
    wide = bound >= 2 ** 52
    bound = HALF if bound >= 2 ** 62 else bound
    groups, held = [[]], 0
    for r in sizes:
        if groups[-1] and held + r.b > sent_bytes:
            groups.append([])
            held = 0
        groups[-1].append(r.qb)
        held += r.b
    found = None
    for g in groups:
        part = _group(cands, qblocks.where(F.col("qb").between(g[0], g[-1])), k, bound, wide)
        found = part if found is None else found.union(part)
    return found


def _group(cands: DataFrame, queries: DataFrame, k: int, bound: int, wide: bool) -> DataFrame:
    """:func:`top_k` for one group of query blocks, whose size the caller has bounded."""
    span = 1
    while span < min(2 * bound + 1, 1 << 64):
        span *= BINS
    # per query: the open range [low, low + span) and the number of candidates still wanted inside it
    state = queries.withColumn("low", F.lit(None).cast("binary")).withColumn("want", F.lit(None).cast("binary"))
    state = as_table(state, "topk-state")
    while span > 1:
        state = as_table(_narrow(cands, state, k, bound, span, wide), "topk-state")
        span //= BINS
    return _take(cands, state, k, bound, wide)


def _pairs(cands: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """Each candidate block next to each block of the query group. The group is at most ``sent_bytes`` large."""
    sent = state.select(*[F.col(c).alias(f"q_{c}") for c in columns])
    return cands.join(F.broadcast(sent), F.col("dim") == F.col("q_dim"))


def _ranges(low: bytes | None, want: bytes | None, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each query's open range starts, counted from the least possible score, and how many are wanted from it."""
    if low is None:
        return np.zeros(n, np.uint64), np.full(n, k, np.int64)
    return np.frombuffer(low, "<u8"), np.frombuffer(want, "<i8")


def _narrow(cands: DataFrame, state: DataFrame, k: int, bound: int, span: int, wide: bool) -> DataFrame:
    step = span // BINS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for ids, values, n, dim, qb, q_ids, q_values, q_n, low, want in zip(*(c.to_pylist() for c in b.columns)):
                low, _ = _ranges(low, want, q_n, k)
                own = np.frombuffer(q_ids, "<i8")[:, None] == np.frombuffer(ids, "<i8")[None, :]
                score = _scores(_matrix(q_values, q_n, dim, wide), _matrix(values, n, dim, wide), own, bound)
                at = score - low[:, None]
                inside = (score >= low[:, None]) & (at <= np.uint64(span - 1)) & ~own
                cell = ((at // np.uint64(step)).astype(np.int64) + BINS * np.arange(q_n)[:, None])[inside]
                add = np.bincount(cell, minlength=BINS * q_n)
                seen[qb] = seen[qb] + add if qb in seen else add
        for qb, total in seen.items():
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), qb)), pa.array(cell), pa.array(total[cell])],
                                             names=["qb", "cell", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows, wants = [], []
            for n, low, want, cells, counts in zip(*(b.column(c).to_pylist() for c in ("n", "low", "want", "cells", "counts"))):
                low, want = _ranges(low, want, n, k)
                table = np.zeros(BINS * n, np.int64)
                if cells:
                    table[cells] = counts
                # from the largest bin down: the first whose running count reaches the wanted number
                down = np.cumsum(table.reshape(n, BINS)[:, ::-1], axis=1)
                short = down[:, -1] < want  # fewer candidates than wanted: the lowest bin, all are taken
                pick_ = np.where(short, BINS - 1, np.argmax(down >= want[:, None], axis=1))
                before = np.where(pick_ > 0, down[np.arange(n), np.maximum(pick_ - 1, 0)], 0)
                lows.append((low + (BINS - 1 - pick_).astype(np.uint64) * np.uint64(step)).astype("<u8").tobytes())
                wants.append((want - before).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("qb", "ids", "vals", "n", "dim")],
                                              pa.array(lows, pa.binary()), pa.array(wants, pa.binary())],
                                             names=["qb", "ids", "vals", "n", "dim", "low", "want"])

    pairs = _pairs(cands, state, ["qb", "ids", "vals", "n", "dim", "low", "want"])
    counts = (pairs.select("ids", "vals", "n", "dim", "q_qb", "q_ids", "q_vals", "q_n", "q_low", "q_want")
              .mapInArrow(count, "qb bigint, cell bigint, n bigint").groupBy("qb", "cell").agg(F.sum("n").alias("n")))
    # at most BINS counts for each of a block's 256 queries
    lists = counts.groupBy("qb").agg(F.collect_list(F.struct("cell", "n")).alias("h"))
    joined = state.join(lists, "qb", "left").select("qb", "ids", "vals", "n", "dim", "low", "want",
                                                    F.col("h.cell").alias("cells"), F.col("h.n").alias("counts"))
    return joined.mapInArrow(choose, "qb bigint, ids binary, vals binary, n int, dim int, low binary, want binary")


def _take(cands: DataFrame, state: DataFrame, k: int, bound: int, wide: bool) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for ids, values, n, dim, q_ids, q_values, q_n, low, want in zip(*(c.to_pylist() for c in b.columns)):
                low, _ = _ranges(low, want, q_n, k)
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                own = q_ids[:, None] == ids[None, :]
                score = _scores(_matrix(q_values, q_n, dim, wide), _matrix(values, n, dim, wide), own, bound)
                qi, ci = np.nonzero((score >= low[:, None]) & ~own)
                score = (score - np.uint64(bound)).view(np.int64)
                for q, c in _runs(qi, ci):
                    # not the negative, which the least integer lacks
                    new = np.stack([~score[q, c], ids[c]])
                    old = best.get(int(q_ids[q]))
                    new = new if old is None else np.concatenate([old, new], axis=1)
                    best[int(q_ids[q])] = new[:, np.lexsort((new[1], new[0]))[:k]]
        for q, kept in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.shape[1], q)), pa.array(kept[1]), pa.array(~kept[0])],
                                             names=["query_id", "vec_id", "score"])

    pairs = _pairs(cands, state, ["ids", "vals", "n", "dim", "low", "want"])
    kept = (pairs.select("ids", "vals", "n", "dim", "q_ids", "q_vals", "q_n", "q_low", "q_want")
            .mapInArrow(keep, "query_id bigint, vec_id bigint, score bigint"))
    # each task gives at most k rows of a query
    best = kept.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("m"), "vec_id"))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.bitwise_not("x.m").alias("score"))


def _runs(q: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Column numbers by row of a sorted list of cells."""
    if len(q):
        cuts = np.flatnonzero(np.diff(q)) + 1
        for part in np.split(np.arange(len(q)), cuts):
            yield int(q[part[0]]), c[part]
