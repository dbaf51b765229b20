"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, row_hash, spare, utf8
from tidemark.llm.graph import components
from tidemark.sources.shared import as_table

SHINGLE, BITS, SEED = 4, 4, 42
# fingerprints of one block compared with one another inside a task; larger blocks go another way
DENSE = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of UTF-8 text: a bit is 1 if set in over half of the shingle hashes.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: A-Z, and the blanks 0x20 and 0x09-0x0D.
    """
    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    stop = end[shingle - 1:].tolist() if len(words) >= shingle else [len(line)]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 32768):
        h = np.array([digest(line[a:b], seed) for a, b in zip(start[at:at + 32768], stop[at:at + 32768])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per document, ``fp`` the 64 bits as a signed long.

    Null or blank text gives 0; fewer words than a shingle: all of them are the one shingle. Any length,
    null or repeated ids are taken as they are; further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string").mapInArrow(run, "doc_id bigint, fp bigint")


def blocks_for(count: int, bits: int = BITS) -> int:
    """Blocks to cut 64 bits into, so that ``blocks - bits`` of them still tell ``count`` fingerprints apart."""
    want = min(40, max(1, count).bit_length() + 2)
    return next(b for b in range(bits + 1, 65) if (b - bits) * (64 // b) >= want or b >= 2 * bits + 2)


def block_masks(blocks: int, bits: int = BITS) -> list[int]:
    """Masks of each choice of ``blocks - bits`` blocks: fingerprints that differ in at most ``bits`` bits
    agree in all bits of at least one mask."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - bits)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _forest(values: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of ``values`` (unsigned), two being tied if they differ in at most ``bits`` bits."""
    left, near = [], []
    rest = values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            close = np.bitwise_count(rest ^ x) <= bits
            if close.any():
                found, rest = rest[close], rest[~close]
                left += [x] * len(found)
                near += found.tolist()
                queue += list(found)
    return [int(x) for x in left], near


def links(fps: DataFrame, bits: int = BITS, blocks: int | None = None, dense: int = DENSE) -> DataFrame:
    """(u, v): enough pairs of distinct fingerprints at most ``bits`` apart to tie every group together.

    ``fps`` has a column ``fp`` of distinct values. Each fingerprint goes to the blocks of
    :func:`block_masks`; a block of two is compared at once, one of up to ``dense`` in a task, which gives
    the edges of a spanning forest and not all pairs. Fingerprints of a larger block meet in midpoints:
    two are at most 2k bits apart exactly if they have a common neighbour at most k bits from each, so
    all flips of up to half the bits are listed and grouped by value, in linear size. No pair is lost.
    """
    blocks = blocks or blocks_for(fps.count(), bits)
    masks = [_signed(m) for m in block_masks(blocks, bits)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "key"))
    full = keyed.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    full = as_table(full, "simhash-blocks")
    twos = full.where(f"n = 2 AND bit_count(u ^ v) <= {bits}").select("u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0):
                u, v = _forest(block.values.to_numpy(zero_copy_only=False).view(np.uint64), bits)
                pair = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)]
                yield pa.RecordBatch.from_arrays(pair, names=["u", "v"])

    # a block is one row: adaptive execution may split a partition of the join, and with it a block, but not a group
    some = full.where(f"n BETWEEN 3 AND {dense}").select("k", "key")
    near = (keyed.join(some, ["k", "key"]).groupBy("k", "key").agg(F.collect_list("fp").alias("block")).select("block")
            .mapInArrow(run, "u bigint, v bigint"))
    pairs = twos.union(near)
    if full.where(f"n > {dense}").limit(1).count():
        hot = keyed.join(full.where(f"n > {dense}").select("k", "key"), ["k", "key"]).select("fp").distinct()
        pairs = pairs.union(_by_midpoints(hot, bits))
    return pairs


def _by_midpoints(hot: DataFrame, bits: int) -> DataFrame:
    """Ties between fingerprints through common neighbours: two are at most ``bits`` apart exactly if some point is
    within bits // 2 of one and within the rest of the other. All that meet in a point are tied to its least."""
    few, many = bits // 2, bits - bits // 2
    flips = [f"{n}:{_signed(sum(1 << b for b in c))}" for n in range(many + 1) for c in combinations(range(64), n)]
    points = (hot.select("fp", F.explode(F.split(F.lit(",".join(flips)), ",")).alias("f"))
              .selectExpr("fp", "CAST(substring_index(f, ':', 1) AS INT) AS flips",
                          "fp ^ CAST(substring_index(f, ':', -1) AS BIGINT) AS point"))
    least = points.where(f"flips <= {few}").groupBy("point").agg(F.min("fp").alias("v"))
    return points.join(least, "point").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bits: int = BITS, blocks: int | None = None, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over fingerprints at most ``bits`` apart.
    Equal fingerprints are one node, so copies never multiply. Texts without words have fingerprint 0 and
    are tied like any other. Null ids keep their row and are never a component_id, unless a component has
    no other: then it is null. Repeated rows each give a row. An empty table gives no rows.
    """
    rows = as_table(fingerprints(docs, doc_id, text, shingle), "simhash-rows")
    return rows.join(component_of(rows, bits, blocks, dense), "fp", "left").select("doc_id", "fp", "component_id")


def component_of(rows: DataFrame, bits: int = BITS, blocks: int | None = None, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp) -> (fp, root, component_id), one row per distinct fingerprint; ``root`` is never null."""
    fps = as_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps.select("fp"), bits, blocks, dense), "simhash-components")
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(named, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), then of the smallest row hash;
    of rows alike in every column one. All columns stay."""
    mark = spare(docs, "row_mark")
    marked = docs.withColumn(mark, row_hash(docs))
    rows = as_table(_with_mark(marked, doc_id, text, mark, shingle), "simhash-marked")
    same = rows.groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("n"))
    best = (same.join(component_of(rows.select("doc_id", "fp"), bits), "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "n")).alias("b"))
            .select(F.col("b.mark").alias(mark), F.col("b.n").alias("n")))
    best = as_table(best.groupBy(mark).agg(F.max("n").alias("n")), "simhash-kept")
    kept = marked.join(best.where("n = 1").select(mark), mark, "left_semi")
    if best.where("n > 1").limit(1).count():  # rows alike in every column: only then a second pass
        twins = marked.join(best.where("n > 1").select(mark), mark, "left_semi").dropDuplicates([mark])
        kept = kept.unionByName(twins)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def _with_mark(marked: DataFrame, doc_id: str, text: str, mark: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())],
                                             names=["doc_id", "mark", "fp"])

    return (pick(marked, doc_id=f"{doc_id} bigint", mark=f"{mark} bigint", text=f"{text} string")
            .mapInArrow(run, "doc_id bigint, mark bigint, fp bigint"))
