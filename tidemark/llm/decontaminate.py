"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, spare, strings
from tidemark.sources.shared import as_table

SEED_WORDS, COVERAGE = 5, 0.6
# bits of the filter of benchmark seeds that every executor holds: 2 MB, whatever the benchmark
FILTER_BITS = 1 << 24
_WORD = re.compile(r"\w+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word: runs of letters, digits and underscores in lower case."""
    words = _WORD.findall(text.lower())
    if len(_known) > 150_000:
        _known.clear()
    for w in set(words):
        if w not in _known:
            _known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _FACTOR + words[k:k + n]
    out ^= out >> np.uint64(31)
    return out


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc position, item position, length) of the tiles, longest first.

    The search length starts at the longest common window, found by halving, as windows of a common window are
    common too. At each length the windows of unmarked item words are looked up among those of unmarked doc words;
    equal hashes are checked word by word; a match is taken if all its words are still free, the first in item
    order, then in doc order. Then the length goes down to the next longest match, until ``least``.
    """
    free_d, free_i, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []

    def open_windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = window_hashes(words, size)
        if not len(h):
            return h, np.empty(0, np.int64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return h[at], at

    def common(size: int) -> bool:
        return bool(np.isin(open_windows(item, free_i, size)[0], open_windows(doc, free_d, size)[0]).any())

    def longest(low: int, high: int) -> int:
        """The longest common free window of at least ``low`` words, or 0."""
        if high < low or not common(low):
            return 0
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if common(half) else (low, half - 1)
        return low

    size = longest(least, min(len(doc), len(item)))
    while size:
        h, at = open_windows(doc, free_d, size)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        for hash_, i in zip(*open_windows(item, free_i, size)):
            k = np.searchsorted(h, hash_)
            while k < len(h) and h[k] == hash_ and free_i[i:i + size].all():
                d = at[k]
                if free_d[d:d + size].all() and (doc[d:d + size] == item[i:i + size]).all():
                    tiles.append((int(d), int(i), size))
                    free_d[d:d + size] = free_i[i:i + size] = False
                k += 1
        size = longest(least, min(size - 1, int(free_i.sum()), int(free_d.sum())))
    return tiles


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_key, item_id, words) of the items that have words; items alike in id and text once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([word_hashes(t).view(np.int64) for t in strings(b.column(2))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words], names=["item_key", "item_id", "words"])

    named = pick(benchmark, item_id=f"{item_id} bigint", text=f"{text} string")
    keyed = named.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text").dropDuplicates(["item_key"])
    return keyed.mapInArrow(run, "item_key bigint, item_id bigint, words array<bigint>")


def _seeds(items: DataFrame, size: int) -> DataFrame:
    """(seed, place, item_key, at): the windows of all items, ``place`` their bit in the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = window_hashes(np.array(words, np.int64).view(np.uint64), size)
                columns = [h.view(np.int64), (h & np.uint64(FILTER_BITS - 1)).astype(np.int64),
                           np.full(len(h), key, np.int64), np.arange(len(h))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "place", "item_key", "at"])

    return items.select("item_key", "words").mapInArrow(run, "seed bigint, place bigint, item_key bigint, at bigint")


def _filter(seeds: DataFrame) -> bytes:
    """A bitmap of the seeds' places. It has a fixed size, so it may pass through the driver and go to all executors."""
    rows = (seeds.groupBy(F.shiftright("place", 15).alias("k"))
            .agg(F.expr("bitmap_construct_agg(place & 32767)").alias("m")).collect())
    out = bytearray(FILTER_BITS // 8)
    for k, m in rows:
        out[k * 4096:k * 4096 + 4096] = m
    return bytes(out)


def _touched(docs: DataFrame, doc_id: str, text: str, size: int, bitmap: bytes) -> DataFrame:
    """(doc_id, mark, words, seeds) of the documents with a window in the filter.

    ``words`` are the hashes of the stretches that such windows cover, each followed by a value that is no word's;
    ``seeds`` the distinct windows. Any tile lies within a stretch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            rows = []
            for doc, mark, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2))):
                words = word_hashes(t)
                h = window_hashes(words, size)
                p = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                hit = np.flatnonzero(bits[p >> 3] >> (p & 7).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                cuts = np.flatnonzero(np.diff(hit) >= size) + 1
                stretches = []
                for k, part in enumerate(np.split(hit, cuts)):
                    stretches += [words[part[0]:part[-1] + size], np.array([2 * k + 1], np.uint64)]
                rows.append((doc, mark, np.concatenate(stretches).view(np.int64), np.unique(h[hit]).view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["doc_id", "mark", "words", "seeds"])

    return (pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string")
            .select("doc_id", F.xxhash64("text").alias("mark"), "text")
            .mapInArrow(run, "doc_id bigint, mark bigint, words array<bigint>, seeds array<bigint>")
            .dropDuplicates(["doc_id", "mark"]))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", least: int = SEED_WORDS,
                 coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, mark, item_id, coverage, n_tiles): pairs where tiles of at least ``least`` words cover that share of the item.

    Tiles may lie in any order and place, so reordered passages count. Words are compared in lower case without
    punctuation. ``mark`` is the xxhash64 of the document's text. Rows alike in id and text give one row per item.
    Null or empty texts, and items of fewer than ``least`` words, match nothing; null ids stay null; empty tables
    give no rows. Windows shared with the benchmark are found by a filter of fixed size and then by a join; only pairs
    whose shared windows could reach the coverage are tiled, one pair at a time.
    """
    items = as_table(_items(benchmark, item_id, item_text), "benchmark-items")
    seeds = as_table(_seeds(items, least), "benchmark-seeds")
    found = as_table(_touched(docs, doc_id, text, least, _filter(seeds)), "benchmark-touched")
    shared = (found.select("doc_id", "mark", F.explode("seeds").alias("seed")).join(seeds.drop("place"), "seed")
              .groupBy("doc_id", "mark", "item_key").agg(F.count_distinct("at").alias("n")))
    sized = items.select("item_key", "item_id", F.col("words").alias("item"))
    pairs = (shared.join(sized, "item_key").where(F.col("n") * least >= coverage * F.size("item"))
             .withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m"))
    pairs = (pairs.join(found.drop("seeds"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")))
             .select("doc_id", "mark", "item_id", "words", "item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share, count = [], []
            for w, i in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                tiles = tile(np.array(w, np.int64).view(np.uint64), np.array(i, np.int64).view(np.uint64), least)
                share.append(sum(n for _, _, n in tiles) / len(i))
                count.append(len(tiles))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(share, pa.float64()), pa.array(count, pa.int64())],
                                             names=["doc_id", "mark", "item_id", "coverage", "n_tiles"])

    return pairs.mapInArrow(run, "doc_id bigint, mark bigint, item_id bigint, coverage double, n_tiles bigint").where(
        F.col("coverage") >= coverage)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", least: int = SEED_WORDS,
                      coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated ones; all other rows and columns stay, rows with null ids too."""
    bad = as_table(contaminated(docs, benchmark, doc_id, text, item_id, item_text, least, coverage)
                   .select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct(), "benchmark-bad")
    mark = spare(docs, "text_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(f"`{text}`").cast("string")))
    same = F.col("bad_id").eqNullSafe(F.col(f"`{doc_id}`").cast("bigint")) & (F.col("bad_mark") == F.col(mark))
    return marked.join(bad, same, "left_anti").drop(mark)
