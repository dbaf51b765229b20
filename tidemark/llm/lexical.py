"""Ranked lexical search over bit-sliced Bloom signatures: bounds from bitmaps, exact scores for what they leave."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, utf8
from tidemark.sources.shared import as_table

# documents and distinct terms of a block; a block also closes when its term lists reach so many bytes
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
# bits of a signature for each entry of the longest document of a block, and the most bits; beyond, bounds get loose
BITS_PER_ENTRY, MOST_BITS = 16, 1 << 20
# a term that occurs so often in a document enters once for each of these numbers that it reaches
LEVELS = (1, 2, 4, 8)
# items in a group that is sent to the executors, by their text, and in one matrix product
SENT_CHARS, ITEMS_AT_ONCE = 2 << 20, 256
# a worker's term hashes start anew at this number; bits of the fixed-size filter of asked terms
CACHED_TERMS, FILTER_BITS = 200_000, 1 << 22

# ASCII signs and controls separate terms and upper-case A-Z become lower-case; all other bytes stay
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text with repeats."""
    return text.translate(_TERM_BYTES).split()


class Hashes:
    """64-bit hashes of terms."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: Collection[bytes]) -> np.ndarray:
        """Hashes in the order of ``words``, which are distinct."""
        if len(self.known) > CACHED_TERMS:
            self.known = {}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def slices(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The slice of each term at a level, of ``bits`` slices, a power of two."""
    mixed = (hashes ^ np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64) & (bits - 1)


# ---- index ----------------------------------------------------------------------------------------------------------

def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents, written to the shared folder: (bits, doc_ids, n, top, signature, words, counts).

    A block holds documents of like numbers of distinct terms. Its signature is bit-sliced: for each of ``bits``
    positions a bitmap of its documents, in which a document is set if one of its terms falls on the position. Each
    document also has its number of terms ``n``, the occurrences ``top`` of its most frequent term, and its distinct
    ``words`` with their ``counts``, which only exact scores read. Documents without terms are left out.
    """
    names = ["bits", "doc_ids", "n", "top", "signature", "words", "counts"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
             pa.list_(pa.binary()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def out(bits: int) -> pa.RecordBatch:
            part = held.pop(bits)
            del size[bits]
            field = np.zeros((bits, -(-len(part) // 8) * 8), bool)
            for row, (_, h, times, _) in enumerate(part):
                for level, least in enumerate(LEVELS):
                    field[slices(h[times >= least], level, bits), row] = True
            row = [bits, [p[0] for p in part], [int(p[2].sum(dtype=np.int64)) for p in part], [int(p[2].max()) for p in part],
                   np.packbits(field, axis=1).tobytes(), [p[3] for p in part], [p[2].tobytes() for p in part]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                found = Counter(terms(t))
                if not found:
                    continue
                times = np.fromiter(found.values(), "<u4", len(found))
                entries = sum(int(np.count_nonzero(times >= least)) for least in LEVELS)
                bits = min(MOST_BITS, 1 << max(10, (BITS_PER_ENTRY * entries - 1).bit_length()))
                words = b" ".join(found)
                held.setdefault(bits, []).append((doc, hashes.of(found), times, words))
                size[bits] = size.get(bits, 0) + len(words) + 12 * len(times)
                if len(held[bits]) >= block_docs or size[bits] >= block_bytes:
                    yield out(bits)
        for bits in list(held):
            yield out(bits)

    made = pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string").mapInArrow(
        run, "bits bigint, doc_ids array<bigint>, n array<bigint>, top array<bigint>, signature binary, "
             "words array<binary>, counts array<binary>")
    return as_table(made, "lexical-index")


# ---- what the items ask, and counts over the corpus ----------------------------------------------------------------

def asked(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term binary, times): the terms of each item. Rows of one id are one item; null ids are one too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, times = [], [], []
            for item, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                found = Counter(terms(t))
                ids += [item] * len(found)
                words += found
                times += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64())],
                                             names=["item_id", "term", "times"])

    found = pick(items, item_id=f"{item_id} bigint", text=f"{text} string").mapInArrow(
        run, "item_id bigint, term binary, times bigint")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _asked_filter(wanted: DataFrame) -> np.ndarray:
    """A fixed-size bitmap of term hashes; a term whose bit is not set is asked by no item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.zeros(FILTER_BITS, bool), Hashes()
        for b in batches:
            if b.num_rows:
                bits[slices(hashes.of(b.column(0).to_pylist()), 0, FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in wanted.select("term").mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(whole).astype(bool)


def statistics(made: DataFrame, wanted: DataFrame) -> tuple[int, int, DataFrame]:
    """(documents with terms, all their terms, table (term, df) of the asked terms that occur), from the index."""
    total = made.select(F.sum(F.size("n")).alias("docs"), F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)")).alias("terms")).first()
    sent = made.sparkSession.sparkContext.broadcast(np.packbits(_asked_filter(wanted)).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        hashes, seen, skip = Hashes(), Counter(), set()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "df"])

        for b in batches:
            for words in b.column(0).to_pylist():
                for one in words:
                    new = [w for w in one.split() if w not in skip]
                    fresh = [w for w in new if w not in seen]
                    if fresh:
                        hit = bits[slices(hashes.of(fresh), 0, FILTER_BITS)]
                        skip.update(w for w, ok in zip(fresh, hit) if not ok)
                    seen.update(w for w in new if w not in skip)
                    if len(skip) > CACHED_TERMS:
                        skip = set()
                    if len(seen) > CACHED_TERMS:
                        yield out()
                        seen = Counter()
        if seen:
            yield out()

    counts = made.select("words").mapInArrow(run, "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    df = counts.join(wanted.select("term").distinct(), "term", "left_semi")
    return int(total.docs or 0), int(total.terms or 0), df


# ---- search ---------------------------------------------------------------------------------------------------------

def factor(tf, m):
    """The part of a term's score that its occurrences and the document's length give."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """Up to ITEMS_AT_ONCE items with the weights of their terms, and the best documents found so far for each."""

    def __init__(self, rows: list[tuple], k: int, hashes: Hashes):
        self.ids = list(dict.fromkeys(i for i, _, _ in rows))
        self.words = list(dict.fromkeys(t for _, t, _ in rows))
        row, column = {i: n for n, i in enumerate(self.ids)}, {t: n for n, t in enumerate(self.words)}
        self.weights = np.zeros((len(self.ids), len(self.words)))
        for i, t, w in rows:
            self.weights[row[i], column[t]] += w
        self.hashes, self.k = hashes.of(self.words), k
        self.column = column
        # the best so far, k at most of each item: item, score, doc id, whether the id is null
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        # the k-th score and its id, once there are k
        self.least, self.last = np.full(len(self.ids), 1), np.full(len(self.ids), np.iinfo(np.int64).max)
        self.scored = 0

    def bounds(self, bits: int, docs: int, signature: np.ndarray, top: np.ndarray, m: np.ndarray) -> np.ndarray:
        """(items x documents): no document's score is above its bound.

        A document may hold a term if its bit is set in the term's slice, and may hold it up to the next level's
        number of times if the slice of that level is not set. Each slice, weighted by the items, adds what the
        occurrences up to its level can add; products and sums stay below 2^53 and so are exact.
        """
        whole = np.zeros((len(self.ids), docs))
        below, present = np.zeros(docs, np.int64), None
        for level in range(len(LEVELS)):
            bitmap = np.unpackbits(signature[slices(self.hashes, level, bits)], axis=1, count=docs)
            present = bitmap if present is None else present & bitmap
            reach = np.minimum(top, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else top
            upto = np.maximum(factor(reach, m), below)
            whole += (self.weights @ present) * (upto - below)
            below = upto
        return whole

    def search(self, block: tuple) -> None:
        """Score what a block's bounds do not rule out; the k best stay."""
        bits, ids, n, top, raw, words, counts, m = block
        bound = self.bounds(bits, len(ids), np.frombuffer(raw, np.uint8).reshape(bits, -1), top, m)
        missing = np.array([i is None for i in ids])
        ids = np.array([0 if i is None else i for i in ids], np.int64)

        def possible() -> np.ndarray:
            # a bound below the k-th score, or at it with a later id, proves a document no better
            late = missing[None, :] | (ids[None, :] > self.last[:, None])
            return (bound > self.least[:, None]) | ((bound == self.least[:, None]) & ~late)

        # the k best bounds of each item come first: their scores rule out most of the others
        first = np.zeros(bound.shape, bool)
        k = min(self.k, len(ids))
        np.put_along_axis(first, np.argpartition(-bound, k - 1, axis=1)[:, :k], True, axis=1)
        for chosen in (first, ~first):
            self._score(possible() & chosen, ids, missing, m, words, counts)

    def _score(self, chosen: np.ndarray, ids: np.ndarray, missing: np.ndarray, m: np.ndarray, words: list, counts: list) -> None:
        """Exact scores of the chosen pairs of item and document, from the documents' own terms and counts."""
        found = [self.best]
        for d in np.flatnonzero(chosen.any(axis=0)).tolist():
            own = words[d].split()
            at = np.fromiter(map(self.column.get, own, repeat(-1)), np.int64, len(own))
            asked = at >= 0
            part = factor(np.frombuffer(counts[d], "<u4")[asked].astype(np.int64), int(m[d]))
            q = np.flatnonzero(chosen[:, d])
            # whole numbers below 2^53
            score = (self.weights[np.ix_(q, at[asked])] @ part.astype(np.float64)).astype(np.int64)
            self.scored += len(q)
            q, score = q[score > 0], score[score > 0]
            found.append((q, score, np.full(len(q), ids[d]), np.full(len(q), missing[d])))
        if len(found) == 1:
            return
        item, score, doc, none = (np.concatenate([f[c] for f in found]) for c in range(4))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        self.best = item[place < self.k], score[keep], doc[keep], none[keep]
        full = place == self.k - 1
        end = order[full]
        self.least[item[full]] = score[end]
        self.last[item[full]] = np.where(none[end], np.iinfo(np.int64).max, doc[end])


def _top(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each key; each task keeps its k best before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", made: DataFrame | None = None,
           sent_chars: int = SENT_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, equal scores by doc_id.

    ``made`` is the :func:`index` of ``docs`` if it is there already. Terms, weights and scores are those of the
    task's contract: integers, rounded down. Null texts have no terms; items without terms give no rows. Rows of
    ``docs`` alike in id are ranked each; null ids come last among ties. Rows of ``items`` of one id are one item.
    Texts are read whole; empty tables give no rows; further columns are ignored.

    Items go to the executors in groups of about ``sent_chars`` characters. A task reads blocks of the index, bounds
    all scores of a block by products of weights and bitmaps, and scores exactly, best bounds first, every document
    whose bound reaches the k-th score it has seen. It gives at most k rows an item, of which the best are taken.
    """
    made = index(docs, doc_id, text) if made is None else made
    wanted = as_table(asked(items, item_id, item_text), "lexical-items")
    count, length, df = statistics(made, wanted)
    spark = docs.sparkSession
    if not count:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    size = wanted.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    groups = 1 + size // sent_chars
    weighted = as_table(wanted.join(df, "term").select(
        "item_id", "term", "times", "df", F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("g")), "lexical-weights")
    found = None
    for g in range(groups):
        part = _group(made, weighted.where(F.col("g") == g), count, length, k)
        found = part if found is None else found.union(part)
    # a third of all tasks may answer for one item: first within shares of the rows, then over these
    near = _top(found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(64))), k, "item_id", "share")
    return _top(near.drop("share", "rank"), k, "item_id").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _group(made: DataFrame, weighted: DataFrame, count: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each task for one group of items, of bounded size."""
    rows = [(r.item_id, bytes(r.term), r.times * math.floor(1000 * math.log((2 * count + 2) / (2 * r.df + 1))))
            for r in weighted.orderBy("item_id", "term").collect()]
    sent = made.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, groups, part, ids = Hashes(), [], [], set()
        for r in sent.value:
            if r[0] not in ids and len(ids) == ITEMS_AT_ONCE:
                groups.append(Items(part, k, hashes))
                part, ids = [], set()
            part.append(r)
            ids.add(r[0])
        if part:
            groups.append(Items(part, k, hashes))
        for b in batches:
            for i in range(b.num_rows):
                bits, doc_ids, n, top, raw, words, counts = (c[i].as_py() for c in b.columns)
                n = np.array(n, np.int64)
                m = 100 - 75 + 75 * n * count // length
                for g in groups:
                    g.search((bits, doc_ids, n, np.array(top, np.int64), raw, words, counts, m))
        for g in groups:
            item, score, doc, none = g.best
            yield pa.RecordBatch.from_arrays([pa.array([g.ids[i] for i in item], pa.int64()), pa.array(doc, pa.int64(), mask=none),
                                              pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return made.select("bits", "doc_ids", "n", "top", "signature", "words", "counts").mapInArrow(
        run, "item_id bigint, doc_id bigint, score bigint")
