"""Best-fit packing: documents as token ids, cut into pieces, packed online into bounded open bins."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from struct import pack as packed

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, strings

CAPACITY, OPEN_BINS = 1024, 8192
# characters and documents that one shard of the packing takes; shards follow the corpus and bound a task's work
SHARD_CHARS, SHARD_DOCS = 32_000_000, 16_000
# most partitions of the packing; a task then packs several shards, one after the other
MOST_PARTITIONS = 8192
# ranks of byte_bpe_50k.json, and the file itself, whose added tokens are whole wherever a text holds their strings
VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
# a worker's cache starts anew at this size; longer parts are not kept in it
CACHED_PARTS, CACHED_CHARS = 150_000, 64
_SIGNS = ".,!?;:"
_BETWEEN = re.compile(r"\s \s")

_tokenizers: dict[str, Tokens] = {}


class Tokens:
    """Ids of a byte-level BPE vocabulary, equal to those of its tokenizer (``add_special_tokens=False``).

    The split pattern starts a word at each blank, unless it stands between white space, so the text is cut there
    and each distinct part is encoded once; most words come from the cache. Other texts are encoded as they are.
    Parts are encoded from the vocabulary's rank file, which is several times as fast. A string of the tokenizer's
    ``added`` tokens (string to id) is that one id, as by default in the library, and cuts the text around it.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.merge = coder.encode_ordinary, coder._encode_single_piece
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.signs = {sign: self._word(sign) for sign in _SIGNS}
        self.added = added or {}
        # where two start at one place the longer is taken
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    @classmethod
    def of(cls, path: str, added: dict[str, int] | None = None) -> Tokens:
        """One per worker process."""
        if path not in _tokenizers:
            _tokenizers[path] = cls(path, added)
        return _tokenizers[path]

    def _word(self, word: str) -> bytes:
        ids = self.merge(word)
        return packed(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        """Ids of a blank and ``part``. All letters are one word; a sign behind them is another."""
        known = self.known
        raw = known.get(part)
        if raw is not None:
            return raw
        if part.isalpha():
            raw = self._word(" " + part)
        elif part[-1:] in _SIGNS and part[:-1].isalpha():
            raw = self._part(part[:-1]) + self.signs[part[-1]]
        else:
            raw = b"".join(map(self._word, self.split(" " + part)))
        if len(part) <= CACHED_CHARS:
            known[part] = raw
        return raw

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text as unsigned 32-bit."""
        if any(a in text for a in self.added):
            # every other part is an added token
            parts = [np.array([self.added[p]], "<u4") if i % 2 else self._ids(p) for i, p in enumerate(self.cut(text))]
            return np.concatenate(parts)
        return self._ids(text)

    def _ids(self, text: str) -> np.ndarray:
        if _BETWEEN.search(text):
            return np.array(self.encode(text), "<u4")
        first, *rest = text.split(" ")
        if len(self.known) > CACHED_PARTS:
            self.known.clear()
        out = list(map(self.known.get, rest))
        if None in out:
            out = [self._part(p) if raw is None else raw for p, raw in zip(rest, out)]
        return np.frombuffer(b"".join([*map(self._word, self.split(first)), *out]), "<u4")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(name: str = TOKENIZER) -> dict[str, int]:
    """Strings and ids of the added tokens of a tokenizer's file."""
    with open(vocabulary(name), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in found):
        raise ValueError("added tokens that depend on what stands around them")
    return {t["content"]: t["id"] for t in found}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only longer ones are cut, and the first piece is the short one."""
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))] if n > capacity else [(0, n)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 2,
           path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids binary, ids_crc32): each document's ids and ``end_id``, cut.

    ``ids`` holds little-endian unsigned 32-bit ids. Null text is empty: one piece of ``end_id``. Any length,
    null or repeated ids and repeated rows are taken as they are; further columns are ignored; an empty table
    gives no rows. ``path`` names the vocabulary file, the same on every executor.
    """
    path, added = path or vocabulary(), added_tokens()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens.of(path, added), np.array([end_id], "<u4")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            rows, size = [], 0
            for doc, t in zip(b.column(0).to_pylist(), strings(b.column(1))):
                ids = np.concatenate([tokens.ids(t), end])
                for k, (at, n) in enumerate(cuts(len(ids), capacity)):
                    raw = ids[at:at + n].tobytes()
                    rows.append((doc, k, at, n, raw, zlib.crc32(raw)))
                    size += n
                    if size > 1_000_000:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    return pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint")


class Bins:
    """A fixed number of open bins in a bitset keyed by free space.

    Bit f is set if some open bin has f free. The best fit for a length is the lowest set bit at or above it. If all
    bins are open and none fits, the fullest closes (the lowest set bit) and a new one opens.
    """

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.count, self.next = capacity, most, 0, first
        self.bits, self.bins = 0, {}

    def _take(self, free: int) -> int:
        held = self.bins[free]
        number = held.pop()
        if not held:
            del self.bins[free]
            self.bits ^= 1 << free
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item of ``length``, at most the capacity."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.count -= 1
            free, number = self.capacity, self.next
            self.next, self.count = self.next + 1, self.count + 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.bits |= 1 << left
        else:
            self.count -= 1
        return number, self.capacity - free


def shards_for(docs: DataFrame, text: str = "text") -> int:
    """Shards of the packing for a corpus, by its characters and documents."""
    chars, count = docs.agg(F.sum(F.length(f"`{text}`").cast("bigint")), F.count("*")).first()
    return 1 + max((chars or 0) // SHARD_CHARS, count // SHARD_DOCS)


def place(items: DataFrame, shards: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32, further columns) with sequence_id and offset.

    Items are dealt by hash to ``shards``, so each shard sees the same mix of lengths, and come longest first. The
    online packing knows no later item and holds ``open_bins`` bins, whatever the input; a shard of
    :func:`shards_for` seldom needs as many, and then packs as best-fit decreasing does. Order and shards depend on
    the rows alone, so a task that is run again gives the same placements; identical rows may change places.
    """
    schema = items.schema.simpleString()[7:-1]
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, None
        for b in batches:
            sequence, offset = [], []
            for s, n in zip(b.column("shard").to_pylist(), b.column("length").to_pylist()):
                if s != shard:
                    shard, bins = s, Bins(capacity, open_bins, s << 40)
                number, at = bins.put(n)
                sequence.append(number)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence, pa.int64()),
                                              pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    partitions = min(max(1, shards), MOST_PARTITIONS)
    return (dealt.repartitionById(partitions, F.pmod("shard", F.lit(partitions)).cast("int"))
            .sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "ids_crc32")
            .mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS, path: str | None = None, ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place: :func:`pieces` and sequence_id, offset.

    ``ids=False`` leaves the ids out before the shuffle. A sequence is its pieces by offset.
    """
    cut = pieces(docs, doc_id, text, capacity, path=path)
    return place(cut if ids else cut.drop("ids"), shards_for(docs, text), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, starts, ids array<int>): the packed sequences themselves, at most the capacity long."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in column.to_pylist()], pa.list_(pa.int32()))

    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("length"),
                        F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"),
                        F.arrow_udf(run, "array<int>", F.ArrowUDFType.SCALAR)(F.col("p.ids")).alias("ids"))
