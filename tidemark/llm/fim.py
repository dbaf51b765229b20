"""Fill-in-middle: documents are cut at token counts and their parts reordered; counts come from memoized chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# a chunk ends where the upper CHUNK_BITS of the rolling hash are zero, within these lengths in code points
CHUNK_BITS, LEAST_CHUNK, LONGEST_CHUNK = 8, 64, 4096
# hashed at once, so a text of any length needs little memory
BLOCK = 1 << 20
# a worker's chunk cache starts anew beyond so many code points
CACHED_CHARS = 16_000_000
# rows and code points of an output batch
BATCH_ROWS, BATCH_CHARS = 512, 4_000_000

# an end of a token inside a chunk: a word's last character before white space
_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
_SPACE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")


def rolling(codes: np.ndarray) -> np.ndarray:
    """32-bit rolling hash at each code point of it and the 31 before: terms shifted one bit for each step back."""
    h = ((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    for back in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[back:] = h[:-back] << np.uint32(back)
        h = h + older
    return h


def boundaries(text: str) -> list[int]:
    """Offsets that bound the chunks of ``text``: 0, each content-defined cut, and the length.

    A cut depends on the 32 code points before it and the last cut, so equal passages fall into equal chunks soon
    after their start, wherever they stand.
    """
    cuts, last = [0], 0
    for at in range(0, len(text), BLOCK):
        lead = min(at, 31)
        h = rolling(np.frombuffer(text[at - lead:at + BLOCK].encode("utf-32-le"), "<u4"))
        for cut in (np.flatnonzero(h[lead:] >> np.uint32(32 - CHUNK_BITS) == 0) + at + 1).tolist():
            while cut - last > LONGEST_CHUNK:
                last += LONGEST_CHUNK
                cuts.append(last)
            if cut - last >= LEAST_CHUNK:
                last = cut
                cuts.append(cut)
    while len(text) - last > LONGEST_CHUNK:
        last += LONGEST_CHUNK
        cuts.append(last)
    if last < len(text):
        cuts.append(len(text))
    return cuts


class Chunks:
    """Boundary summaries of chunks by their content.

    A summary says how many tokens end inside the chunk, if it starts with white space, and if it ends inside a
    word; summaries of neighbours combine into the counts of a whole text. The cache is keyed by the chunk itself,
    so a hit is verified by its content, and what is cached never changes a result.
    """

    def __init__(self, most: int = CACHED_CHARS):
        self.most, self.held, self.known = most, 0, {}

    def _summary(self, chunk: str) -> tuple[int, bool, bool]:
        found = (len(_END.findall(chunk)), chunk[0] in _SPACE, chunk[-1] not in _SPACE)
        if self.held > self.most:
            self.known, self.held = {}, 0
        self.known[chunk] = found
        self.held += len(chunk)
        return found

    def count(self, text: str) -> Counted:
        """The token counts of ``text`` by chunk."""
        cuts = boundaries(text)
        chunks = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        known = list(map(self.known.get, chunks))
        if None in known:
            known = [self._summary(c) if s is None else s for c, s in zip(chunks, known)]
        return Counted(text, cuts, known)


class Counted:
    """A text with the number of tokens that end up to each chunk."""

    def __init__(self, text: str, cuts: list[int], summaries: list[tuple[int, bool, bool]]):
        self.text, self.cuts = text, cuts
        inside = np.array([s[0] for s in summaries], np.int64)
        # a word that ends exactly where a chunk does is counted with the next one, which starts with white space
        opens = np.array([s[1] for s in summaries], bool)
        self.at_start = np.zeros(len(summaries), bool)
        if summaries:
            self.at_start[1:] = opens[1:] & np.array([s[2] for s in summaries[:-1]], bool)
        self.upto = np.cumsum(inside + self.at_start)
        # the last token, be it a word or closing white space, ends with the text
        self.n = int(self.upto[-1]) + 1 if summaries else 0

    def end(self, k: int) -> int:
        """Offset where the k-th token ends; 0 for none. Only the chunk that holds it is read."""
        if k == 0:
            return 0
        if k == self.n:
            return len(self.text)
        i = int(np.searchsorted(self.upto, k))
        left = k - (int(self.upto[i - 1]) if i else 0) - int(self.at_start[i])
        if not left:
            return self.cuts[i]
        chunk = self.text[self.cuts[i]:self.cuts[i + 1]]
        return self.cuts[i] + next(islice(_END.finditer(chunk), left - 1, None)).end()


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50,
              spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    A text of n tokens (white space and the word behind it, or closing white space) is cut after two token counts
    that the sha256 of ``seed:doc_id`` gives; of 100, ``rate`` are transformed, of these ``spm`` suffix first. Texts
    that are empty or hold a sentinel stay plain: output is the text, the two lengths are null. Null text is empty;
    a null id hashes as ``seed:`` alone; repeated ids draw the same numbers. Texts are read whole; an empty table
    gives no rows; further columns are ignored. No shuffle; a worker keeps summaries of chunks it has met.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def one(memo: Chunks, doc: int | None, t: str) -> tuple:
        digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
        counted = memo.count(t)
        if not t or PREFIX in t or SUFFIX in t or MIDDLE in t or h3 % 100 >= rate:
            return doc, counted.n, "plain", None, None, t
        first, second = sorted((h1 % (counted.n + 1), h2 % (counted.n + 1)))
        a, b = counted.end(first), counted.end(second)
        prefix, middle, suffix = t[:a], t[a:b], t[b:]
        if h4 % 100 < spm:
            return doc, counted.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return doc, counted.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rows, size = Chunks(), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), strings(b.column(1))):
                rows.append(one(memo, doc, t))
                size += len(t)
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string").mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(formed: DataFrame, form: str = "form", output: str = "output", name: str = "text") -> DataFrame:
    """``formed`` with the texts rebuilt from output and form alone, by built-in functions."""
    # no part holds a sentinel, so the three in an output cut it exactly
    parts = F.split(F.col(f"`{output}`"), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    whole = (F.when(F.col(f"`{form}`") == "psm", F.concat(parts[1], parts[3], parts[2]))
             .when(F.col(f"`{form}`") == "spm", F.concat(parts[2], parts[3], parts[1]))
             .otherwise(F.col(f"`{output}`")))
    return formed.withColumn(name, whole)


def digests(formed: DataFrame) -> DataFrame:
    """:func:`transform` with hashes of its output and of the text rebuilt from it in place of the texts."""
    return restore(formed, name="output_text").select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("output_text", 256).alias("restored_sha256"))
