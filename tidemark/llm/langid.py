"""Language identification: a string kernel on n-gram presence, Nyström landmarks, one-versus-rest kernel ridge."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, strings
from tidemark.sources.shared import as_table

# the blended spectrum: all n-grams up to this length; three code points of 21 bits are exact in 64
LONGEST = 3
# bounds of the training: labelled rows in all, landmarks in all, and grams that the kernel compares
SAMPLE_ROWS, LANDMARKS, GRAMS = 4000, 192, 16_384
RIDGE = 1e-3
# texts scored by one matrix product, code points read at once
BATCH, BLOCK = 64, 1 << 20
UNKNOWN = "und"


class Characters:
    """By code point: 1 for letters, 2 for marks, else 0; and the lower-case letter. Pages of 256 are filled when met."""

    def __init__(self):
        self.kind, self.low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        self.filled = np.zeros(0x1100, bool)

    def meet(self, codes: np.ndarray) -> None:
        for page in np.flatnonzero(np.bincount(codes >> np.uint32(8), minlength=0x1100) * ~self.filled).tolist():
            self.filled[page] = True
            for i in range(page << 8, page + 1 << 8):
                c = chr(i)
                if c.isalpha():
                    self.kind[i] = 1
                    if len(c.lower()) == 1:
                        self.low[i] = ord(c.lower())
                elif unicodedata.category(c)[0] == "M":
                    self.kind[i] = 2


def grams(text: str, chars: Characters) -> Iterator[np.ndarray]:
    """All n-grams of the text as 64-bit numbers, block by block, with repeats.

    Letters are lower-cased; everything between words is one blank, also before the first and after the last
    word. A text without letters has none.
    """
    tail, word = np.array([32], np.uint64), False
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le"), "<u4")
        chars.meet(codes)
        kind = chars.kind[codes]
        if not (word or (kind == 1).any()):
            continue  # nothing but signs so far
        word, inside = True, kind > 0
        codes = np.where(inside, chars.low[codes], np.uint32(32)).astype(np.uint64)
        # of several blanks the first stays, and none after the blank that the last block ended with
        before = np.concatenate([[tail[-1] != 32], inside[:-1]])
        codes = codes[inside | before]
        yield from _windows(tail, codes)
        tail = np.concatenate([tail, codes])[-LONGEST + 1:]
    if word and tail[-1] != 32:
        yield from _windows(tail, np.array([32], np.uint64))


def _windows(tail: np.ndarray, codes: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams that end in ``codes``; a blank alone is none."""
    c = np.concatenate([tail, codes])
    lead = len(tail)
    one = c[lead:]
    yield one[one != 32]
    gram = c
    for n in range(2, LONGEST + 1):
        # the gram that ends at each place, one code point longer than before; zero bits hold the place of a missing start
        gram = (gram[:-1] << np.uint64(21)) | c[n - 1:]
        yield gram[max(0, lead - n + 1):]


class Lookup:
    """Positions of known grams: hash tables that hold them exactly, those that collide in the next table."""

    def __init__(self, known: np.ndarray, bits: int = 18):
        self.bits, self.levels = bits, []
        left = np.arange(len(known), dtype=np.int32)
        while len(left):
            odd = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * len(self.levels) & (1 << 64) - 1 | 1)
            place = self._place(known[left], odd)
            at, first = np.unique(place, return_index=True)
            table = np.full(1 << bits, -1, np.int32)
            table[at] = left[first]
            self.levels.append((odd, table))
            left = np.delete(left, first)
        self.known = known

    def _place(self, g: np.ndarray, odd: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((g ^ g >> np.uint64(29)) * odd) >> np.uint64(64 - self.bits)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        """Positions of those of ``g`` that are known, with repeats."""
        out = []
        for odd, table in self.levels:
            at = table[self._place(g, odd)]
            hit = (at >= 0) & (self.known[at] == g)
            out.append(at[hit])
            g = g[~hit]
        return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class Model:
    """``known``: the grams compared. ``landmarks``: their presence in each landmark, of length 1. ``weights``: by
    landmark and language, with the Nyström root in them. ``names``: the languages."""

    known: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray | None
    names: list[str]

    def presence(self, texts: list[str], lookup: Lookup, chars: Characters) -> tuple[np.ndarray, np.ndarray]:
        """(texts x grams 0/1, whether the text has a letter)."""
        x = np.zeros((len(texts), len(self.known)), np.float32)
        lettered = np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            for g in grams(t, chars):
                lettered[i] = True
                x[i, lookup(g)] = 1
        return x, lettered

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """The normalised kernel of each text with each landmark: shared grams over the root of both counts."""
        norm = np.sqrt(x.sum(axis=1, keepdims=True))
        return (x @ self.landmarks.T) / np.maximum(norm, 1)


def _drawn(key: Column) -> Column:
    """A number from 0 to 1 by a text."""
    return (F.xxhash64(key, F.lit(12)).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from the training: crc32 of its id as text, modulo 4, is 2. A null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, doc_id: str, text: str, lang: str, rows: int) -> tuple[DataFrame, list[str]]:
    """(lang, text, draw) of about ``rows`` labelled rows, equally many for each language and no text twice, and the languages."""
    named = pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string", lang=f"{lang} string").where(
        "text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    # one row for each language: a short list
    counts = {r.lang: r.n for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(1, rows // max(1, len(counts)))
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(each / n)).otherwise(share)
    # all copies of a text are drawn alike and count once, so no group of copies can fill the sample
    drawn = named.withColumn("draw", _drawn(F.col("text"))).where(F.col("draw") < share)
    once = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    return as_table(once, "langid-sample"), sorted(counts)


def _gram_sets(texts: DataFrame) -> DataFrame:
    """(lang, grams binary): the distinct grams of each text, ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = Characters()
        for b in batches:
            sets = [np.unique(np.concatenate([np.empty(0, np.uint64), *map(np.unique, grams(t, chars))])).tobytes() for t in strings(b.column(1), 16)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["lang", "grams"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, grams binary")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS,
        landmarks: int = LANDMARKS, most_grams: int = GRAMS, ridge: float = RIDGE) -> Model | None:
    """Train on about ``rows`` labelled rows that :func:`held_out` leaves, drawn by a hash, as many for each language.

    The first ``landmarks`` of them by the hash are the landmarks; the kernel compares the ``most_grams`` grams that
    most of those have. Each task sums its share of the normal equations of the ridge regression, so the driver gets
    one small matrix a task. Without any labelled text with a letter there is no model.
    """
    sample, names = _sample(docs, doc_id, text, lang, rows)
    if not names:
        return None
    each = max(1, landmarks // len(names))
    first = None
    for name in names[:landmarks]:
        part = sample.where(F.col("lang") == name).orderBy("draw", "text").limit(each)
        first = part if first is None else first.union(part)
    # the distinct grams of at most `landmarks` texts
    sets = [np.frombuffer(r.grams, np.uint64) for r in _gram_sets(first).collect()]
    sets = [s for s in sets if len(s)]
    if not sets:
        return None
    found, held = np.unique(np.concatenate(sets), return_counts=True)
    known = np.sort(found[np.lexsort((found, -held))[:most_grams]])
    presence = np.stack([np.isin(known, s).astype(np.float32) for s in sets])
    model = Model(known, presence / np.maximum(np.sqrt(presence.sum(axis=1, keepdims=True)), 1), None, names)
    # the kernel among landmarks to the power -1/2; directions of no weight are left out
    values, vectors = np.linalg.eigh((model.landmarks @ model.landmarks.T).astype(np.float64))
    use = values > 1e-6 * values[-1]
    root = vectors[:, use] / np.sqrt(values[use])
    # of a size that `landmarks` and `most_grams` bound
    sent = docs.sparkSession.sparkContext.broadcast((known, model.landmarks, names, root))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks, names, root = sent.value
        model, lookup, chars = Model(known, marks, None, names), Lookup(known), Characters()
        left, right, n = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(model.names))), 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for at, texts in _some_texts(b.column(1)):
                x, lettered = model.presence(texts, lookup, chars)
                phi = model.kernel(x[lettered]) @ root
                y = np.array([[lang == name for name in model.names] for lang, ok in zip(langs[at:at + BATCH], lettered) if ok], float)
                if len(phi):
                    left, right, n = left + phi.T @ phi, right + phi.T @ y, n + len(phi)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()),
                                          pa.array([n])], names=["a", "b", "n"])

    sums = sample.select("lang", "text").mapInArrow(normal, "a binary, b binary, n bigint").collect()
    a = sum(np.frombuffer(r.a).reshape(root.shape[1], -1) for r in sums)
    b = sum(np.frombuffer(r.b).reshape(root.shape[1], -1) for r in sums)
    n = sum(r.n for r in sums)
    model.weights = root @ np.linalg.solve(a + ridge * n * np.eye(len(a)), b)
    return model


def _some_texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Up to BATCH texts at a time, null as empty, with the place of the first."""
    for at in range(0, len(column), BATCH):
        yield at, list(strings(column.slice(at, BATCH)))


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    The language whose regression gives the most, ties to the first by name; ``score`` is that value within 0 and 1.
    Null texts, texts without a letter, and all texts if there is no model are ``und`` with score 0. A text
    with letters but none of the compared grams gets the first language with score 0. Texts are read whole, in blocks;
    null and repeated ids are taken as they are; an empty table gives no rows; further columns are ignored. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.known, model.landmarks, model.weights, model.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value and Model(*sent.value)
        lookup, chars = Lookup(model.known) if model else None, Characters()
        for b in batches:
            for at, texts in _some_texts(b.column(1)):
                if model:
                    x, lettered = model.presence(texts, lookup, chars)
                    values = model.kernel(x) @ model.weights
                    best = values.argmax(axis=1)
                    label = [model.names[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
                    score = np.where(lettered, np.clip(values.max(axis=1), 0, 1), 0.0)
                else:
                    label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(label, pa.string()),
                                                  pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
