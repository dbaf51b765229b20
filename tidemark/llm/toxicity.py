"""Toxicity as ordinal regression: one weight per text feature, shared by all ordered thresholds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, spare, strings
from tidemark.sources.shared import as_table

# bound of the training sample by class, and of the features that get a weight
TOXIC_ROWS, CLEAN_ROWS, FEATURES = 2000, 4000, 5000
# severity bands of toxic documents, and the probability from which a document is toxic
BANDS, THRESHOLD = 3, 0.3
# standard errors by which a feature's frequencies in both classes have to differ; a feature counts if at least one in RARE
# documents of the sample has it
CLEAR, RARE = 4.5, 300
# least hashes of a text that are compared to find near copies within the sample
SKETCHES = 4
_WORD = re.compile(r"\w+")


def features(text: str) -> dict[str, float]:
    """Sparse features of a text: log(1 + count) of each word and of the first four and five letters of longer words."""
    counts = Counter(_WORD.findall(text.lower()))
    stems: Counter[str] = Counter()
    for w, n in counts.items():
        for k in (4, 5):
            if len(w) > k:
                stems[w[:k] + "-"] += n
    return {f: float(np.log1p(n)) for part in (counts, stems) for f, n in part.items()}


def sketch(text: str) -> list[int]:
    """Least hashes of the text's runs of five words, by several seeds; near copies have most of them in common."""
    words = text.lower().split()
    runs = {" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    h = np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs))
    return [int((h * np.uint64(2 * k + 0x9E3779B97F4A7C15) >> np.uint64(1)).min()) for k in range(SKETCHES)]


@dataclass(frozen=True)
class Ordinal:
    """P(grade > j) = sigmoid(score - cuts[j]), ``score`` the sum of weights; ``cuts`` ascend."""

    weights: dict[str, float]
    cuts: tuple[float, ...]

    def score(self, text: str) -> float:
        known, total = self.weights, 0.0
        counts = Counter(_WORD.findall(text.lower()))
        stems: Counter[str] = Counter()
        for w, n in counts.items():
            if w in known:
                total += known[w] * np.log1p(n)
            for k in (4, 5):
                if len(w) > k and (stem := w[:k] + "-") in known:
                    stems[stem] += n
        return float(total + sum(known[s] * np.log1p(n) for s, n in stems.items()))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.cuts)[None, :], -500, 500)))


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
                   n_grades: int, penalty: float = 0.5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by full-batch Adam on the penalised likelihood of ordered grades."""
    n = len(grades)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, n), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # cuts as a first value and logs of the gaps
    theta = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, free = theta[:n_features], theta[n_features:]
        cuts = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        score = np.bincount(rows, values * w[cols], minlength=n)
        ext = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            hi = 1 / (1 + np.exp(-(ext[grades + 1] - score)))
            lo = 1 / (1 + np.exp(-(ext[grades] - score)))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = (d_hi - d_lo) / n  # of the negative log likelihood
        g_cuts = np.array([(-(d_hi * (grades == j)) + d_lo * (grades == j + 1)).sum() for j in range(n_grades - 1)]) / n
        g_free = np.concatenate([[g_cuts.sum()], [g_cuts[k:].sum() * np.exp(free[k]) for k in range(1, n_grades - 1)]])
        g = np.concatenate([np.bincount(cols, values * g_score[rows], minlength=n_features) + penalty * w / n, g_free])
        m, v = 0.9 * m + 0.1 * g, 0.97 * v + 0.03 * g * g
        rate = 0.15 * min(1.0, 2 * (1 - t / (steps + 1)))  # steady, then down to nothing
        theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.97 ** t)) + 1e-8)
    free = theta[n_features:]
    return theta[:n_features], np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, toxic: str,
            toxic_rows: int, clean_rows: int) -> DataFrame:
    """(doc_id, toxic, names, values) of a bounded sample of labelled documents, drawn by a hash of the id."""
    known = (pick(labels, id=f"{label_id} bigint", toxic=f"{toxic} int").where("id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    drawn = None
    for value, most in ((1, toxic_rows), (0, clean_rows)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = part if drawn is None else drawn.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few documents at a time: each has many features
        for b in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            got = [features(t) for t in strings(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([list(g) for g in got], pa.list_(pa.string())),
                 pa.array([list(g.values()) for g in got], pa.list_(pa.float64())),
                 pa.array([sketch(t) for t in strings(b.column(2))], pa.list_(pa.int64()))],
                names=["id", "toxic", "names", "values", "sketch"])

    # at most toxic_rows + clean_rows rows of two numbers: small enough to send to every executor
    return (pick(docs, id=f"{doc_id} bigint", text=f"{text} string").join(F.broadcast(drawn), "id")
            .select("id", "toxic", "text").dropDuplicates(["id"])
            .mapInArrow(run, "id bigint, toxic int, names array<string>, values array<double>, sketch array<bigint>"))


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sample with one of each group of near copies: else their every word would look like a mark of their class."""
    seen: list[set] = [set() for _ in range(SKETCHES)]
    kept = []
    # a few numbers for each row of the bounded sample
    for r in sample.select("id", "toxic", "sketch").orderBy(F.desc("toxic"), "id").collect():
        if not any(s in known for s, known in zip(r.sketch, seen)):
            kept.append((r.id,))
        for s, known in zip(r.sketch, seen):
            known.add(s)
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(kept, "id bigint")), "id", "left_semi").drop("sketch")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
        toxic: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, most: int = FEATURES,
        bands: int = BANDS) -> Ordinal:
    """A model of severity grades 0 (clean) to ``bands`` from labels 0/1.

    Labels tell only toxic from clean. The grade of a labelled toxic document is its band, of ``bands`` of equal
    size, by the sum of its marker features; markers are features far more frequent among toxic documents.
    The sample has at most ``toxic_rows`` and ``clean_rows`` documents, the model at most ``most`` features, those whose
    frequencies in both classes lie farthest apart, and clearly so. Nulls in labels are left out; of conflicting labels toxic
    counts. Without labels of both classes the model finds nothing toxic.
    """
    sample = as_table(_sample(docs, labels, doc_id, text, label_id, toxic, toxic_rows, clean_rows), "toxicity-drawn")
    sample = as_table(_without_copies(sample), "toxicity-sample")
    size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Ordinal({}, tuple(float(50 + j) for j in range(bands)))
    counts = sample.select("toxic", F.explode("names").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(f"a + b >= {max(2, (n1 + n0) // RARE)}")
    gap = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt((F.col("a") + F.col("b") + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
    top = counts.withColumn("z", gap).where(f"abs(z) >= {CLEAR}").orderBy(F.abs("z").desc(), "f").limit(most).collect()
    place = {r.f: k for k, r in enumerate(top)}
    markers = {r.f for r in top if r.z > 2 and (r.a + 0.1) / n1 > 8 * (r.b + 0.1) / n0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for y, names, values in zip(*(b.column(i).to_pylist() for i in range(3))):
                kept = [(place[f], v) for f, v in zip(names, values) if f in place]
                out.append((y, [k for k, _ in kept], [v for _, v in kept], sum(v for f, v in zip(names, values) if f in markers)))
            kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=["toxic", "cols", "values", "marked"])

    # at most toxic_rows + clean_rows rows
    table = sample.orderBy("id").select("toxic", "names", "values").mapInArrow(
        run, "toxic int, cols array<int>, values array<double>, marked double").toArrow()
    y = table["toxic"].to_numpy()
    marked = table["marked"].to_numpy()
    grades = np.where(y > 0, 1 + np.searchsorted(np.quantile(marked[y > 0], np.arange(1, bands) / bands), marked, side="left"), 0)
    lengths = np.array([len(c) for c in table["cols"].to_pylist()])
    rows = np.repeat(np.arange(len(y)), lengths)
    cols = np.array([c for x in table["cols"].to_pylist() for c in x], np.int64)
    values = np.array([v for x in table["values"].to_pylist() for v in x], np.float64)
    w, cuts = fit_cumulative(rows, cols, values, grades, len(place), bands + 1)
    return Ordinal({f: float(w[k]) for f, k in place.items() if abs(w[k]) > 1e-6}, tuple(map(float, cuts)))


def grade(docs: DataFrame, model: Ordinal, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` and a struct column ``name``: severity (expected grade), grade (likeliest), p_toxic (grade above 0).

    Null text is empty and scores as a text without features. Texts are read whole. No shuffle, every row stays.
    """
    def run(column: pa.Array) -> pa.Array:
        above = model.above(np.array([model.score(t) for t in strings(column)], np.float64))
        each = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
        return pa.StructArray.from_arrays([pa.array(above.sum(axis=1), pa.float64()), pa.array(each.argmax(axis=1), pa.int32()),
                                           pa.array(above[:, 0], pa.float64())], names=["severity", "grade", "p_toxic"])

    return docs.withColumn(name, F.arrow_udf(run, "severity double, grade int, p_toxic double", F.ArrowUDFType.SCALAR)(
        F.col(f"`{text}`").cast("string")))


def reject(docs: DataFrame, model: Ordinal, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose probability of a grade above 0 reaches the threshold; all columns stay."""
    name = spare(docs, "toxicity_grade")
    return grade(docs, model, text, name).where(F.col(f"{name}.p_toxic") < threshold).drop(name)
