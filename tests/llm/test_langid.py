import zlib

import duckdb
import numpy as np
import pytest
from helpers import LONG, no_documents, odd_documents

from tidemark.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain_grams(text):
    """The same grams, character by character."""
    import unicodedata
    kept, last = " ", " "
    for c in text:
        if c.isalpha():
            last = c.lower() if len(c.lower()) == 1 else c
        elif unicodedata.category(c)[0] == "M":
            last = c
        else:
            last = " "
        if last != " " or kept[-1] != " ":
            kept += last
    if kept[-1] != " ":
        kept += " "
    if not any(c.isalpha() for c in text):
        return set()
    return {kept[i:i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1)} - {" "}


def as_numbers(grams):
    return {sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) for g in grams}


@pytest.mark.parametrize("block", [3, 1 << 20])
@pytest.mark.parametrize("text", ["", "a", " a", "Ab cD", "x  -- y!", "ÄÖ1ß", "नमस्ते दुनिया", "12 3", "a" * 9, "\n\tq", "İz", "日本 語", "😀 b 😀"])
def test_grams(monkeypatch, block, text):
    monkeypatch.setattr(langid, "BLOCK", block)
    found = list(langid.grams(text, langid.Characters()))
    assert set(map(int, np.concatenate([np.empty(0, np.uint64), *found]))) == as_numbers(plain_grams(text))


def test_lookup_is_exact():
    known = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 3000).astype(np.uint64))
    lookup = langid.Lookup(known, bits=8)  # so few places that most grams collide
    asked = np.concatenate([known[::3], known[::5] + np.uint64(1)])
    assert sorted(lookup(asked).tolist()) == sorted(np.flatnonzero(np.isin(known, asked)).tolist())


def test_kernel_and_ridge_against_plain_sums(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.fit(docs, rows=120, landmarks=24, most_grams=3000)
    assert model.names == ["de", "en", "es", "fr"] and model.weights.shape == (len(model.landmarks), 4)
    known = {int(g): i for i, g in enumerate(model.known)}
    sample = [r for r in langid._sample(docs, "doc_id", "text", "lang", 120)[0].collect()]

    def presence(t):
        x = np.zeros(len(known))
        for g in as_numbers(plain_grams(t)) & known.keys():
            x[known[g]] = 1
        return x / max(1.0, np.sqrt(x.sum()))

    # ridge regression in the space that the landmarks span: least squares with the kernel matrix as penalty
    k = np.stack([presence(r.text) for r in sample]) @ model.landmarks.astype(float).T
    among = (model.landmarks @ model.landmarks.T).astype(float)
    y = np.array([[r.lang == n for n in model.names] for r in sample], float)
    # the penalised normal equations, in the landmark weights themselves
    left = k.T @ k + langid.RIDGE * len(sample) * among
    assert left @ model.weights == pytest.approx(k.T @ y, rel=1e-3, abs=1e-3)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{DOCS}' LIMIT 60").fetchall():
        values = presence(text or "") @ model.landmarks.astype(float).T @ model.weights
        assert got[doc].lang_pred == model.names[int(values.argmax())]
        assert got[doc].score == pytest.approx(min(1, max(0, values.max())), abs=1e-4)


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    rows = duckdb.sql("SELECT doc_id, lang, text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()
    assert len(found) == len(rows)
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows)
    tested = [(d, lang) for d, lang, _ in rows if found[d].held_out and lang]
    assert sum(found[d].lang_pred == lang for d, lang in tested) >= 0.995 * len(tested)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_inputs_of_a_prediction(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.fit(docs)
    plain = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    other = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'zz' AS lang", "'other' AS source")
    assert {r.doc_id - 1000000: r.lang_pred for r in langid.predict(other, model).collect()} == plain


def test_held_out_rows_are_not_learned_from(spark):
    rows = [(i, "held words only here", "xx") if zlib.crc32(str(i).encode()) % 4 == 2 else (i, f"other text {'abc'[i % 3]}", "yy") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.names == ["yy"]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    # null, empty and blank texts
    assert sorted(str(r.doc_id) for r in got if r.lang_pred == "und") == ["2", "3", "4", "None"]
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.fit(no_documents(spark)) is None and langid.predict(no_documents(spark), None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert langid.fit(unlabelled) is None and langid.fit(docs.selectExpr("doc_id", "'12 !' AS text", "lang")) is None
    assert len(LONG) > 100_000
