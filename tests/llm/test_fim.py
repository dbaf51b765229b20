import hashlib
import re

import duckdb
import pytest
from helpers import no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc, n, form, len(p), len(m), out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x85\xa0ab.é😀", max_size=400))
def test_ends_of_tokens(text):
    counted = fim.Chunks().count(text)
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    assert counted.n == len(ends) - 1
    assert [counted.end(k) for k in range(len(ends))] == ends


@pytest.mark.parametrize("text", ["word " * 5000, "x" * 20_000, " " * 20_000, "ab\n\n  cd é " * 3000, "a " * 9000 + "  "])
def test_long_texts_over_many_chunks(monkeypatch, text):
    monkeypatch.setattr(fim, "BLOCK", 1000)
    small = fim.boundaries(text)
    monkeypatch.undo()
    assert small == fim.boundaries(text)  # blocks leave no trace
    assert all(0 < b - a <= fim.LONGEST_CHUNK for a, b in zip(small, small[1:])) and len(small) > 4
    counted = fim.Chunks(most=100).count(text)
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    assert counted.n == len(ends) - 1
    assert all(counted.end(k) == ends[k] for k in range(0, len(ends), 7))


def test_shared_passages_fall_into_shared_chunks():
    passage = " ".join(f"w{i * i % 977}" for i in range(3000))
    chunks = [set(t[a:b] for a, b in zip(c, c[1:])) for t in (passage, "another start " + passage) for c in [fim.boundaries(t)]]
    assert len(chunks[0] & chunks[1]) >= 0.9 * len(chunks[0])
    memo = fim.Chunks()
    memo.count(passage)
    held = len(memo.known)
    memo.count(passage + " and an end")
    assert len(memo.known) <= held + 2


def test_table_against_plain_tokens(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: tuple(r) for r in fim.transform(docs).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DOCS}'").fetchall()
    assert got == {d: plain(d, t) for d, t in rows}
    assert {g[2] for g in got.values()} == {"plain", "spm", "psm"}


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(["a <", "< a", "<S a", "P> b", "<<P x", "S> y\n", "a", " ", "<P", "x <M y", "q\n\n"] * 8)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, output string")
    back = fim.restore(fim.transform(docs, rate=100, spm=50))
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    assert {r.form for r in back.collect()} == {"spm", "psm"}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted(map(tuple, fim.transform(docs).collect()), key=str)
    assert got == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert fim.transform(no_documents(spark)).count() == 0
    marked = spark.createDataFrame([(i, "one <S> two") for i in range(20)], "doc_id bigint, text string")
    assert {(r.form, r.output) for r in fim.transform(marked, rate=100).collect()} == {("plain", "one <S> two")}
