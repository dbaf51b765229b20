import zlib

import duckdb
import numpy as np
import public_tokenizers
from helpers import no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OURS = packing.Tokens(packing.vocabulary(), packing.added_tokens())


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\xa0ab'sS1.é,<|>endoftxt😀", max_size=40))
def test_ids_equal_the_tokenizer(text):
    assert OURS.ids(text).tolist() == library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "a", " word.", "\n", "é", "<|endoftext|><|endoftext|>"]), max_size=12).map("".join))
def test_ids_of_added_tokens(text):
    assert OURS.ids(text).tolist() == library(text)


def test_an_added_token_in_a_text():
    assert library("a <|endoftext|> b") == OURS.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_more_shards_than_partitions(spark, monkeypatch):
    cut = packing.pieces(spark.createDataFrame([(i, "a b c " * (i % 50)) for i in range(400)], "doc_id bigint, text string")).drop("ids")
    wide = sorted(map(tuple, packing.place(cut, 9).collect()))
    monkeypatch.setattr(packing, "MOST_PARTITIONS", 4)
    assert sorted(map(tuple, packing.place(cut, 9).collect())) == wide


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(4, 4) == [(0, 4)]


def test_bins_hold_at_most_so_many_and_close_the_fullest():
    bins = packing.Bins(10, 2, 0)
    assert [bins.put(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.put(8) == (2, 0)  # none fits: bin 1, the fuller, closes
    assert bins.put(3) == (0, 6) and bins.count == 2
    assert bins.put(2) == (2, 8) and bins.count == 1


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).collect()
    want = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length <= 4096
    for doc, text in want.items():
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert b"".join(r.ids for r in parts) == np.array([*library(text), 2], "<u4").tobytes()
        assert all(r.length == 1024 for r in parts[1:]) and [r.start for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) <= 1024
    assert len(by_bin) <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id bigint, text string")
    (row,) = packing.sequences(packing.pack(docs)).collect()
    assert row.length == len(row.ids) == sum(len(library(t)) + 1 for t in ("a b c", "d e"))
    assert row.ids == [*library("a b c"), 2, *library("d e"), 2] and list(row.doc_ids) == [1, 2] and list(row.starts) == [0, 4]


def test_shards_do_not_change_the_pieces(spark):
    cut = packing.pieces(odd_documents(spark)).drop("ids")
    few, many = (sorted(map(tuple, packing.place(cut, n).drop("sequence_id", "offset").collect()), key=str) for n in (1, 7))
    assert few == many


def test_odd_rows(spark):
    rows = packing.pack(odd_documents(spark)).collect()
    assert sum(1 for r in rows if r.length == 1) == 3  # null texts twice and the empty one: the end id alone
    assert len({(r.doc_id, r.piece) for r in rows if r.doc_id == 5}) == len([r for r in rows if r.doc_id == 5]) > 100
    assert packing.pack(no_documents(spark)).count() == 0
