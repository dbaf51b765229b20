import base64
import hashlib
import math

import pytest
from pyarrow import fs

from tidemark.llm import chat, topk, warc


def brute_top(rows, k, every):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(whole, reverse=True) if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


VECTORS = [(i, [((i * 37 + d * 11) % 19 - 9) / 7 for d in range(3)]) for i in range(120)]
ODD = [(200, None), (250, [None, 1.0, 2.0]), (251, [float("nan"), 1.0, 2.0]), (300, [float("inf"), 1.0, 2.0]), (None, [1.0, 2.0, 3.0]),
       (7, [9.0, 9.0, 9.0]), (8, [1.0, 1.0]), (350, [2.0, 1.0]), (400, []), (50, [0.5, 0.5, 0.5])]


@pytest.mark.parametrize("rows,k,sent", [(VECTORS, 5, 8 << 20), (VECTORS + ODD, 5, 1), (VECTORS[:3], 5, 1 << 20), ([(i, [1.0]) for i in range(300)], 4, 1 << 20)])
def test_top_k_against_all_scores(spark, rows, k, sent):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, score string, rank int")
    got = topk.top_k(df, k, 50, sent_bytes=sent, block=16)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, k, 50)


def test_top_k_of_large_values_and_of_nothing(spark):
    rows = [(i, [1e5 * (i % 7), -3e5 + i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 3, 20).collect())) == brute_top(rows, 3, 20)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_with_one_large_component(spark):
    """No refusal while every score but that of a vector with itself fits 64 bits."""
    rows = [(0, [9e6, 0.0]), (1, [1.0, -2.0]), (2, [-3.0, 1.0]), (3, [2.5, 2.0]), (100, [0.0, 1e9]), (101, [0.0, 4.0]), (150, [-2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 4, 50).collect())) == brute_top(rows, 4, 50)
    # 2^63 itself is one too many, -2^63 is not
    edge = [(0, [2.0 ** 23 / 2, 0.0]), (1, [2.0 ** 24, 0.0]), (2, [-2.0 ** 24, 0.0])]
    near = [(0, [2.0 ** 24, 0.0]), (1, [-2.0 ** 23, 0.0]), (2, [2.0 ** 23 - 1, 5.0])]
    for part in (edge, near):
        df = spark.createDataFrame(part, "vec_id bigint, embedding array<double>")
        assert sorted(map(tuple, topk.top_k(df, 4, 50).collect())) == brute_top(part, 4, 50)
    for bad in ([(0, [2.0 ** 24, 0.0]), (1, [2.0 ** 23, 0.0])], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="fit 64 bits"):
            topk.top_k(spark.createDataFrame(bad, "vec_id bigint, embedding array<double>")).collect()


@pytest.mark.parametrize("text", ["", "\\", "<|end|>\n", "\\<|turn x|>", "<|>", "<\\|", "a<", "|", "|>|>", "\\\\|", "### Assistant: </turn>"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text) and "|>" not in chat.escape(text)
    assert chat.turns(chat.turn(text, text) * 2) == [(text, text)] * 2


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|end|>\n"), (1, 2, "user", None), (1, 3, "assistant", "b\\"), (1, 4, "user", "bye"),
            (2, 0, "user", "no reply"), (None, None, None, None), (None, 0, "assistant", "x"), (3, 1, "assistant", ""), (3, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, example string")
    made = {}
    for r in chat.expand(df).collect():
        made.setdefault(r.conv_id, []).append(r)
    assert {c: len(v) for c, v in made.items()} == {1: 3, 2: 1, None: 2, 3: 2}
    first, second, tail = sorted(made[1], key=lambda r: r.example)
    assert chat.unescape(first.text[first.loss_start:first.loss_end]) == "a<|end|>\n" and first.text.startswith(chat.turn("user", "hi"))
    assert second.text.startswith(first.text) and chat.unescape(second.text[second.loss_start:second.loss_end]) == "b\\"
    assert tail.loss_start == tail.loss_end == len(tail.text) and tail.text.startswith(second.text)
    got = {r.conv_id: r for r in chat.digests(chat.expand(df)).collect()}
    said = "".join(f"{w or ''}\n{t or ''}\n" for c, _, w, t in rows if c == 1)
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 5
    assert got[1].loss_chars == 11 and got[1].loss_sha256 == hashlib.sha256(b"a<|end|>\nb\\").hexdigest()
    assert got[1].formatted_chars == sum(len(r.text) for r in made[1]) and got[1].n_examples == 3
    assert (got[2].loss_chars, got[2].n_turns, got[None].n_turns, got[3].n_turns) == (0, 1, 2, 2)
    assert chat.digests(chat.expand(df.limit(0))).count() == 0


def test_long_conversation(spark):
    df = spark.range(600).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('ab ', 50) AS text")
    (row,) = chat.digests(chat.expand(df)).collect()
    assert row.n_turns == 600 and row.n_examples == 300 and row.loss_chars == 300 * 150


PAGES = [(5, "http://a/é x", "same"), (3, "http://b\r\nX: y", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "u", "lone é"),
         (None, "u", "lone é"), (None, None, "only"), (6, "u", "twin"), (6, "u", "twin"), (7, "u", "x" * 3_000_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id bigint, url string, html string, frame string").repartition(2)
    index = warc.write(pages, str(tmp_path / "w"))
    got = warc.read(index, str(tmp_path / "w")).collect()
    firsts = {"same": 3, "": 1, "lone é": 4, "only": None, "twin": 6, "x" * 3_000_000: 7}
    want = []
    for page, url, html in PAGES:
        h = (html or "").encode()
        first = firsts[html or ""]
        again = first is not None and page != first
        want.append((page, "revisit" if again else "response", first if again else None, base64.b32encode(hashlib.sha1(h).digest()).decode(),
                     len(h), b"" if again else h))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, bytes(r.payload))) for r in got)
    assert {r.page_id: r.url for r in got}[3] == "http://b\r\nX: y"
    (one,) = warc.read(index.where("page_id = 4"), str(tmp_path / "w")).collect()
    assert bytes(one.payload) == "lone é".encode()
    for name in index.select("bundle").distinct().collect():
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "w" / name[0])) as file:
            assert warc.seek_table(file)
    assert warc.write(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_record_ids_are_unique_and_referred_to(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id bigint, url string, html string, frame string").repartition(2).cache()
    index = warc.write(pages, str(tmp_path)).collect()
    ids = {r.record_id for r in index}
    assert len(ids) == len(index) == len(PAGES)
    seen = {}
    for r in index:
        with fs.LocalFileSystem().open_input_file(str(tmp_path / r.bundle)) as file:
            head, block, _ = warc.parse(warc.read_frame(file, warc.seek_table(file), r.frame), r.offset)
        assert head["WARC-Record-ID"] == r.record_id
        seen[r.record_id] = head
    referred = [h["WARC-Refers-To"] for h in seen.values() if h["WARC-Type"] == "revisit"]
    assert referred and all(seen[i]["WARC-Type"] == "response" for i in referred)
    assert all(seen[h["WARC-Refers-To"]]["X-Page-Id"] == h["X-Refers-To-Page"] for h in seen.values() if "WARC-Refers-To" in h)


def test_reading_takes_tasks_by_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "TASK_FRAMES", 2)
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    pages = spark.range(60).selectExpr("id AS page_id", "'u' AS url", "concat(id, repeat('x', 900)) AS html")
    index = warc.write(pages, str(tmp_path))
    frames = index.select("bundle", "frame").distinct().count()
    got = warc.read(index, str(tmp_path))
    assert got.rdd.getNumPartitions() == -(-frames // 2) and got.count() == 60


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read(warc.write(pages, str(tmp_path), least=3), str(tmp_path)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
