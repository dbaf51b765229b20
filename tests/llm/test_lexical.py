import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import LONG, no_documents, odd_documents

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, Counter()).update(plain_terms(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * len(counts)) // length
            score = sum(n * math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, n in terms.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


WORDS = ["alpha", "Beta", "GAMMA", "delta", "ÉPÉE", "x1", "straße", "the", "a", "zeta", "eta", "theta"]


def made_documents(n, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, " ,.".join(WORDS[j] for j in np.minimum(rng.zipf(1.4, size=rng.integers(0, 60)) - 1, 11))) for i in range(n)]


@pytest.mark.parametrize("block_docs,block_bytes,sent", [(16, 1 << 20, 1 << 20), (1024, 200, 40)])
def test_against_all_scores(spark, block_docs, block_bytes, sent):
    docs = made_documents(300) + [(1000, None), (1001, " .. "), (7, "beta beta zeta"), (None, "eta theta eta"), (None, "eta theta eta")]
    # copies, so that scores tie at the last place
    docs += [(2000 + i, "zeta eta a") for i in range(40)]
    items = [(1, "Alpha the x1 x1"), (2, "zeta ETA"), (3, "épée ÉPÉE straße"), (4, None), (5, ""), (6, "unknown"), (7, "theta"), (7, "theta eta"),
             (None, "delta a"), (8, "zeta eta a " * 50)]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id bigint, text string, words string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id bigint, text string, rank int")
    made = lexical.index(df, block_docs=block_docs, block_bytes=block_bytes)
    assert rows(lexical.search(df, asked, made=made, sent_chars=sent)) == brute(docs, items)


def test_terms():
    for t in ["", "A-b_C d", "É\xa0É", "a b", "x\x7fy", "Ünïcode 12ab", "[x]{y}`z`@q"]:
        assert [w.decode() for w in lexical.terms(t.encode())] == plain_terms(t)


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(5)
    words = [f"w{i}".encode() for i in range(400)]
    hashes, docs = lexical.Hashes(), []
    for _ in range(200):
        docs.append(Counter(words[i] for i in np.minimum(rng.zipf(1.3, size=80), 400) - 1))
    bits = 2048
    field = np.zeros((bits, len(docs)), bool)
    for row, c in enumerate(docs):
        h, times = hashes.of(c), np.array(list(c.values()))
        for level, least in enumerate(lexical.LEVELS):
            field[lexical.slices(h[times >= least], level, bits), row] = True
    asked = [(q, words[int(i)], int(rng.integers(1, 9000))) for q in range(20) for i in set(rng.integers(0, 400, 6))]
    group = lexical.Items(asked, 10, hashes)
    m, top = rng.integers(25, 300, len(docs)), np.array([max(c.values()) for c in docs])
    bound = group.bounds(bits, len(docs), np.packbits(field, axis=1), top, m)
    exact = np.array([[sum(w * lexical.factor(c[t], int(m[d])) for q, t, w in asked if q == item and t in c) for d, c in enumerate(docs)] for item in group.ids])
    assert (bound >= exact).all()
    raw = np.packbits(field, axis=1).tobytes()
    group.search((bits, list(range(200)), m, top, raw, [b" ".join(c) for c in docs], [np.array(list(c.values()), "<u4").tobytes() for c in docs], m))
    assert group.scored < 0.6 * exact.size
    for q in range(len(group.ids)):
        want = sorted((-s, d) for d, s in enumerate(exact[q]) if s > 0)[:10]
        assert [(-s, d) for i, s, d in zip(*group.best[:3]) if i == q] == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "One two"), (2, "ij"), (3, "solo")], "item_id bigint, text string")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(lexical.search(docs, items)) == brute(plain, [tuple(r) for r in items.collect()])
    assert max(len(t or "") for _, t in plain) == len(LONG)
    assert lexical.search(no_documents(spark), items).count() == lexical.search(docs, items.limit(0)).count() == 0
