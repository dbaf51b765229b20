import re

import duckdb
import numpy as np
import pytest
from helpers import no_documents, odd_documents

from tidemark.llm import decontaminate, licenses, toxicity

SF = "/root/testdata/sf0.01"


def plain_tiles(doc, item, least):
    """Greedy string tiling by comparing every position with every other."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = least, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((d, i))
        if not found:
            return out
        for d, i in found:
            if all(free_d[d:d + best]) and all(free_i[i:i + best]):
                out.append((d, i, best))
                free_d[d:d + best] = free_i[i:i + best] = [False] * best


def test_tiles_against_all_positions():
    rng = np.random.default_rng(3)
    for _ in range(60):
        doc, item = (rng.integers(0, 3, n).astype(np.uint64) for n in rng.integers(0, 40, 2))
        got, want = decontaminate.tile(doc, item, 3), plain_tiles(doc.tolist(), item.tolist(), 3)
        assert sorted(got) == sorted(want)


def test_documents_against_all_pairs(spark):
    con = duckdb.connect()
    docs = con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = con.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    hashed = {i: decontaminate.word_hashes(t) for i, t in items}
    grams = {i: {tuple(h[k:k + 5]) for k in range(len(h) - 4)} for i, h in hashed.items()}
    want = set()
    for d, t in docs:
        w = decontaminate.word_hashes(t)
        mine = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        for i, g in grams.items():
            if mine & g:
                share = sum(n for *_, n in decontaminate.tile(w, hashed[i], 5)) / len(hashed[i])
                if share >= decontaminate.COVERAGE:
                    want.add((d, i, round(share, 6)))
    got = decontaminate.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id, round(r.coverage, 6)) for r in got} == want and want


def test_reordered_passages_and_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    turned = "SEVEN eight, nine ten eleven TWELVE ... one two three four five six!"
    items = spark.createDataFrame([(1, item), (2, None), (3, "a b"), (None, item + " thirteen"), (1, item)], "item_id bigint, text string")
    docs = odd_documents(spark).select("doc_id", "text").union(spark.createDataFrame(
        [(10, turned), (10, turned), (None, "x " + item), (11, "one two three four five x y z"), (12, "two one")], "doc_id bigint, text string"))
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.n_tiles) for r in got) == [(0, 0, 1), (0, 1, 1), (10, 0, 2), (10, 1, 2)]
    kept = decontaminate.without_benchmark(docs, items)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 11, 12]
    assert decontaminate.without_benchmark(odd_documents(spark), items.limit(0)).columns == odd_documents(spark).columns
    assert decontaminate.contaminated(no_documents(spark), items).count() == 0


def test_cumulative_link_against_numeric_optimum():
    rng = np.random.default_rng(5)
    n, true = 3000, np.array([1.5, -1.0])
    x = rng.integers(0, 2, (n, 2)).astype(float)
    u = rng.logistic(size=n)
    grades = np.searchsorted([-0.5, 1.0, 2.0], x @ true + u)
    rows, cols = np.nonzero(x)
    w, cuts = toxicity.fit_cumulative(rows, cols, x[rows, cols], grades, 2, 4, penalty=0.0, steps=600)
    np.testing.assert_allclose(w, true, atol=0.25)
    np.testing.assert_allclose(cuts, [-0.5, 1.0, 2.0], atol=0.25)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("pmod(xxhash64(doc_id), 3) != 0")
    model = toxicity.fit(docs.join(train, "doc_id", "left_semi"), train)
    held = toxicity.grade(docs, model).join(labels.where("pmod(xxhash64(doc_id), 3) = 0"), "doc_id")
    rows = held.select("toxic", "toxicity.*").collect()
    right = sum((r.p_toxic >= toxicity.THRESHOLD) == bool(r.toxic) for r in rows)
    assert len(rows) > 1000 and right / len(rows) > 0.98
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in rows)


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (5, None, None), (None, 1, 1), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    graded = toxicity.grade(docs, model)
    assert graded.count() == 9 and graded.columns == [*docs.columns, "toxicity"]
    for empty in (labels.limit(0), labels.where("toxic = 0")):
        none = toxicity.fit(docs, empty)
        assert toxicity.reject(docs, none).count() == 9
    assert toxicity.reject(no_documents(spark), model).columns == docs.columns
    assert toxicity.reject(no_documents(spark), toxicity.fit(no_documents(spark), labels)).count() == 0


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_licenses_of_the_table(spark, license_model):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache",
             "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    want = set()
    for d, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        want |= {(d, k, lines[t]) for k, t in enumerate(text.split("\n")) if t in lines}
    got = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"), license_model).where("confirmed").collect()
    assert {(r.doc_id, r.para, r.family) for r in got} >= want
    assert len({(r.doc_id, r.para) for r in got}) <= len(want) * 1.02


def test_licenses_held_out_wordings(spark, license_model):
    rows = [(1, "This package is released under the MIT license."), (2, "Licensed under the Apache License, Version 2.0; see the file for details."),
            (3, "Redistribution and use in source and binary forms, with or without modification, is permitted provided the following conditions are met."),
            (4, "The licence of the driver was taken away."), (5, "We went to the market under the bridge."), (6, None), (7, ""), (None, "Released under the MIT License."),
            (8, "Released under the MIT License.\nReleased under the MIT License."), (8, "Released under the MIT License.\nReleased under the MIT License.")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, family string")
    got = licenses.scan(docs, license_model).where("confirmed").collect()
    assert sorted((r.doc_id or 0, r.family) for r in got) == [(0, "mit"), (1, "mit"), (2, "apache"), (3, "bsd"), (8, "mit"), (8, "mit"), (8, "mit"), (8, "mit")]
    assert licenses.by_document(licenses.scan(docs, license_model)).where("doc_id = 8").count() == 2
    assert licenses.scan(docs.limit(0), license_model).count() == 0


BSD = """Copyright (c) 2011, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def led(text, leader):
    return "".join(f"{leader}{line}\n" for line in text.splitlines())


@pytest.mark.parametrize("leader", ["", " * ", "# ", "// ", "-- ", "REM ", "dnl "])
def test_wrapped_licenses(spark, license_model, leader):
    code = "\n".join(f"int value_{k} = {k};" for k in range(40))
    texts = {1: ("bsd", BSD), 2: ("mit", MIT), 3: ("gpl", GPL), 4: ("mpl", MPL)}
    rows = [(d, code + "\n\n" + led(t, leader) + "\n" + code) for d, (_, t) in texts.items()]
    got = licenses.by_document(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), license_model)).collect()
    assert {r.doc_id: r.licenses for r in got} == {d: f for d, (f, _) in texts.items()}


def test_prose_is_no_license(spark, license_model):
    rows = [(k, t) for k, t in enumerate([
        "The apache scouts were released under the condition that they leave.", "Her software company lost its license to operate in the city.",
        "The permission of the publisher was never asked, and the copyright lapsed.", "They made free copies of the work for any person who came.",
        "A license is a text\nthat grants permission to use software,\nand this essay is about such texts."])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), license_model)
    assert got.where("confirmed").count() == 0


def plain_units(text):
    """Every paragraph of a text as (first line, last line, words), by the rules in the docstrings."""
    word = re.compile(r"[^\W_]+(?:[.-]\d+)*")
    lines = text.split("\n")
    out = {(k, k): line for k, line in enumerate(lines)}
    for j in range(0, len(lines), licenses.STEP):
        run = []
        for k in [*range(j, min(len(lines), j + licenses.STRETCH)), None]:
            if k is not None and word.search(lines[k]) and len(lines[k]) <= licenses.WRAPPED:
                run.append(k)
                continue
            if len(run) > 1 and (j == 0 or run[-1] >= j + licenses.STEP):
                out[run[0], run[-1]] = "\n".join(lines[run[0]:run[-1] + 1])
            run = []
    return {at: word.findall(t.lower()) for at, t in out.items()}


def grams_of(words):
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def test_license_claims_against_plain_scoring(spark, license_model):
    m = license_model
    weights = {r.gram: r.w for r in m.weights.collect()}
    filler = "\n".join("the sun is over the hill and it was there" for _ in range(30))
    texts = [BSD, MIT + GPL, led(MPL, "# ") + "short line\n" + filler, filler + "\n" + GPL + filler, "Released under the MIT License.\n" * 50,
             "\n\n", "Licensed under CC BY 4.0.\n" + "x" * 300 + "\nLicensed under\nCC BY-NC 4.0.", "word " * 50_000 + GPL.replace("\n", " ")]
    want = set()
    for d, text in enumerate(texts):
        claims = []
        for (first, last), words in plain_units(text).items():
            grams = grams_of(words)
            s = np.array(m.bias) + np.sum([weights[g] for g in grams if g in weights] or [np.zeros(len(m.bias))], axis=0)
            e = np.exp((s - s.max()) / m.heat)
            best = int(np.argmax(s))
            if m.classes[best] == licenses.UNKNOWN or 1 / e.sum() < licenses.ACCEPT:
                continue
            like = []
            for t in licenses.TEMPLATES[m.classes[best]]:
                mine = grams_of(re.findall(r"[^\W_]+(?:[.-]\d+)*", t.lower()))
                like.append(len({g for g in mine if g in grams and g in weights}) / len(mine))
            claims.append((max(like) >= licenses.CONFIRM, first == last, max(like), 1 / e.sum(), -first, -last, first, last, m.classes[best]))
        for c in claims:
            if not any(x[8] == c[8] and x[6] <= c[7] and x[7] >= c[6] and x[:8] > c[:8] for x in claims):
                want.add((d, c[6], c[7], c[8], round(c[3], 6), round(c[2], 6), bool(c[0])))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), m).drop("row_no").collect()
    found = {(r.doc_id, r.para, r.last, r.family, round(r.probability, 6), round(r.similarity, 6), r.confirmed) for r in got}
    assert found == want and len(got) == len(found) and {d for d, *_ in want} >= {0, 1, 2, 3, 4, 6, 7}


def test_telling_words(license_model):
    """All grams of harmless words together leave the unknown class ahead."""
    rows = license_model.weights.collect()
    telling = set(license_model.telling)
    assert 0 < len(telling) < len({r.gram for r in rows if " " not in r.gram})
    w = np.array([r.w for r in rows if not telling & set(r.gram.split(" "))])
    gap = license_model.bias[-1] - np.array(license_model.bias[:-1])
    assert (np.maximum(w[:, :-1] - w[:, -1:], 0).sum(axis=0) < gap).all() and license_model.loss < 0.1


def test_license_plan_is_native(spark, license_model, capsys):
    licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"), license_model).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
