"""License scans: paragraphs are classified by word n-grams, and predictions are confirmed by templates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.sources.shared import as_table

UNKNOWN = "unknown"
# fixed texts: short notices and the telling sentences of public licences, by family
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache License 2.0. SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This software is licensed under the MIT license. SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Distributed under the terms of the GNU General Public License v2. SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1. SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license. SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0. SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. CC BY-SA 4.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.",
    ],
    "proprietary": [
        "Copyright, all rights reserved. No part of this publication may be reproduced or distributed in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
# prose that says licence, copyright, software or free without granting anything: hard cases of the unknown class
PROSE = [
    "The licence of the driver was taken away after the third accident.", "She applied for a license to sell wine in the old harbour.",
    "He holds a master's degree and a license to practice medicine.", "Copyright law was changed twice in that decade.",
    "The software was slow, so they went back to paper.", "The GNU is a large antelope of the southern plains.",
    "Apache helicopters were seen over the valley on Monday.", "MIT and Harvard share a library on the other bank of the river.",
    "The museum is free and open to the public on Sundays.", "All rights and duties pass to the heirs.",
    "The work was released in 1987 and sold well.", "You may not park here without permission of the owner.",
    "The court asked whether the source of the claim could be named.", "Free software was the subject of her first talk.",
    "The contract was terminated under the terms agreed in writing.", "The files were copied to the new machine without loss.",
    "This version of the story is the one that most people know.", "A copy of the letter was found in the public archive.",
    "Parliament debated the licensing of taxis until midnight.", "The foundation published a list of all its members.",
    "Any person who has lost a bag should ask at the desk.", "The notice above the door was in Latin.",
    "The documentation of the bridge shows no such condition.", "They were permitted to use the hall, provided that it was clean.",
    "His copyright claim against the newspaper was rejected.", "Warranties on used cars are rarely worth the paper.",
    "The source code of the game was stolen last year.", "The general public was not admitted to the trial.",
    "Which license should a young project choose? Opinions differ.", "She compared the Apache and MIT licenses in an essay.",
]
# bounds of the training: copies of each template with words left out, and documents that give paragraphs of the unknown class
COPIES, PLAIN_DOCS, PLAIN_PARAGRAPHS = 40, 300, 2000
# least share of a template's words that a confirmed paragraph has, and least probability of a prediction
CONFIRM, ACCEPT = 0.6, 0.5
# longest line that counts as wrapped, lines of a stretch, and lines between the starts of two stretches
WRAPPED, STRETCH, STEP = 200, 24, 12


def words_of(text: str) -> str:
    """SQL: words of a text in lower case; digits stay with their dots (``4.0``)."""
    return f"regexp_extract_all(lower({text}), '[\\\\p{{L}}\\\\p{{N}}]+(?:[.-][\\\\p{{N}}]+)*', 0)"


# one- and two-word grams of ``words``
GRAMS = "concat(words, zip_with(slice(words, 1, greatest(0, size(words) - 1)), slice(words, 2, greatest(1, size(words))), (a, b) -> concat(a, ' ', coalesce(b, ''))))"


def _grams(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.expr(words_of("text"))).withColumn("grams", F.array_distinct(F.expr(GRAMS)))


@dataclass(frozen=True)
class Model:
    """``weights``: (gram, w array<double>), one weight a class; ``bias`` and ``classes`` in the same order;
    ``heat``: the divisor of all scores that makes the probabilities fit held-out paragraphs, ``loss`` their log loss there;
    ``telling``: words of which every paragraph that a family claims has at least one."""

    weights: DataFrame
    bias: list[float]
    classes: list[str]
    heat: float
    loss: float
    telling: list[str]


def templates(spark: SparkSession) -> DataFrame:
    """(family, template, text)"""
    rows = [(f, k, t) for f, texts in TEMPLATES.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, text string")


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_no, para, text): the non-blank lines of every document; ``row_no`` tells rows alike in id apart."""
    return (pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string").withColumn("row_no", F.monotonically_increasing_id())
            .select("doc_id", "row_no", F.posexplode(F.split("text", "\n")).alias("para", "text")).where("trim(text) != ''"))


def paragraphs(docs: DataFrame, telling: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_no, para, last, text): lines, and wrapped lines joined, that have a word of ``telling``.

    ``para`` and ``last`` are line numbers from 0. Every line is a paragraph of its own. Besides, neighbouring lines of at
    most ``WRAPPED`` characters are joined; a line without a letter or digit (blank, or a bare comment leader) or a longer
    line ends the paragraph. Comment leaders are no words; ``rem`` and ``dnl`` at the start of a line are removed. Paragraphs
    are joined within stretches of ``STRETCH`` lines that start every ``STEP`` lines, so whatever spans up to
    ``STRETCH - STEP + 1`` lines is whole in one of them; parts that the stretch before holds too are left to that one.
    """
    has = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in telling)
    hot = f"exists({words_of('l')}, w -> w IN ({has}))" if telling else "false"
    lines = f"transform(split(text, '\\n'), (l, i) -> struct(i AS line, l AS text, {hot} AS hot))"
    kind = "array<struct<para:int,last:int,text:string>>"
    # the paragraphs of one stretch: a line goes to the last paragraph or opens one
    joined = f"""aggregate(slice(lines, j + 1, {STRETCH}), CAST(array() AS {kind}), (a, s) -> CASE
        WHEN length(s.text) > {WRAPPED} OR NOT s.text RLIKE '[\\\\p{{L}}\\\\p{{N}}]' THEN a
        WHEN size(a) > 0 AND try_element_at(a, -1).last = s.line - 1 THEN concat(slice(a, 1, size(a) - 1), array(named_struct(
            'para', try_element_at(a, -1).para, 'last', s.line, 'text', concat(try_element_at(a, -1).text, '\\n', s.text))))
        ELSE concat(a, array(named_struct('para', s.line, 'last', s.line, 'text', s.text))) END)"""
    starts = f"filter(sequence(0, size(lines) - 1, {STEP}), j -> exists(slice(lines, j + 1, {STRETCH}), s -> s.hot))"
    runs = f"flatten(transform({starts}, j -> filter({joined}, r -> r.last > r.para AND (j = 0 OR r.last >= j + {STEP}))))"
    alone = "transform(filter(lines, s -> s.hot), s -> named_struct('para', s.line, 'last', s.line, 'text', s.text))"
    rows = (pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string").withColumn("row_no", F.monotonically_increasing_id())
            .select("doc_id", "row_no", F.expr(lines).alias("lines")))
    # outer, since the plain form would work out all lines twice to drop empty lists beforehand
    found = rows.select("doc_id", "row_no", F.explode_outer(F.expr(f"concat({alone}, {runs})")).alias("p")).where("p IS NOT NULL")
    return found.select("doc_id", "row_no", "p.para", "p.last",
                        F.regexp_replace("p.text", r"(?im)^[ \t]*(?:rem|dnl)[ \t]", " ").alias("text"))


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", copies: int = COPIES, plain_docs: int = PLAIN_DOCS, plain: int = PLAIN_PARAGRAPHS) -> DataFrame:
    """(label, fold, grams): copies of every template with about one word in six left out, and plain paragraphs.

    Plain ones are from the ``plain_docs`` documents of the least id hash, at most ``plain`` paragraphs without the word
    license, the sentences of ``PROSE``, and shuffled words of the templates, so that single words of a notice are no notice.
    """
    spark = docs.sparkSession
    base = (templates(spark).select("family", "template", "text", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
            .withColumn("words", F.expr(words_of("text"))))
    # the first copy is whole; a hash decides which words others lose
    kept = ("filter(transform(words, (w, i) -> struct(w, i)), s -> copy = 0 OR size(words) < 6 OR "
            "pmod(xxhash64(family, template, copy, s.i), 6) != 0)")
    notices = base.select(F.col("family").alias("label"), (F.col("copy") % 5).alias("fold"), F.expr(f"transform({kept}, s -> s.w)").alias("words"))
    mixed = (base.where("copy < 8").select(F.lit(UNKNOWN).alias("label"), (F.col("copy") % 5).alias("fold"), F.expr(
        "slice(transform(array_sort(transform(words, (w, i) -> struct(xxhash64(w, i, copy), w))), s -> s.w), 1, 1 + copy % 6)").alias("words")))
    named = pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string")
    # at most plain_docs ids
    drawn = named.select("doc_id").distinct().where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(plain_docs)
    calm = (lines_of(named.join(F.broadcast(drawn), "doc_id", "left_semi")).where("NOT lower(text) RLIKE 'licen|copyright|gnu|apache'").orderBy(F.xxhash64("doc_id", "para"), "text").limit(plain)
            .select(F.lit(UNKNOWN).alias("label"), F.pmod(F.xxhash64("doc_id", "para"), F.lit(5)).cast("int").alias("fold"), F.expr(words_of("text")).alias("words")))
    hard = (spark.createDataFrame(list(enumerate(PROSE)), "k int, text string").select(
        F.lit(UNKNOWN).alias("label"), (F.col("k") % 5).alias("fold"), F.expr(words_of("text")).alias("words"), F.explode(F.sequence(F.lit(1), F.lit(4)))).drop("col"))
    rows = notices.union(mixed).union(calm).union(hard)
    return rows.withColumn("grams", F.array_distinct(F.expr(GRAMS))).select("label", "fold", "grams")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 2) -> Model:
    """A multinomial logistic regression on sparse one- and two-word grams, calibrated on a fold it has not seen.

    The divisor of the scores is that of the least log loss on the held-out fold, from a fixed grid.
    """
    spark = docs.sparkSession
    rows = as_table(training_rows(docs, doc_id, text), "license-training")
    classes = [*TEMPLATES, UNKNOWN]
    numbered = rows.withColumn("y", F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("double") - 1)
    # grams of templates only: others tell nothing of a licence
    vocabulary = CountVectorizer(inputCol="grams", outputCol="x", binary=True, minDF=least, vocabSize=4000).fit(
        rows.where(F.col("label") != UNKNOWN).select("grams"))
    table = vocabulary.transform(numbered)
    solver = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.001, maxIter=60, standardization=False)
    model = solver.fit(table.where("fold != 0"))
    scores = model.transform(table.where("fold = 0")).select("y", F.expr("CAST(y AS INT)").alias("k"), "rawPrediction")
    raw = scores.withColumn("s", _as_array("rawPrediction"))
    grid = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    loss = raw.agg(*[F.avg(F.expr(f"ln(aggregate(s, 0D, (a, v) -> a + exp((v - array_max(s)) / {h}))) - (s[k] - array_max(s)) / {h}")).alias(str(k))
                     for k, h in enumerate(grid)]).first()
    least_loss, heat = min(zip([v if v is not None else 0.0 for v in loss], grid))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows_ = [(g, [float(v) for v in matrix[:, k]]) for k, g in enumerate(vocabulary.vocabulary)]
    # at most one row a word of the vocabulary
    common = [r.w for r in rows.where(F.col("label") == UNKNOWN).select(F.explode("grams").alias("w")).join(
        F.broadcast(spark.createDataFrame([(g,) for g in vocabulary.vocabulary if " " not in g], "w string")), "w", "left_semi")
        .groupBy("w").count().orderBy(F.desc("count"), "w").collect()]
    return Model(spark.createDataFrame(rows_, "gram string, w array<double>"), [float(b) for b in bias], classes, heat,
                 float(least_loss), telling_words(vocabulary.vocabulary, matrix, bias, common))


def telling_words(grams: list[str], matrix: np.ndarray, bias: np.ndarray, common: list[str]) -> list[str]:
    """Words without which no family beats the unknown class, the last one: all words of ``grams`` but harmless ones.

    Words that plain text uses most are tried first. They stay harmless while all grams made only of harmless words, taken
    together, lift no family above the unknown class; a paragraph of no other words is then unknown for certain.
    """
    lift, gap = np.maximum(matrix[:-1] - matrix[-1:], 0.0), bias[-1] - bias[:-1]
    places: dict[str, list[int]] = {}
    for k, g in enumerate(grams):
        for w in set(g.split(" ")):
            places.setdefault(w, []).append(k)
    harmless: set[str] = set()
    total = np.zeros(len(gap))
    if (gap > 0).all():
        for w in [*common, *sorted(places.keys() - set(common))]:
            new = [k for k in places.get(w, []) if all(v == w or v in harmless for v in grams[k].split(" "))]
            more = total + lift[:, new].sum(axis=1)
            if (more < gap - 1e-9).all():
                harmless.add(w)
                total = more
    return sorted(places.keys() - harmless)


def _as_array(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, row_no, para, last, family, probability, similarity, confirmed): every paragraph that some licence family claims.

    Paragraphs are lines and joined wrapped lines (:func:`paragraphs`), ``para`` to ``last`` their line numbers. The family is
    the likeliest class; paragraphs whose class is unknown, or whose probability is below ``accept``, are left out.
    ``similarity`` is the largest share of a template's grams that the paragraph has, over templates of that family; a
    prediction is confirmed from ``confirm`` on. Of overlapping paragraphs of one family the best stays: confirmed ones before
    others, then single lines, then the more similar, the likelier, the earlier. Families of equal score: the first one named
    in ``TEMPLATES``. Paragraphs without a telling word cannot be claimed and never leave their document's row, which is
    exact. Null or empty texts give nothing, null ids stay null, repeated rows are told apart by ``row_no``; an empty table
    gives no rows; further columns are not read.

    Weights are one row per gram of the vocabulary, at most 4000, so they may go to every executor.
    """
    n = len(model.classes)
    at = ["doc_id", "row_no", "para", "last"]
    grams = _grams(paragraphs(docs, model.telling, doc_id, text)).select(*at, F.explode("grams").alias("gram"))
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)]
    scored = grams.join(F.broadcast(model.weights), "gram").groupBy(*at).agg(*sums, F.collect_list("gram").alias("grams"))
    total = F.array(*[(F.col(f"s{k}") + F.lit(model.bias[k])) / F.lit(model.heat) for k in range(n)])
    top = "array_max(s)"
    labels = F.array(*map(F.lit, model.classes))
    best = (scored.select(*at, "grams", total.alias("s"))
            .withColumn("probability", F.expr(f"1D / aggregate(s, 0D, (a, v) -> a + exp(v - {top}))"))
            .withColumn("family", F.element_at(labels, F.expr(f"CAST(array_position(s, {top}) AS INT)")))
            .where((F.col("family") != UNKNOWN) & (F.col("probability") >= accept)))
    known = (_grams(templates(docs.sparkSession)).groupBy("family").agg(F.collect_list("grams").alias("texts")))
    alike = F.expr("array_max(transform(texts, t -> CAST(size(array_intersect(t, grams)) AS DOUBLE) / size(t)))")
    claims = (best.join(F.broadcast(known), "family").withColumn("similarity", alike)
              .select(*at, "family", "probability", "similarity", (F.col("similarity") >= confirm).alias("confirmed"))
              .withColumn("mark", F.expr("struct(confirmed, para = last AS single, similarity, probability, -para AS early, -last AS short, para, last)")))
    # a paragraph has at most STRETCH lines, so the frame holds few claims however many the document has
    near = Window.partitionBy("row_no", "family").orderBy("para").rangeBetween(-STRETCH, STRETCH)
    return (claims.withColumn("near", F.collect_list("mark").over(near))
            .where("NOT exists(near, x -> x.para <= mark.last AND x.last >= mark.para AND x > mark)").drop("near", "mark"))


def by_document(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, families, licenses, probability): documents with a claimed paragraph; ``licenses`` the
    confirmed families, ``probability`` that of the surest."""
    return scanned.groupBy("doc_id", "row_no").agg(
        F.count("*").alias("n_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licenses"),
        F.max("probability").alias("probability")).drop("row_no")
