"""Licence notices by a trained paragraph classifier, in DataFrame operations only.

A multinomial logistic regression over sparse word one- and two-grams tells licence families, and
a class of its own for paragraphs that are none. It is trained on public notice texts, each in
several damaged forms, and on paragraphs without a licence. Its probabilities are calibrated by a
temperature on damaged notices it hasn't seen; a paragraph with less than a given probability is
``unknown``. A prediction is confirmed where the paragraph holds enough of the two-grams of a
template of the predicted family.

Paragraphs are the lines of a text, and the blocks of lines between lines without a word, as a
notice may be wrapped. Every paragraph is judged by the grams that it shares with the model; paragraphs that share the
same ones are judged once. Before that, those go that can't be a notice: none of the families can
reach the class of no licence with what they share.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orograph.llm.common import cut

NONE, UNKNOWN = "none", "unknown"
#: Temperatures that the calibration chooses from.
TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
#: A family needs this calibrated probability.
LEAST_PROBABILITY = 0.7
#: Share of a template's two-grams that a confirmed paragraph holds.
LEAST_SIMILARITY = 0.6
#: Lower-case stems; a paragraph with one of them is reported even where it is no notice.
ANCHORS = ("licen", "copyright", "warrant", "redistribut", "public domain", "all rights reserved", "cc by", "cc0", "permission is hereby granted")

#: Short notices of public licences.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License. See LICENSE for details.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software', "SPDX-License-Identifier: MIT"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GPL v2 or later.", "Released under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work has been dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "proprietary": ["Copyright 2020 Example Corp. All rights reserved.", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
#: Paragraphs with anchor words or their like that are no notices.
OTHERS = ["He lost his driving licence after the accident.", "She is a licensed nurse and works at the hospital.", "The warranty covers repairs for two years.", "The band released a new album under its own label last week.", "The court issued a search warrant for the house.", "The question of copyright was discussed at the conference.", "The restaurant applied for a licence to sell alcohol.", "They redistributed the land among the farmers.", "The film entered the public domain last year, critics said.", "The Apache helicopter was released for export.", "A general election was held under the new version of the law.", "The software was free to use during the trial.", "Thank you for reading this article about copyright law in the digital age.", "Permission to build the bridge was granted by the city.", "The village has a church, a school and two shops.", "This version of the story is told in many countries.", "It rained all day and the game was postponed.", "Subscribe to our newsletter for more news."]
#: Everyday texts in four languages; the empty ones stand for texts without any word of the model.
OTHERS += [""] * 24 + ["The house is on the hill and it was built by his father.", "This is not what they said at the time, but you can be sure of it.", "He is the one that was with me in the city and as a child he had this.", "It is of use to have a copy of the book with you at all times.", "They are in this or that place, by the sea or on the way to it.", "For it is not by him that these are made, and be it as it may, as for you.", "In 2019 and 2020 the number of people in the city was 4 or 5 times as large.", "A new part of the work is to be done by the end of 2020.", "Is it that or this? Not that, and not in the way you are used to.", "From 1 to 3 of the 5 rooms are free to use.", "La casa de la ciudad es de los que no se han ido por el camino con una carta.", "En el pueblo que no es de todos se come a las dos y por la tarde.", "Der Hund und die Katze sind in dem Haus, das nicht von mir ist.", "Sie ist mit dem Zug in die Stadt gefahren und war an dem Tag nicht da.", "Le chat est dans la maison de la ville et il ne sort pas par la porte.", "Un jour elle est venue avec les enfants de la rue, et on a parlé du temps."]


#: What stands between words.
NO_WORD = r"[^\p{L}\p{N}]+"


def words_of(text) -> F.Column:
    """Lower-case words of a paragraph: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def pairs_of(words) -> F.Column:
    """Two-grams. The words stand outside the lambda: a lambda within a lambda isn't folded right."""
    n = F.size(words)
    rest = F.greatest(n - 1, F.lit(0))
    first, second = F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest)
    pairs = F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def grams(words) -> F.Column:
    return F.concat(words, pairs_of(words))


def has_anchor(text) -> F.Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(a)) for a in ANCHORS))


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of literals."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def templates(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, "family string, template string", [(f, t) for f, ts in TEMPLATES.items() for t in ts])


def examples(spark: SparkSession) -> DataFrame:
    """(family, words, fold): notices in 24 damaged forms, fold 0 of them for the calibration; other texts likewise."""
    rows = templates(spark).select("family", F.col("template").alias("text"))
    rows = rows.union(literal_rows(spark, "family string, text string", [(NONE, t) for t in OTHERS]))
    heads = literal_rows(spark, "form int, head string", [(i, h) for i, h in enumerate(["", "Copyright (c) 2019 the authors. ", "License: ", "Note: "] * 6)])
    rows = rows.join(F.broadcast(heads), F.when(F.col("family") == NONE, F.col("form") % 4 == 0).otherwise(F.lit(True)))
    words = words_of(F.concat(F.when(F.col("family") == NONE, "").otherwise(F.col("head")), "text"))
    # each form but the first four misses about a word in eight
    lost = F.filter(words, lambda w: (F.col("form") < 4) | (F.pmod(F.xxhash64(w, "form", "text"), F.lit(8)) > 0))
    return rows.select("family", grams(lost).alias("grams"), (F.pmod(F.xxhash64("text", "form"), F.lit(3)) == 0).cast("int").alias("fold"))


_MODELS: dict[str, tuple] = {}


def train(spark: SparkSession) -> tuple[list[str], list[tuple[str, list[float]]], list[float], float]:
    """(families, n-grams with their weights for each family, intercepts, temperature). The examples are fixed, and so is the model."""
    key = spark.sparkContext.applicationId
    if key not in _MODELS:
        families = [NONE, *sorted(TEMPLATES)]
        number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
        rows = examples(spark).select(number.alias("label"), "grams", "fold").coalesce(1)
        grams_used = sorted(r[0] for r in rows.where("fold = 0").select(F.explode("grams")).distinct().collect())
        vectors = CountVectorizerModel.from_vocabulary(grams_used, inputCol="grams", outputCol="features", binary=True)
        rows = vectors.transform(rows).cache()
        model = LogisticRegression(family="multinomial", maxIter=60, regParam=3e-3, tol=1e-9).fit(rows.where("fold = 0"))
        raw = model.transform(rows.where("fold = 1")).select("label", vector_to_array("rawPrediction").alias("raw"))
        # the temperature with the least loss on the notices that were held out
        terms = []
        for t in TEMPERATURES:
            exps = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp(x / t))  # noqa: B023
            terms.append(F.avg(F.log(exps) - F.get("raw", F.col("label").cast("int")) / t).alias(str(t)))
        best = raw.agg(*terms).first().asDict()
        rows.unpersist()
        weights = model.coefficientMatrix.toArray().T.round(9).tolist()
        _MODELS[key] = (families, list(zip(grams_used, weights, strict=True)), model.interceptVector.toArray().tolist(), float(min(best, key=best.get)))
    return _MODELS[key]


def template_pairs() -> set[str]:
    """Two-grams of all templates."""
    words = [[w for w in re.split(r"[\W_]+", t.lower()) if w] for ts in TEMPLATES.values() for t in ts]
    return {f"{a} {b}" for ws in words for a, b in zip(ws, ws[1:], strict=False)}


def shared_grams(words, weights: list[tuple[str, list[float]]]) -> F.Column:
    """The different grams of a paragraph that the model or a template has: all that a verdict depends on."""
    known = {g for g, _ in weights} | template_pairs()
    pairs = [g.split(" ") for g in known if " " in g]
    firsts, seconds, both = (sorted(x) for x in ({p[0] for p in pairs}, {p[1] for p in pairs}, {" ".join(p) for p in pairs}))
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    # only words that begin and end known pairs are put together
    near = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.when(a.isin(firsts) & b.isin(seconds), F.concat(a, F.lit(" "), b)))
    single = F.filter(words, lambda w: w.isin(sorted(g for g in known if " " not in g)))
    return F.array_distinct(F.concat(single, F.filter(near, lambda g: g.isin(both))))


def most_lead(shared, weights: list[tuple[str, list[float]]], bias: list[float]) -> F.Column:
    """At least the lead of the best family over none: each gram counts with its best family, rounded up to half a power of two."""
    levels: dict[int, list[str]] = {}
    for g, w in weights:
        if (best := max(w[1:]) - w[0]) > 0:
            levels.setdefault(math.ceil(math.log2(max(best, 1 / 64)) * 2), []).append(g)
    terms = (F.size(F.filter(shared, lambda g: g.isin(held))) * (2 ** (k / 2)) for k, held in sorted(levels.items()))  # noqa: B023
    return reduce(lambda a, b: a + b, terms, F.lit(max(bias[1:]) - bias[0]))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(id, paragraph, lines, line, words) from (id, split), lower case: each line, and each block of two lines or more joined by spaces.

    A line's words are found once, for itself and for its block.
    """
    rows = rows.withColumn("words", F.transform("split", lambda x: F.array_remove(F.split(x, NO_WORD), "")))
    n = F.size("split")
    is_worded = lambda i: F.coalesce(F.size(F.get("words", i - 1)) > 0, F.lit(False))
    numbers = F.when(n > 0, F.sequence(F.lit(1), n))
    rows = rows.withColumn("first", F.filter(numbers, lambda i: is_worded(i) & ~is_worded(i - 1)))
    rows = rows.withColumn("last", F.filter(numbers, lambda i: is_worded(i) & ~is_worded(i + 1)))

    def told(paragraph, lines, line, words) -> F.Column:
        return F.struct(paragraph.alias("paragraph"), lines.alias("lines"), line.alias("line"), words.alias("words"))

    block = F.zip_with("first", "last", lambda a, b: told(a, b - a + 1, F.array_join(F.slice("split", a, b - a + 1), " "), F.flatten(F.slice("words", a, b - a + 1))))
    line = F.transform("split", lambda x, i: told(i + 1, F.lit(1), x, F.get("words", i)))
    return rows.select("id", F.inline(F.concat(line, F.filter(block, lambda b: b["lines"] > 1))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_probability: float = LEAST_PROBABILITY, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """(id_col, paragraph, lines, family, probability, similarity, confirmed) for each paragraph of docs that is a notice or holds an anchor.

    Paragraphs are the lines of a text, numbered from 1, and its blocks of two lines or more, with the
    number of their first line; lines says how many they have. All are judged. family is one of TEMPLATES,
    ``unknown`` or, for those with an anchor, ``none``. similarity: the share of two-grams of the family's
    best template in the paragraph, 0 for none and unknown. Null and empty texts have no
    paragraphs. Repeated rows each give theirs. Whole texts and paragraphs of any length are read.
    Columns beside those named are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    families, weights, bias, t = train(spark)
    rows = paragraphs(rows.select("id", F.split(F.lower("text"), r"\n").alias("split")))
    # exploded, so that the filter isn't pushed below, which would work out the grams anew for each of its terms
    rows = rows.select("id", "paragraph", "lines", has_anchor(F.col("line")).alias("anchor"), F.explode(F.array(shared_grams(F.col("words"), weights))).alias("grams"))
    rows = rows.where(F.col("anchor") | (most_lead("grams", weights, bias) >= 0))
    # elsewhere the hash of the grams stands for them
    rows = cut(rows.withColumn("grams", F.array_sort("grams")).withColumn("h", F.sha2(F.array_join("grams", "\n"), 256)))
    distinct = cut(rows.groupBy("h").agg(F.first("grams").alias("grams")))

    table = literal_rows(spark, "gram string, w array<double>", weights)
    found = distinct.select("h", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    sums = found.groupBy("h").agg(*[F.sum(F.get("w", F.lit(k))).alias(f"s{k}") for k in range(len(families))])
    scored = distinct.join(sums, "h", "left")
    logits = [(F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + float(b)) / t for k, b in enumerate(bias)]
    top = F.greatest(*logits)
    total = reduce(lambda a, b: a + b, [F.exp(x - top) for x in logits])
    guess = F.array_max(F.array(*[F.struct(x.alias("x"), F.lit(f).alias("f")) for x, f in zip(logits, families, strict=True)]))
    scored = scored.select("h", "grams", guess["f"].alias("guess"), (1 / total).alias("probability"))

    kept = templates(spark).select("family", F.xxhash64("template").alias("template"), F.array_distinct(pairs_of(words_of("template"))).alias("pairs"))
    sizes = kept.select(F.col("family").alias("guess"), "template", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))
    seen = scored.where(F.col("guess") != NONE).select("h", "guess", F.explode("grams").alias("pair"))
    shared = seen.join(F.broadcast(sizes), ["guess", "pair"]).groupBy("h", "template").agg((F.count("*") / F.first("size")).alias("share"))
    best = shared.groupBy("h").agg(F.max("share").alias("similarity"))
    judged = scored.select("h", "guess", "probability").join(best, "h", "left")
    known = (F.col("guess") != NONE) & (F.col("probability") >= least_probability)
    similarity = F.when(known, F.coalesce("similarity", F.lit(0.0))).otherwise(0.0)
    family = F.when(F.col("guess") == NONE, NONE).when(known, F.col("guess")).otherwise(UNKNOWN)
    judged = judged.select("h", family.alias("family"), F.round("probability", 6).alias("probability"), F.round(similarity, 6).alias("similarity"))
    judged = cut(judged.withColumn("confirmed", F.col("similarity") >= least_similarity))
    return rows.select("id", "paragraph", "lines", "anchor", "h").join(judged, "h").where((F.col("family") != NONE) | F.col("anchor")).select(F.col("id").alias(id_col), "paragraph", "lines", "family", "probability", "similarity", "confirmed")
