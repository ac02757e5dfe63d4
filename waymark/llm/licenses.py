"""Licence scan by a trained paragraph classifier (DataFrame operations and Spark's own models only).

Every paragraph (line) that is not blank is classified by logistic regression on the word 1- and 2-grams of
the fixed texts below, weighed by the paragraph's length: a class for each licence family and one for everything else.  The probability of being a licence at
all is calibrated (Platt scaling) on held-out templates, whose parts the scaled model has not seen, weighted
as if ``PRIOR`` of all paragraphs were licences.  Reported
are the paragraphs with a calibrated probability of at least ``DOUBT``: of a family from one half on, of
unknown kind below it or where no family has half of what all families have.
A prediction counts as confirmed if enough of the paragraph's word 3-grams, or of a template's, are shared
with a template of that family.

It learns from the templates (whole, in sentences, halves and wrapped lines, among other words), from
fixed sentences that use the same words otherwise, and from at most ``NEGATIVES`` distinct paragraphs of the
corpus, picked by hash, that share no word 3-gram with a template; a third of them are hard ones, which hold a
word stem in ``STEMS``.

Defined results: null and empty texts have no paragraphs and give no rows; a line that occurs several
times is reported each time; repeated rows are reported alike; null doc_ids are reported as null; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import literal_table, sampled, settle, table

NEGATIVES, CONFIRM, DOUBT, PRIOR, UNKNOWN, BLOCK, FOLDS = 3000, 0.5, 0.2, 0.02, "unknown", 256, 5
STEMS = r"(?i)licen[cs]|copyright|copyleft|warrant|public domain|rights reserved|\bgpl|\bcc[ -](by|0)|spdx|redistribut|permission is"

# Notices and opening words of public licences, by family.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license. See LICENSE file in the project root for full license information."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("mit", "This project is available under the terms of the MIT License. SPDX-License-Identifier: MIT"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("public-domain", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
    ("reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
)
# Names and phrases that stand alone on a line, by family.
NAMES = (
    ("mit", "The MIT License"), ("mit", "The software is provided as is"), ("mit", "In no event shall the authors be liable"),
    ("mit", "In no event shall the authors or copyright holders be liable"),
    ("apache", "Apache-2.0"), ("apache", "Apache 2.0"), ("apache", "Apache License 2.0"), ("gpl", "GPL-3.0-or-later"), ("gpl", "GNU GPL v3"),
    ("lgpl", "LGPL-2.1-or-later"), ("bsd", "BSD-3-Clause"), ("mpl", "MPL-2.0"), ("cc-by-nc", "CC-BY-NC-4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International"), ("cc-by-sa", "CC-BY-SA-4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International"), ("cc-by", "CC-BY-4.0"),
    ("cc-by", "Creative Commons Attribution 4.0 International"), ("public-domain", "CC0-1.0"), ("public-domain", "CC0 1.0 Universal"),
)
# Other uses of the same words.
OTHERWISE = (
    "The driver had lost his license and could not rent a car.",
    "She paid the licence fee for the television every year.",
    "A fishing license is required at the lake from May to September.",
    "The bar may lose its liquor license after the complaint.",
    "The house was sold with a warranty on the roof and the boiler.",
    "Police searched the flat without a warrant and found nothing.",
    "The court issued a warrant for the arrest of the suspect.",
    "He took poetic license with the story of the battle.",
    "The results do not warrant such a conclusion.",
    "The museum debated the copyright of old photographs in a lecture.",
    "A copyright dispute between the two bands went on for years.",
    "Land was redistributed among the farmers after the reform.",
    "The government plans to redistribute income through taxes.",
    "License plates are made in the state prison.",
    "Permission is needed from the parents for the trip.",
    "The new version of the game has better graphics and sound.",
    "Public transport in the city is free on the weekend.",
    "The general public was not admitted to the hearing.",
    "The pilot renewed her licence in the spring.",
    "The warranty of the washing machine ended last week.",
)


def _bound(value, use):
    """``use(value)`` with the value computed once, however often ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(sizes):
    """The sum of all sizes before each one; sums of whole blocks are shared, so long arrays cost no square."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda s, n: s + n)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")), lambda b: add(F.slice(sizes, b * BLOCK + 1, BLOCK)))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
    return _bound(before, lambda sums: F.transform(sizes, lambda _, k: F.get(sums, F.floor(k / BLOCK).cast("int")) + add(F.slice(sizes, F.floor(k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, start, body): the lines of whole texts that are not blank; start counts code points."""
    lines = F.split("text", "\n")
    starts = _bound(F.transform(lines, lambda line: F.length(line) + 1), _starts)
    each = F.zip_with(lines, starts, lambda line, start: F.struct(start.alias("start"), line.alias("body")))
    rows = docs.select("doc_id", F.posexplode(each).alias("paragraph", "_line"))
    return rows.select("doc_id", "paragraph", F.col("_line.start").cast("bigint").alias("start"), F.col("_line.body").alias("body")).where(F.col("body").rlike(r"\S"))


def examples() -> list[tuple[str, str, int]]:
    """(family, body, fold): the fixed training examples; all parts of a template are in one fold."""
    out = [(UNKNOWN, body, k % FOLDS) for k, body in enumerate(OTHERWISE)]
    out += 4 * [(family, body, k % FOLDS) for k, (family, body) in enumerate(NAMES)]
    for k, (family, body) in enumerate(TEMPLATES):
        sentences = [s for s in re.split(r"(?<=[.;:]) ", body) if len(s.split()) > 4 or s == body]
        words = body.split()
        half = len(words) // 2
        parts = {body, *sentences, *((" ".join(words[:half]), " ".join(words[half:])) if len(words) > 16 else ())}
        if len(words) > 16:  # as wrapped lines
            parts |= {" ".join(words[at : at + 10]) for at in range(0, len(words) - 4, 5)}
            parts |= {" ".join(words[at : at + 6]) for at in range(0, len(words) - 4, 3)}
        other = [OTHERWISE[(k + FOLDS * j) % len(OTHERWISE)] for j in range(2)]  # of the template's own fold
        parts |= {f"{other[0]} {body}", f"{body} {other[1]}", f"Copyright 2020 the authors. {body}"}
        out += [(family, part, k % FOLDS) for part in sorted(parts)]
    return out


#: Counted for each paragraph beside its grams, so that a line of one word is not all that word and long prose adds up to nothing.
LENGTH, EVERY = " length", 3


def vocabulary() -> list[str]:
    """The 1- and 2-grams of the fixed texts."""
    texts = [body for _, body in (*TEMPLATES, *NAMES)] + list(OTHERWISE)
    return sorted({g for text in texts for size in (1, 2) for g in _runs(text, size)}) + [LENGTH]


def _features(rows: DataFrame) -> DataFrame:
    """``rows`` (body) with the counts of its known grams and of ``LENGTH``, scaled to length one."""
    from pyspark.ml.feature import CountVectorizerModel, Normalizer

    words = _words(F.col("body"))
    joined = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.concat_ws(" ", F.get("words", k - 1), F.get("words", k)))
    pairs = F.when(F.size("words") > 1, joined).otherwise(F.array().cast("array<string>"))
    length = F.array_repeat(F.lit(LENGTH), F.lit(1) + F.floor(F.size("words") / EVERY).cast("int"))
    grams = rows.withColumn("words", words).withColumn("grams", F.concat("words", pairs, length))
    counted = CountVectorizerModel.from_vocabulary(vocabulary(), "grams", "counted").transform(grams)
    return Normalizer(inputCol="counted", outputCol="features").transform(counted)


class LicenceModel:
    """Families, the classifier over them, and the calibration of "is a licence"."""

    def __init__(self, families: list[str], classifier, slope: float, offset: float, held_out: float | None = None):
        self.families, self.classifier, self.slope, self.offset = families, classifier, slope, offset
        #: The share of held-out examples, of templates that the scaled model did not see, that are told apart.
        self.held_out = held_out

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (body) with ``words``, ``family`` (unknown if unlikely to be a licence) and ``probability``."""
        from pyspark.ml.functions import vector_to_array

        kept = rows.columns
        out = self.classifier.transform(_features(rows)).withColumn("_p", vector_to_array("probability"))
        known = F.slice("_p", 2, len(self.families) - 1)
        best = F.array_max(F.transform(known, lambda p, k: F.struct(p.alias("p"), (-k).alias("k"))))
        out = out.withColumns({"_best": best, "_logit": _logit(1 - F.get("_p", F.lit(0)))})
        sure = 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("_logit") + F.lit(self.offset))))
        names = F.array(*map(F.lit, self.families))
        clear = F.col("_best.p") >= 0.5 * (1 - F.get("_p", F.lit(0)))
        return out.withColumns({
            "probability": sure,
            "family": F.when((sure >= 0.5) & clear, F.get(names, 1 - F.col("_best.k"))).otherwise(UNKNOWN),
        }).select(*kept, "words", "family", "probability")


def _logit(p):
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def train(docs: DataFrame, negatives: int = NEGATIVES) -> LicenceModel:
    """Learn from the fixed examples and at most ``negatives`` distinct paragraphs of ``docs`` (doc_id, text)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark, some = docs.sparkSession, sampled(docs.select("text"), negatives)
    lines = settle(some.select(F.explode(F.split("text", "\n")).alias("body")).where(F.length("body") > 0).distinct().withColumn("words", _words(F.col("body"))))
    known = F.array(*map(F.lit, sorted({g for _, body in TEMPLATES for g in _runs(body)})))
    other = lines.where(~F.arrays_overlap(_grams(F.col("words")), known))
    stems = F.col("body").rlike(STEMS)
    pick = lambda rows, most: rows.orderBy(F.xxhash64("body"), "body").limit(most)
    taken = pick(other.where(~stems), negatives - negatives // 3).unionByName(pick(other.where(stems), negatives // 3))
    taken = taken.select(F.lit(UNKNOWN).alias("family"), "body", F.pmod(F.xxhash64("body"), F.lit(FOLDS)).cast("int").alias("fold"))
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    fixed = literal_table(spark, examples(), "family string, body string, fold int")
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = settle(_features(fixed.unionByName(taken).withColumn("label", number.cast("double")).coalesce(1)))
    learner = LogisticRegression(family="multinomial", regParam=0.0003, elasticNetParam=0.1, maxIter=60)
    part = learner.fit(rows.where("fold > 0"))
    judged = settle(part.transform(rows.where("fold = 0")).select(
        (F.col("label") > 0).cast("double").alias("label"), _logit(1 - vector_to_array("probability")[0]).alias("logit")
    ))
    slope, offset = 1.0, 0.0
    sizes = {r["label"]: r["n"] for r in judged.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) == 2:
        weight = F.when(F.col("label") > 0, F.lit(PRIOR / sizes[1.0])).otherwise(F.lit((1 - PRIOR) / sizes[0.0])) * sum(sizes.values())
        platt = LogisticRegression(regParam=0.001, maxIter=50, weightCol="weight").fit(VectorAssembler(inputCols=["logit"], outputCol="features").transform(judged.withColumn("weight", weight)))
        slope, offset = float(platt.coefficients[0]), float(platt.intercept)
    sure = 1 / (1 + F.exp(-(F.lit(slope) * F.col("logit") + F.lit(offset))))
    right = judged.agg(F.avg(((sure >= 0.5) == (F.col("label") > 0)).cast("double")).alias("right")).first()["right"]
    return LicenceModel(families, learner.fit(rows), slope, offset, right)


def _words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(body: str, size: int = 3) -> set[str]:
    """:func:`_grams` of a fixed text."""
    words = [w for w in re.split(r"[\W_]+", body.lower()) if w]
    return {" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def _grams(words, size: int = 3):
    """The distinct runs of ``size`` words, or the whole sequence if it is shorter."""
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k + 1, size), " ")))


def scan(docs: DataFrame, model: LicenceModel, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, paragraph, start, family, probability, overlap, confirmed) of each paragraph that is or may be a licence."""
    words = _words(F.col("template"))
    known = literal_table(docs.sparkSession, TEMPLATES, "family string, template string")
    # The fixed templates: a constant table.
    known = known.select("family", _grams(words).alias("known")).groupBy("family").agg(F.collect_list("known").alias("known"))
    # Spark moves no filter below a row number; moved, this one would compute the features once for each use.
    scored = model.scored(paragraphs(docs)).withColumn("_row", F.monotonically_increasing_id())
    scored = scored.where((F.col("_row") >= 0) & (F.col("probability") >= DOUBT))
    scored = scored.join(F.broadcast(known), "family", "left").withColumn("own", _grams(F.col("words")))
    shares = F.transform("known", lambda k: F.size(F.array_intersect(k, "own")) / F.least(F.size(k), F.size("own")))
    overlap = F.coalesce(F.array_max(shares), F.lit(0.0))
    return scored.select(
        "doc_id", "paragraph", "start", "family", F.round("probability", 6).alias("probability"),
        F.round(overlap, 6).alias("overlap"), ((F.col("family") != UNKNOWN) & (overlap >= confirm)).alias("confirmed"),
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """The licence paragraphs of every document, by family."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(documents, train(documents))
