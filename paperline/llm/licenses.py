"""Licence scans: a trained paragraph classifier with an unknown class, confirmed against templates.

Word n-grams of each paragraph (a line of the text) are scored by a multinomial logistic regression with a lasso penalty, fitted
to notices and passages of the licence templates and to counterexamples that only sound like licences. The few n-grams with a
weight, and the word triples of the templates, become a small table, so scoring is a join. Two numbers are calibrated on rows kept
out of the fit: the temperature of the probabilities (least log loss), and the probability from which a family is believed (so
that few of all unknown rows pass, and at least 0.5); below it a paragraph is of the unknown class. A believed family must then
share word triples with its template.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, row_key

UNKNOWN = "unknown"
# Public names and passages of licences.
NAMES = {
    "mit": ["MIT License", "MIT licence", "Expat License"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL-3.0"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPL-3.0"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPL-3.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "bsd-3-clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "isc": ["ISC License", "ISC licence"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0-1.0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
PASSAGES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-2.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "gpl-3.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "lgpl-3.0": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "agpl-3.0": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "bsd-2-clause": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"],
    "bsd-3-clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
NOTICES = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "This project is available under the {}.", "SPDX-License-Identifier: {}", "The code is covered by the {}."]
#: Sentences that sound alike and name no licence.
SOUNDALIKES = [
    "The driver had no licence with him.", "She is a licensed engineer in this state.", "All rights reserved.", "Copyright by the author, no copying without permission.",
    "A licence fee is due each year.", "The software is sold under a commercial agreement.", "Permission was granted by the council for the work.", "See the terms of use of this site.",
    "The general public may visit the foundation.", "This version is free of charge for a month.", "Conditions of sale are listed in the following table.", "Their contributors wrote the documentation.",
    "The mayor granted a fishing licence to the public.", "The source of the river is in the mountains.", "A common creative work needs attribution.", "Apache helicopters flew over the village.", "Version 3 of the film was released.", "Read the license before you use the product.",
]
FILLER = "the of and to in that was for with his on at by from they were been have which their more about some could other into than these only new time very year most over such our after also made many before must through back years where much your way well down should because each just those people how too little state good make world still own see men work long get here between both life being under never day same another know while last might us great old off come since against go came right used take three".split()

#: An n-gram of common words and numbers only is no feature.
COMMON = {*FILLER, "this", "is", "under", "a", "any", "or", "it", "are", "as", "not", "be"}


def words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def ngrams(w: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct n-grams of an array of words, words joined by a space."""
    at = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[at(n) for n in sizes]))


def templates() -> dict[str, list[str]]:
    return {f: [*(n.format(name) for name in NAMES[f] for n in NOTICES), *PASSAGES.get(f, [])] for f in NAMES}


def examples(seed: int = 3, copies: int = 8) -> list[tuple[str, str]]:
    """(paragraph, family) made by rule: whole notices, parts of passages, both amid other words; and counterexamples."""
    rng = random.Random(seed)
    fill = lambda most: " ".join(rng.choice(FILLER) for _ in range(rng.randint(0, most)))
    made = []
    for family, texts in templates().items():
        for text in texts:
            for k in range(copies):
                part = text.split()
                if len(part) > 14 and k % 2:
                    start = rng.randint(0, len(part) - 14)
                    part = part[start : start + rng.randint(10, 14)]
                made.append((" ".join([fill(8 * (k % 3)), *part, fill(8 * (k % 3))]), family))
    for text in SOUNDALIKES:
        made += [(f"{fill(10)} {text} {fill(10)}", UNKNOWN) for _ in range(copies * 4)]
    made += [(fill(40), UNKNOWN) for _ in range(copies * 100)]
    return made


@dataclass(frozen=True)
class Scanner:
    """Families in the order of the weights, intercepts, n-grams with weights, the believed probability and the temperature."""

    families: list[str]
    intercepts: list[float]
    weights: dict[str, list[float]]
    believed: float = 0.5
    temperature: float = 1.0

    def anchors(self) -> list[str]:
        """For each n-gram its longest word that is not common: a paragraph without any of them has no weighted n-gram."""
        return sorted({max((w for w in g.split() if w not in COMMON), key=lambda w: (not w.isdigit(), len(w), w)) for g in self.weights})


#: Temperatures among which calibration chooses.
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.4, 1.7, 2.0, 2.8, 4.0]


def train(spark: SparkSession, labelled: DataFrame | None = None, vocabulary: int = 4096, penalty: float = 0.0003, false_rate: float = 0.002) -> Scanner:
    """A scanner from labelled paragraphs (text, family); by default those of ``examples``. One row in five calibrates.

    ``false_rate`` is the share of unknown rows that may be taken for a licence.
    """
    if labelled is None:
        labelled = spark.createDataFrame(examples(), "text string, family string")
    rows = labelled.select("family", F.filter(ngrams(words("text")), lambda g: F.exists(F.split(g, " "), lambda w: ~w.isin(*sorted(COMMON)) & ~w.rlike("^[0-9]+$"))).alias("grams"), (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("out"))
    families = [UNKNOWN, *sorted(r[0] for r in labelled.where(F.col("family") != UNKNOWN).select("family").distinct().collect())]
    rows = rows.withColumn("label", F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1)
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, minDF=4, binary=True).fit(rows.where("not out"))
    fit = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=80).fit(counter.transform(rows.where("not out")))
    by_gram = zip(counter.vocabulary, fit.coefficientMatrix.toArray().T.tolist(), strict=True)
    weights = {g: w for g, w in by_gram if any(w)}
    return calibrated(Scanner(families, [float(x) for x in fit.interceptVector], weights), rows.where("out"), false_rate)


def calibrated(scanner: Scanner, kept_out: DataFrame, false_rate: float) -> Scanner:
    """The scanner with temperature and believed probability from rows (family, label, grams) that it was not fitted to."""
    at = logits(kept_out.select(F.monotonically_increasing_id().alias("id"), "label", "grams"), scanner, ["id", "label"])
    loss = lambda t: F.log(F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp((z - F.array_max("z")) / t))) - (F.get("z", F.col("label").cast("int")) - F.array_max("z")) / t
    losses = at.agg(*[F.avg(loss(t)) for t in TEMPERATURES]).first()
    found = [(x, t) for x, t in zip(losses, TEMPERATURES, strict=True) if x is not None]
    warm = replace(scanner, temperature=min(found)[1] if found else 1.0)
    # What each unknown row asks for to be taken for a licence: nothing if its likeliest class is the unknown one.
    asked = rated(at, warm, ["id", "label"]).where("label = 0").select(F.when(F.col("best") == UNKNOWN, 0.0).otherwise(F.col("probability")).alias("p"))
    least = asked.agg(F.percentile_approx("p", 1 - false_rate, 100000)).first()[0]
    return replace(warm, believed=max(0.5, least or 0.0))


def logits(rows: DataFrame, scanner: Scanner, by: list[str], triples: bool = False) -> DataFrame:
    """``by`` and the scores ``z`` of the families, for rows with an array ``grams`` of distinct n-grams.

    Rows alike in ``by`` are copies of one and count once. With ``triples`` there is also ``shared``, the number of the n-grams
    that are word triples of each family's template.
    """
    spark, k = rows.sparkSession, len(scanner.families)
    known: dict[str, set[int]] = {}
    for family, texts in templates().items() if triples else ():
        for w in map(plain_words, texts):
            for n in range(len(w) - 2):
                if family in scanner.families:
                    known.setdefault(" ".join(w[n : n + 3]), set()).add(scanner.families.index(family))
    # A row for each n-gram with a weight and each triple of a template, at most the vocabulary and the templates: a bounded broadcast
    entries = [(g, scanner.weights.get(g), sorted(known.get(g, ()))) for g in sorted({*scanner.weights, *known})]
    table = spark.createDataFrame(entries or [("", None, [])], "gram string, w array<double>, t array<int>")
    hits = rows.select(*by, F.posexplode_outer("grams").alias("at", "gram")).join(F.broadcast(table), "gram", "left")
    copies = F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0))
    sums = [F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) / copies + F.lit(b) for i, b in enumerate(scanner.intercepts)]
    shared = [F.sum(F.when(F.array_contains("t", i), 1).otherwise(0)) / copies for i in range(k)] if triples else []
    at = hits.groupBy(*by).agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)], *[x.alias(f"t{i}") for i, x in enumerate(shared)])
    arrays = [F.array(*[f"s{i}" for i in range(k)]).alias("z")] + ([F.array(*[f"t{i}" for i in range(k)]).alias("shared")] if triples else [])
    return at.select(*by, *arrays)


def rated(at: DataFrame, scanner: Scanner, by: list[str]) -> DataFrame:
    """``by`` with the likeliest family (``best``), its ``place`` and its ``probability``, from scores ``z``."""
    likely = F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda t, z: t + F.exp((z - F.array_max("z")) / scanner.temperature))
    at = at.select(*by, F.array_position("z", F.array_max("z")).cast("int").alias("place"), F.round(likely, 6).alias("probability"))
    return at.withColumn("best", F.element_at(F.array(*map(F.lit, scanner.families)), F.col("place")))


def score(rows: DataFrame, scanner: Scanner, by: list[str]) -> DataFrame:
    """``by`` with the likeliest family (``best``) and its ``probability``, for rows with an array ``grams``; copies count once."""
    return rated(logits(rows, scanner, by), scanner, by).select(*by, "best", "probability")


def paragraphs(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """Row key, ``line`` (from 0), ``family``, ``probability``, ``matched`` and ``confirmed`` of each believed paragraph.

    A paragraph without an anchor word cannot score otherwise than an empty one, which is of the unknown class; so only those
    with one go on to the n-grams. Confirmed: three word triples of the template, or all that a short paragraph has. Rows alike
    in doc_id and text are one.
    """
    lines = docs.select(*row_key(), F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    anchored = lines.select(*KEY, "line", words("paragraph").alias("words")).where(F.arrays_overlap("words", F.array(*map(F.lit, scanner.anchors()))))
    by = [*KEY, "line", "own"]
    at = anchored.select(*KEY, "line", F.size(ngrams(F.col("words"), (3,))).alias("own"), ngrams(F.col("words")).alias("grams"))
    at = logits(at, scanner, by, triples=True)
    found = rated(at, scanner, [*by, "shared"]).where((F.col("best") != UNKNOWN) & (F.col("probability") >= scanner.believed))
    found = found.withColumn("matched", F.round(F.element_at("shared", F.col("place"))).cast("int"))
    enough = (F.col("matched") >= 3) | ((F.col("matched") >= 1) & (F.col("matched") == F.col("own")))
    return found.select(*KEY, "line", F.col("best").alias("family"), "probability", "matched", enough.alias("confirmed"))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, n_paragraphs, n_believed, n_confirmed, ``families`` (confirmed ones, comma-joined, in order) and max_probability.

    A row for each row of ``docs``; null and empty texts have no paragraph, and of very long ones each line is judged by itself.
    Rows alike in doc_id and text get the result of one of them; null doc_ids are like others. Other columns are neither read nor returned. An empty table gives an empty result.
    """
    found = paragraphs(docs, scanner)
    each = found.groupBy(*KEY).agg(
        F.countDistinct("line").alias("n_believed"), F.countDistinct(F.when(F.col("confirmed"), F.col("line"))).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"), F.max("probability").alias("p"),
    )
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    at = docs.select("doc_id", *row_key(), count.alias("n_paragraphs")).join(each, KEY, "left")
    none = F.lit(0).cast("long")
    return at.select("doc_id", "n_paragraphs", F.coalesce("n_believed", none).alias("n_believed"), F.coalesce("n_confirmed", none).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("p", F.lit(0.0)).alias("max_probability"))
