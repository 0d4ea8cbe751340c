"""Licence scans by a trained paragraph classifier, in DataFrame functions alone.

Features are word n-grams (1 to 3 words) of licence notices that hold a cue: a word of notices that hardly any paragraph of a
bounded sample of the documents has, not even within another word. A multinomial logistic regression over families and the class "unknown" is fitted on
crops of the notices (``NOTICES``), on ordinary sentences about licences and on the sampled paragraphs but those that are notices
themselves, whole or in lines (``like_notice``): however common a notice is, its words stay cues and it is no example of "unknown". A quarter of the distinct
examples is first held out to calibrate the unknown class, then the model is fitted on all: a family is taken only if its probability is above the cut that lies
between the held-out unknowns' highest and the held-out notices' usual probabilities. A taken family is compared with its
notices: it is confirmed if the shared n-grams are at least ``ALIKE`` of the smaller side.

Scoring goes over every paragraph of every text. A paragraph without a cue has no feature, which the model, by a check
after fitting, leaves unknown; such paragraphs give no rows, and texts without a cue are passed over by plain substring
search. All else happens row by row, without a shuffle; the model (a few hundred n-grams, bounded by the notices) is a
constant of the plan. The sample is bounded by ``SAMPLE_DOCS`` documents, chosen by a hash of their id.

Nulls and empty texts have no paragraphs. Repeated rows give their rows each. Ties between families go to the first in
order. Extra columns are ignored; an empty table gives no rows (the model is then fitted on notices and sentences).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_DOCS = 400
GRAMS = 3
CROPS = (5, 9, 14, 400)
REGULARISATION = 1e-5
RARE = 0.005  # largest share of sampled paragraphs that a cue may be found in
ALIKE = 0.5
UNKNOWN = "unknown"

# Usual notices of licence families.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "Licensed under GPL v2 or later."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC-SA 3.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Available under the Creative Commons Attribution License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
)
SENTENCES = (
    "You need a driving licence to hire a car here.", "Her licence expired in March and was renewed in May.", "The general public may visit the garden free of charge.",
    "The Apache helicopter flew over the valley.", "He studied physics at MIT before he moved to Boston.", "Please read the license agreement before you install the software.",
    "A later version of the story was published in the journal.", "The commons were open to every person of the village.", "Permission to enter is granted by the owner.",
    "Fishing without a license is not permitted.", "The foundation gave public money to creative work.", "This version of the file is free of errors.",
    "The software is free for any person who works at the school.", "All rights reserved.", "The licensed surveyor signed the terms of the contract.",
)
FAMILIES = tuple(dict.fromkeys(f for f, _ in NOTICES))


def words(text: Column) -> Column:
    """Lower-case words: letters and digits, inner full stops, plus signs and hyphens kept."""
    return F.filter(F.transform(F.split(F.lower(text), "[^\\p{L}\\p{N}.+-]+"), lambda w: F.regexp_replace(w, "^[.+-]+|[.+-]+$", "")), lambda w: w != "")


def grams(w: Column) -> Column:
    """Distinct runs of one to GRAMS words, joined by spaces."""

    def of(w: Column) -> Column:
        n = F.size(w)

        def runs(k: int) -> Column:
            starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))

        return F.array_distinct(F.concat(*map(runs, range(1, GRAMS + 1))))

    return F.get(F.transform(F.array(w), of), 0)  # so that the words are found once, not once for each run


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("paragraph", "line")).where(F.trim("line") != "")


def like_notice(w: Column, notices: list[list[str]]) -> Column:
    """Whether at least ``ALIKE`` of the runs of GRAMS words of a line, or of one of the notices' n-grams, are shared by the two."""
    table = F.from_json(F.lit(json.dumps([r for g in notices if (r := [x for x in g if x.count(" ") == GRAMS - 1])])), "array<array<string>>")

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= GRAMS, F.sequence(F.lit(0), F.size(w) - GRAMS)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(GRAMS)))))

    def alike(own: Column) -> Column:
        return F.exists(table, lambda t: (F.size(own) > 0) & (F.size(F.array_intersect(own, t)) >= ALIKE * F.least(F.size(own), F.size(t))))

    return F.exists(F.transform(F.array(w), runs), alike)  # so that the runs are made once, not once for each notice


@dataclass
class LicenceModel:
    families: list[str]  # UNKNOWN first
    bias: list[float]
    weights: dict[str, list[float]]  # by n-gram, one per family
    cues: list[str]
    cut: float


def examples(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family, w) of crops of notices and of sentences; (family, w) of the sampled paragraphs."""
    spark: SparkSession = docs.sparkSession
    fixed = spark.createDataFrame([*NOTICES, *((UNKNOWN, s) for s in SENTENCES)], "family string, line string")
    sizes = F.explode(F.array(*map(F.lit, CROPS))).alias("size")
    crops = fixed.select("family", words(F.col("line")).alias("w"), sizes)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.col("size") + 1))
    crops = crops.select("family", "w", "size", F.explode(starts).alias("i")).select("family", F.slice("w", F.col("i"), F.col("size")).alias("w")).distinct()
    # About twice as many as asked for pass by their hash, so that tasks don't send texts that the limit drops.
    share = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count()))) < 2 * SAMPLE_DOCS
    chosen = docs.where(F.col("doc_id").isNotNull() & share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    plain = paragraphs(chosen).where(~F.col("line").rlike("(?i)licen[cs]|copyright|spdx"))
    plain = plain.select(F.lit(UNKNOWN).alias("family"), words(F.col("line")).alias("w"))
    return crops, plain.where(~like_notice(F.col("w"), [g for of in notice_grams(spark).values() for g in of]))


def trained(docs: DataFrame) -> LicenceModel:
    """Model fitted on notices, sentences and the bounded sample of ``docs`` (doc_id, text)."""
    crops, plain = examples(docs)
    plain = plain.limit(20 * SAMPLE_DOCS)
    asked = crops.where(F.col("family") != UNKNOWN).select(F.explode("w").alias("word")).where(F.col("word").rlike("^[a-z][a-z-]{2,}")).distinct()
    asked = sorted(r.word for r in asked.collect())  # at most the words of the notices
    line = F.array_join("w", " ")
    share = plain.agg(*(F.avg(line.contains(w).cast("int")) for w in asked)).first()
    cues = [w for w, x in zip(asked, share, strict=True) if (x or 0.0) <= RARE]
    has_cue = lambda g: F.exists(F.split(g, " "), lambda w: w.isin(cues))
    both = crops.union(plain).select("family", F.array_sort(F.filter(grams(F.col("w")), has_cue)).alias("grams"))
    # Equal examples count as one with their number as weight, and each class weighs the same.
    both = both.where((F.col("family") == UNKNOWN) | (F.size("grams") > 0)).groupBy("family", "grams").count()
    both = both.withColumn("held", F.pmod(F.xxhash64("grams", "family"), F.lit(4)) == 0).coalesce(1).cache()
    vocabulary = sorted(r.g for r in both.where(F.col("family") != UNKNOWN).select(F.explode("grams").alias("g")).distinct().collect())
    tried = fitted(both.where(~F.col("held") | (F.size("grams") == 0)), vocabulary, cues)
    # Calibration: between what held-out unknowns reach at most and what 95 of 100 held-out notices reach at least.
    found = both.where("held").select("family", probabilities(F.col("grams"), tried).alias("p"))
    top = F.array_max(F.slice("p", 2, len(tried.families)))
    row = found.agg(F.max(F.when(F.col("family") == UNKNOWN, top)).alias("low"), F.percentile_approx(F.when(F.col("family") != UNKNOWN, top), 0.05).alias("high")).first()
    model = fitted(both, vocabulary, cues)
    model.cut = min(0.95, max(0.5, ((row.low or 0.0) + (row.high or 1.0)) / 2))
    both.unpersist()
    return model


def fitted(rows: DataFrame, vocabulary: list[str], cues: list[str]) -> LicenceModel:
    """Multinomial logistic regression on (family, grams, count), each family with the same weight."""
    families = [UNKNOWN, *FAMILIES]
    number = {r["family"]: r["n"] for r in rows.groupBy("family").agg(F.sum("count").alias("n")).collect()}
    each = F.array(*(F.lit(1.0 / number.get(f, 1)) for f in families))
    place = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    weighted = rows.select("grams", (place - 1).cast("double").alias("label"), (F.col("count") * F.element_at(each, place.cast("int"))).alias("weight"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True).transform(weighted)
    fit = LogisticRegression(family="multinomial", regParam=REGULARISATION, maxIter=100, standardization=False, weightCol="weight").fit(vectors)
    matrix = fit.coefficientMatrix.toArray()
    missing = len(families) - len(matrix)
    bias = [float(x) for x in fit.interceptVector] + [-50.0] * missing
    weights = {g: [*(round(float(x), 6) for x in matrix[:, i]), *[0.0] * missing] for i, g in enumerate(vocabulary)}
    if max(bias) > bias[0]:
        raise ValueError("without features a paragraph must be unknown")
    return LicenceModel(families, bias, weights, cues, 0.5)


def probabilities(g: Column, model: LicenceModel) -> Column:
    """Probability of each family for an array of n-grams."""
    names = F.split(F.lit("\n".join(model.weights)), "\n")
    flat = F.lit(np.array([x for row in model.weights.values() for x in row]))
    width = len(model.bias)
    bias = F.array(*map(F.lit, model.bias))
    # Places of the known n-grams; a place that isn't there is 0.
    places = F.filter(F.transform(g, lambda x: F.array_position(names, x)), lambda i: i > 0)
    columns = F.sequence(F.lit(0), F.lit(width - 1))
    logits = F.aggregate(places, bias, lambda acc, i: F.zip_with(acc, columns, lambda a, j: a + F.get(flat, (i - 1) * width + j)))
    powers = F.transform(logits, lambda x: F.exp(x))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def notice_grams(spark: SparkSession) -> dict[str, list[list[str]]]:
    rows = spark.createDataFrame(list(NOTICES), "family string, line string").select("family", grams(words(F.col("line"))).alias("g")).collect()
    out: dict[str, list[list[str]]] = {f: [] for f in FAMILIES}
    for r in rows:
        out[r.family].append(r.g)
    return out


def with_cue(text: Column, cues: list[str]) -> Column:
    """Whether any cue is a substring; cues that contain another one needn't be looked for."""
    least = [c for c in cues if not any(o != c and o in c for o in cues)]

    def any_of(low: Column) -> Column:
        found = F.lit(False)
        for c in least:
            found = found | low.contains(c)
        return found

    return F.exists(F.array(F.lower(text)), any_of)  # so that the text is lower-cased once, not once for each cue


def scanned(docs: DataFrame, model: LicenceModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, paragraph, family, probability, similarity, confirmed) of all paragraphs that have a feature."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(with_cue(F.col("text"), model.cues))
    known = F.split(F.lit("\n".join(model.weights)), "\n")
    lines = paragraphs(rows).where(with_cue(F.col("line"), model.cues)).withColumn("grams", grams(words(F.col("line"))))
    lines = lines.withColumn("features", F.array_intersect("grams", known)).where(F.size("features") > 0)
    names = F.array(*map(F.lit, model.families))
    lines = lines.withColumn("p", probabilities(F.col("features"), model))
    best = F.slice("p", 2, len(model.families))
    lines = lines.withColumn("probability", F.array_max(best)).withColumn(
        "family", F.when(F.col("probability") >= model.cut, F.element_at(names, F.array_position(best, F.col("probability")).cast("int") + 1)).otherwise(UNKNOWN))
    table = F.from_json(F.lit(json.dumps(notice_grams(docs.sparkSession))), "map<string,array<array<string>>>")
    shared = F.transform(F.coalesce(F.try_element_at(table, "family"), F.array().cast("array<array<string>>")),
                         lambda t: F.size(F.array_intersect("grams", t)) / F.least(F.size("grams"), F.size(t)))
    lines = lines.withColumn("similarity", F.coalesce(F.array_max(shared), F.lit(0.0)))
    return lines.select("doc_id", F.col("paragraph").cast("long"), "family", "probability", "similarity",
                        ((F.col("family") != UNKNOWN) & (F.col("similarity") >= ALIKE)).alias("confirmed"))
