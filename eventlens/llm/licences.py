"""Licence families of paragraphs: a trained n-gram classifier confirmed by templates.

A multinomial logistic regression with sparse weights over word pairs and words is fitted to
notices of known families and to paragraphs of the corpus that match none, the unknown class.
A second fit on held-out rows turns its log odds into the probability that a named family is
right. A prediction stands if that is at least one half and most word triples of one of the
family's templates occur in the paragraph. DataFrame functions and MLlib only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, NGram, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm import storage

#: Customary notices and opening words of each licence family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "creative-commons": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "mozilla": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright holder. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
#: The share of a template's word triples that must occur; the least calibrated probability.
COVERED, SURE = 0.7, 0.5


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: w != "")


def triples(ws: Column) -> Column:
    """Distinct word triples; a shorter text is one of its own."""
    n = F.size(ws)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.array_join(F.slice(ws, i, 3), " "))
    return F.array_distinct(each)


def template_rows(spark) -> DataFrame:
    rows = [(FAMILIES.index(f), t) for f, ts in TEMPLATES.items() for t in ts]
    return spark.createDataFrame(rows, "family int, text string").withColumn("words", words("text"))


def covered(spark, ws: str) -> Column:
    """For each family, the largest share of one of its templates' triples found in ``ws``."""
    listed = template_rows(spark).select("family", triples(F.col("words")).alias("t")).collect()  # a few constants
    own = triples(F.col(ws))
    out = []
    for family in range(1, len(FAMILIES)):
        shares = [
            F.size(F.array_intersect(own, F.array(*map(F.lit, r["t"])))) / F.lit(float(len(r["t"])))
            for r in listed if r["family"] == family
        ]
        out.append(F.greatest(*shares) if len(shares) > 1 else shares[0])
    return F.array(F.lit(0.0), *out)


def template_words() -> list[list[str]]:
    return [re.findall("[a-z0-9]+", t.lower()) for ts in TEMPLATES.values() for t in ts]


def template_triples() -> list[str]:
    return sorted({" ".join(ws[i : i + 3]) for ws in template_words() for i in range(max(1, len(ws) - 2))})


def telling() -> str:
    """Expression of words of which each text has one that holds enough triples of a template."""
    chosen = set()
    for ws in template_words():
        own, held = {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}, set()
        for w in sorted(set(ws), key=lambda w: (-len(w), w)):
            if len(held) > (1 - COVERED) * len(own):
                break
            chosen.add(w)
            held |= {t for t in own if w in t}
    return "(?i)(?<![a-z0-9])(?:" + "|".join(sorted(chosen)) + ")"


def joined(text: str, lines: str) -> Column:
    """``a, b, text`` of each stretch of two and more neighbouring lines, first and last one's
    number, in which a wrapped notice could stand: none crosses a line without words, and behind
    the first line there are no more words than the longest template has."""
    most = max(map(len, template_words()))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"(?i)^\s*(?:rem|dnl)\s", ""))

    def from_line(ls: Column, i: Column) -> Column:
        behind = F.aggregate(
            F.slice(ls, i + 1, F.lit(most)), F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda acc, x: F.when(
                acc.on & (acc.n < most) & x.rlike("[A-Za-z0-9]"),
                F.struct((acc.k + 1).alias("k"), (acc.n + F.size(F.split(x, "[^A-Za-z0-9]+"))).alias("n"), F.lit(True).alias("on")),
            ).otherwise(F.struct(acc.k.alias("k"), acc.n.alias("n"), F.lit(False).alias("on"))),
            lambda acc: acc.k,
        )
        return F.flatten(F.transform(F.array(F.slice(ls, i, F.lit(1) + behind)), lambda own: F.when(
            (F.size(own) > 1) & F.array_join(own, " ").rlike(telling()),
            F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(own))), lambda k: F.struct(
                i.alias("a"), (i + k - 1).alias("b"), F.array_join(F.slice(own, F.lit(1), k), " ").alias("text")
            )),
        ).otherwise(F.expr("cast(array() as array<struct<a:int,b:int,text:string>>)"))))

    found = F.flatten(F.flatten(F.transform(F.array(bare), lambda ls: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ls) - 1)), lambda i: from_line(ls, i)
    ))))
    worth = (F.size(lines) > 1) & F.col(text).rlike(telling())
    return F.when(worth, F.filter(found, lambda x: x.text.rlike(telling()))).otherwise(
        F.expr("cast(array() as array<struct<a:int,b:int,text:string>>)")
    )


def apart(hits: str) -> Column:
    """The most hits ``b, -a, p``, in this order, of which no two share a line: their ``p``."""
    return F.expr(
        f"aggregate({hits}, named_struct('at', 0, 'out', cast(array() as array<double>)), (acc, x) -> "
        "if(-x.a > acc.at, named_struct('at', x.b, 'out', concat(acc.out, array(x.p))), acc), acc -> acc.out)"
    )


@dataclass
class Model:
    features: PipelineModel
    classes: LogisticRegressionModel
    sure: LogisticRegressionModel

    def judged(self, paragraphs: DataFrame) -> DataFrame:
        """Adds ``family`` (its number) and ``p``, the calibrated probability that it is right."""
        return self.sure.transform(odds(self.classes.transform(self.features.transform(paragraphs)))).withColumn(
            "p", vector_to_array("sure")[1]
        )


def odds(scored: DataFrame) -> DataFrame:
    """The likeliest named family and its log odds against the unknown class, as a vector."""
    p = vector_to_array("probability")
    named = F.slice(p, 2, len(FAMILIES) - 1)
    best = F.array_max(named)
    scored = scored.withColumn("family", F.array_position(named, best).cast("int")).withColumn(
        "odds", F.log(best + 1e-9) - F.log(p[0] + 1e-9)
    )
    return VectorAssembler(inputCols=["odds"], outputCol="odds_vector").transform(scored)


def trained(paragraphs: DataFrame, sample_rows: int = 4000, vocabulary: int = 4096) -> Model:
    """Fits to the templates, cut at both ends in many ways, and to at most ``sample_rows``
    paragraphs (those with the smallest hash) that hold no template."""
    spark = paragraphs.sparkSession
    sample = paragraphs.select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(sample_rows)
    sample = sample.withColumn("words", words("text")).where(F.size("words") > 0)
    # Lines of wrapped notices are not plain text.
    own = triples(F.col("words"))
    notice = F.size(F.array_intersect(own, F.array(*map(F.lit, template_triples())))) >= 0.5 * F.size(own)
    sample = sample.where(~notice & (F.array_max(covered(spark, "words")) < COVERED)).select(F.lit(0).alias("family"), "words")
    cut = template_rows(spark).withColumn("n", F.size("words"))
    cut = (
        cut.withColumn("a", F.explode(F.sequence(F.lit(0), F.least(F.lit(6), F.col("n") / 4).cast("int"))))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.least(F.lit(6), F.col("n") / 4).cast("int"))))
        .select("family", F.expr("slice(words, a + 1, n - a - b)").alias("words"))
    )
    # A notice among other words is still that notice.
    fillers = sample.select(F.slice("words", 1, 8).alias("f")).orderBy(F.xxhash64("f"), "f").limit(20)
    fillers = fillers.agg(F.collect_list("f").alias("fs")).scalar()
    among = template_rows(spark).withColumn("f", F.explode(fillers)).select("family", F.concat("f", "words").alias("words"))
    rows, at = storage.written(sample.union(cut).union(among).coalesce(4), "licences")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("words"), F.lit(4)) == 0)
    fit = rows.where("not held")
    counts = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=vocabulary, binary=True)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    both = SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")
    counted = counts.fit(both.transform(pairs.transform(fit)))
    features = PipelineModel([pairs, both, counted])
    classes = LogisticRegression(
        labelCol="family", maxIter=40, regParam=0.002, elasticNetParam=0.5, family="multinomial"
    ).fit(features.transform(fit))
    held = odds(classes.transform(features.transform(rows.where("held"))).withColumnRenamed("family", "truth"))
    held = held.withColumn("right", (F.col("family") == F.col("truth")).cast("int")).select("odds_vector", "right")
    # One row of each kind, far out, so that the fit exists whatever was held out.
    sure = LogisticRegression(
        featuresCol="odds_vector", labelCol="right", maxIter=30, regParam=0.01, probabilityCol="sure",
        rawPredictionCol="sure_raw", predictionCol="sure_class",
    ).fit(held.union(VectorAssembler(inputCols=["odds"], outputCol="odds_vector").transform(
        spark.sql("SELECT double(x) AS odds, y AS right FROM VALUES (20, 1), (-20, 0) AS t(x, y)")
    ).select("odds_vector", "right")))
    storage.drop(spark, at)
    return Model(features, classes, sure)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> DataFrame:
    """``id, n_paragraphs, n_notices, families, best``: licence notices of each text.

    Paragraphs are what line ends part, blank ones left out. A notice stands in one of them or,
    wrapped, in neighbouring ones with no blank line between; notices of a family that are
    counted share no line. ``families`` are the confirmed families in their order, ``best`` the
    largest calibrated probability among them (null without any). Null, empty and wordless texts
    have no notices. Every row gives one row; rows of one id show the notices of all of them, and
    a null id shows none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    rows = rows.withColumn("lines", F.split("whole", "\r\n|[\r\n]"))
    listed = rows.select("id", F.filter("lines", lambda p: F.trim(p) != "").alias("parts"))
    model = trained(listed.select(F.explode("parts").alias("text")), sample_rows)
    # A line without a telling word holds too few triples of any template: it isn't judged.
    single = F.when(F.lower("whole").rlike(telling()), F.filter(
        F.transform("lines", lambda x, i: F.struct((i + 1).alias("a"), (i + 1).alias("b"), x.alias("text"))),
        lambda x: F.lower(x.text).rlike(telling()),
    )).otherwise(F.expr("cast(array() as array<struct<a:int,b:int,text:string>>)"))
    stretches = rows.where("id is not null").withColumn("row", F.monotonically_increasing_id()).select(
        "id", "row", F.explode(F.concat(single, joined("whole", "lines"))).alias("s")
    ).select("id", "row", "s.*")
    shared = F.get(covered(spark, "words"), F.col("family"))
    hits = (
        model.judged(stretches.withColumn("words", words("text"))).where(F.col("p") >= SURE)
        .where(shared >= COVERED).select("id", "row", "family", "a", "b", "p")
    )
    counted = (
        hits.groupBy("id", "row", "family", "a").agg(F.min(F.struct("b", "p")).alias("h"))
        .groupBy("id", "row", "family")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("h.b").alias("b"), (-F.col("a")).alias("a"), F.col("h.p").alias("p")))).alias("hits"))
        .withColumn("ps", apart("hits"))
    )
    found = counted.groupBy("id").agg(
        F.sum(F.size("ps")).alias("n"), F.array_sort(F.collect_set("family")).alias("f"), F.max(F.array_max("ps")).alias("best")
    )
    names = F.array(*map(F.lit, FAMILIES))
    return listed.select("id", F.size("parts").cast("long").alias("n_paragraphs")).join(found, "id", "left").select(
        F.col("id").alias(id_col), "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"),
        F.array_join(F.transform(F.coalesce("f", F.array().cast("array<int>")), lambda i: F.get(names, i)), ",").alias("families"),
        "best",
    )
