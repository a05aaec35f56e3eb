"""Licence scan by a trained paragraph classifier, confirmed by templates.

Native: DataFrame functions and ``pyspark.ml``, which runs on the JVM; no Python
runs on the executors.

A paragraph is a line with a word in it.  Its features are hashed word unigrams
and bigrams (lower-cased, sparse, binary); a multinomial logistic regression over
them tells the licence families and ``unknown`` apart.  It is trained here on the
notices below (each whole, as runs of its words, and inside other words) against
a sample of at most ``MAX_TRAINING_PARAGRAPHS`` paragraphs, from about
``MAX_TRAINING_DOCUMENTS`` documents chosen by hash, that share no trigram with a
notice.  ``unknown`` is calibrated: on the
other half of the sample the highest family probability met sets the probability
that a prediction must exceed.  A prediction counts when a template confirms it:
the share of the family's best notice's trigrams that the paragraph holds.

Defined results: null or empty texts have no paragraphs and no licence; an empty
table gives no rows; repeated rows each get their row; extra columns are ignored;
paragraphs of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import let, written

# Short notices of licence families.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "bsd-3-clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *NOTICES)
FEATURES = 1 << 14
MAX_TRAINING_PARAGRAPHS = 2000
MAX_TRAINING_DOCUMENTS = 2000
MIN_CONFIRMED = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}.\-]+|\.(?=\s|$)"), "")


def _grams(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])))


def terms_of(words: Column) -> Column:
    return F.concat(words, _grams(words, 2))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, words``: one row per paragraph."""
    lines = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    return lines.select("id", words_of(F.col("line")).alias("words")).where(F.size("words") > 0)


def _notice_rows(spark) -> DataFrame:
    flat = [(float(i), n) for i, f in enumerate(FAMILIES) if f != UNKNOWN for n in NOTICES[f]]
    return spark.createDataFrame(flat, "label double, notice string").withColumn("words", words_of(F.col("notice")))


def train(docs: DataFrame, text_col: str = "text", max_paragraphs: int = MAX_TRAINING_PARAGRAPHS) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the probability a family has to exceed."""
    spark = docs.sparkSession
    notices = _notice_rows(spark)
    known = notices.select(F.explode(_grams(F.col("words"), 3)).alias("gram")).distinct()
    grams = [r.gram for r in known.collect()]  # of the notices above: a fixed, small set
    # about MAX_TRAINING_DOCUMENTS texts by hash, so that the order below sorts their lines only
    share = min(1.0, MAX_TRAINING_DOCUMENTS / max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    # distinct, so that copies of one drawn text send one of each line a partition
    sample = drawn.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).where(F.length("line").between(1, 2000)).distinct()
    sample = sample.orderBy(F.xxhash64("line"), "line").limit(max_paragraphs).select(words_of(F.col("line")).alias("words"))
    sample = sample.where((F.size("words") > 0) & ~F.arrays_overlap(_grams(F.col("words"), 3), F.array(*[F.lit(g) for g in grams]))).withColumn("half", F.pmod(F.xxhash64("words"), F.lit(2)))
    sample = written(sample)
    # a notice whole, its longer halves, and set between other words
    n = F.size("words")
    half = F.greatest(F.lit(4), n - F.floor(n / 3).cast("int"))
    other = F.array(*[F.lit(w) for w in ("lorem", "ipsum", "dolor")])
    shapes = F.array(F.col("words"), F.slice("words", 1, half), F.slice("words", F.greatest(F.lit(1), n - half + 1), half), F.concat(other, F.col("words"), other))
    good = notices.select("label", F.explode(shapes).alias("words"))
    # the words of notices out of their order are no notice
    bad = notices.select(F.lit(0.0).alias("label"), F.explode(F.array(F.sort_array("words"), F.reverse("words"), F.slice("words", 1, 2))).alias("words"))
    rows = good.unionByName(bad).unionByName(sample.where("half = 0").select(F.lit(0.0).alias("label"), "words"))
    tf = _features()
    fitted = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", regParam=1e-4, maxIter=40).fit(tf.transform(rows.withColumn("terms", terms_of(F.col("words")))).select("label", "features").coalesce(1))
    held = fitted.transform(tf.transform(sample.where("half = 1").withColumn("terms", terms_of(F.col("words")))))
    worst = held.agg(F.max(F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1)))).first()[0]
    return fitted, min(max(0.5, worst or 0.0), 0.9)


def _features() -> HashingTF:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")


def confirmed(words: Column, family: Column) -> Column:
    """The largest share of one of the family's notices' trigrams in the paragraph."""
    grams = _grams(words, 3)
    out = F.lit(0.0)
    for f, notices in NOTICES.items():
        shares = []
        for n in notices:
            w = _plain(n)
            own = sorted({" ".join(w[i : i + 3]) for i in range(len(w) - 2)})
            shares.append(F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in own]))) / float(len(own)))
        out = F.when(family == f, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(out)
    return out


def _plain(notice: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^a-z0-9.\-]+|\.(?=\s|$)", notice.lower()) if w]


def anchors() -> list[str]:
    """Words of which every trigram of every notice holds at least one: the
    longest of each trigram.  A paragraph without any shares no trigram with a
    notice, so no template can confirm it and its score can't matter."""
    out = set()
    for n in (n for notices in NOTICES.values() for n in notices):
        w = _plain(n)
        for i in range(len(w) - 2):
            if not out & {*w[i : i + 3]}:
                out.add(max(w[i : i + 3], key=lambda x: (len(x), x)))
    return sorted(out)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None, min_confirmed: float = MIN_CONFIRMED) -> DataFrame:
    """One row per licence paragraph: ``id_col``, family, probability, confirmed."""
    fitted, least = model or train(docs, text_col)
    could = F.arrays_overlap("words", F.array(*[F.lit(a) for a in anchors()])) if min_confirmed > 0 else F.lit(True)
    rows = paragraphs(docs, id_col, text_col).where(could).withColumn("terms", terms_of(F.col("words")))
    scored = fitted.transform(_features().transform(rows).select("id", "words", "features"))
    p = vector_to_array("probability")
    named = scored.where("prediction > 0").select(
        "id", "words", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("prediction").cast("int") + 1).alias("family"), F.array_max(p).alias("probability")
    )
    found = named.where(F.col("probability") > least).withColumn("confirmed", confirmed(F.col("words"), F.col("family")))
    return found.where(F.col("confirmed") >= min_confirmed).select(F.col("id").alias(id_col), "family", "probability", "confirmed")


def document_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """One row per document with a licence: ``id_col``, families (sorted,
    comma-joined) and n_paragraphs."""
    found = find_licenses(docs, id_col, text_col, model)
    return found.groupBy(id_col).agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.count(F.lit(1)).alias("n_paragraphs"))
