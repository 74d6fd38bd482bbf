"""License scans by diagonal voting.

Every rolling k-gram of a document's words is hashed and joined to the positions of the same k-gram
in a fixed set of license templates. A hit of word p in the document and word q in a template votes
for the diagonal p - q. Votes are aggregated by diagonal; neighbouring diagonals of a template (words
added or missing) are merged; a merged run is verified by the share of the template's k-grams that it
holds. K-grams are equal if two 64-bit hashes with different seeds are; a row carries no more of its text than
these, so time is linear in a text's length. A phrase of the base is found where all of its k-grams
lie on one diagonal. Only DataFrame functions run here. Texts are lowered by ``lower``, beyond A-Z too:
that changes no word border, and no word of the base, whose only letters with a further upper case
(i: U+0130, which becomes two characters; k, which no phrase has) can't arise from one.

Defined results: a null or empty text has no words, no labels and score 0; very long texts are
scanned whole; repeated rows are each reported; null doc_ids are reported; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, words_of

K = 3
#: How far apart neighbouring diagonals may lie to be merged, and the share of a template's k-grams that verifies a run.
SLACK, VERIFIED = 3, 0.6

#: The phrases of the base and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Sentences of public license texts and their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]
#: The row that stands for a document itself, so that those without a hit stay.
DOCUMENT = -1


def rolling_grams(words: str) -> Column:
    """Two hashes of every K consecutive words in the array column ``words``; the last K - 1 entries have fewer words."""

    def gram(w: Column, i: Column) -> Column:
        own = [w, *(F.get(F.col(words), i + j) for j in range(1, K))]
        return F.struct(F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(K), *own).alias("g"))

    return F.transform(words, gram)


def template_positions(spark: SparkSession) -> DataFrame:
    """template, label, base, grams (k-grams it has), q, h, g: a fixed, small table."""
    rows = [F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(n < len(BASE)).alias("base"), F.lit(text).alias("text")) for n, (text, label) in enumerate(BASE + TEMPLATES)]
    words = spark.range(1).select(F.inline(F.array(*rows))).withColumn("w", words_of(F.col("text")))
    grams = words.withColumn("grams", F.size("w") - K + 1).select("*", F.posexplode(rolling_grams("w")).alias("q", "x")).filter("q < grams")
    found = grams.select("template", "label", "base", "grams", "q", "x.h", "x.g")
    mark = spark.range(1).select(F.lit(DOCUMENT).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("grams"), F.lit(0).alias("q"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"))
    return found.unionByName(mark)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    key = ["doc_id", "text_key"]
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    mark = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g")))  # the place after the last word, for the document's own row
    grams = words.select(*key, F.posexplode(F.concat(rolling_grams("w"), mark)).alias("p", "x")).select(*key, "p", "x.h", "x.g")
    # The template table has a fixed number of rows.
    hits = grams.join(F.broadcast(template_positions(docs.sparkSession)), ["h", "g"])
    hits = hits.select(*key, "template", "label", "base", "grams", "q", "p").repartition(*key)

    diagonals = hits.withColumn("diagonal", F.col("p") - F.col("q")).groupBy(*key, "template", "label", "base", "grams", "diagonal")
    diagonals = diagonals.agg(F.collect_set("q").alias("votes"), F.min("p").alias("begin"), F.max("p").alias("end"), F.count(F.lit(1)).alias("rows"))
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= F.when(F.col("base"), 0).otherwise(SLACK), 0).otherwise(1)
    runs = diagonals.withColumn("new", new).withColumn("run", F.sum("new").over(along)).groupBy(*key, "template", "label", "base", "grams", "run")
    runs = runs.agg(F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"), F.min("diagonal").alias("diagonal"), F.min("begin").alias("begin"), (F.max("end") + K).alias("end"), F.sum("rows").alias("rows"))

    is_document = F.col("template") == DOCUMENT
    share = F.col("votes") / F.col("grams")
    is_base = F.col("base") & (F.col("votes") == F.col("grams"))
    is_found = ~is_document & F.when(F.col("base"), is_base).otherwise((share >= VERIFIED) & (F.col("end") - F.col("begin") <= 2 * (F.col("grams") + K)))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = runs.groupBy(*key).agg(
        F.max(F.when(is_document, F.col("diagonal"))).cast("long").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined(F.when(is_found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(is_found, share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(is_found, F.struct("begin", "end", "label", share.alias("share"))))).alias("spans"),
        F.max(F.when(is_document, F.col("rows"))).cast("int").alias("rows"),
    )
    return found.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("_row", "rows", "text_key")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
