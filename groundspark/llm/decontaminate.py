"""Benchmark decontamination by size-partitioned MinHash containment search.

An item leaks into a document that holds at least THRESHOLD of its distinct word shingles. Items are
partitioned by size; an item's sketch is its smallest shingle hashes (bottom-k MinHash), as many as
the upper size of its partition may miss, plus one: a document that holds enough of the item then
holds a shingle of the sketch, whatever its own length, so the search loses nothing. Documents' whole
shingle sets are searched against the sketches; candidates too short for their item go; the rest is
verified by exact containment of shingles as words. Only DataFrame functions run here.

An item of fewer words than a shingle is one shingle of its own length. Defined results: null or
empty items and texts leak nothing; repeated rows and equal items are each reported once for each
pair of ids; null ids are reported as such; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import broadcast_if_small, table, words_of, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8


def shingles(words: str, k) -> F.Column:
    """The distinct shingles of k words, as strings."""
    n = F.size(words) - k + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, k (words of a shingle), shingles, size class and sketch size of each item that has words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE_WORDS)))
    items = items.withColumn("shingles", shingles("w", F.col("k")))
    upper = F.pow(F.lit(2), F.floor(F.log2(F.size("shingles"))) + 1) - 1
    return items.select("item_id", "k", "shingles", F.size("shingles").alias("n"), (F.floor((1 - THRESHOLD) * upper + 1e-9) + 1).cast("int").alias("sketch"))


def sketches(items: DataFrame) -> DataFrame:
    """k, h, and the smallest n of the items that have h in their sketch: joined once for each shingle of a document."""
    split = F.transform("shingles", lambda s: F.split(s, " "))
    hashes = F.transform(split, lambda w: F.when(F.size(w) == 1, F.xxhash64(F.get(w, 0))).when(F.size(w) == 2, F.xxhash64(F.get(w, 0), F.get(w, 1))).when(F.size(w) == 3, F.xxhash64(*(F.get(w, F.lit(j)) for j in range(3)))).when(F.size(w) == 4, F.xxhash64(*(F.get(w, F.lit(j)) for j in range(4)))).otherwise(F.xxhash64(*(F.get(w, F.lit(j)) for j in range(5)))))
    return items.select("item_id", "k", "n", F.explode(F.slice(F.array_sort(hashes), F.lit(1), F.col("sketch"))).alias("h"))


def grams(k: int) -> F.Column:
    """Of every k words of the array ``w`` in a row: k, their hash, and how many such places the text has."""
    n = F.size("w") - k + 1
    made = F.transform("w", lambda w, i: F.struct(F.lit(k).alias("k"), F.xxhash64(w, *(F.get(F.col("w"), i + j) for j in range(1, k))).alias("h"), n.alias("places")))
    return F.when(n > 0, F.slice(made, F.lit(1), n)).otherwise(F.array().cast("array<struct<k:int,h:bigint,places:int>>"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, shared, n_shingles, containment of every leak."""
    items = written(benchmark_items(benchmark), "benchmark-items")
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # five values at most
    sketch = written(sketches(items), "benchmark-sketches")
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    # All that is read of the words is inside the generator: no row of it carries the text.
    found = words.select("doc_id", "text_key", F.inline(F.concat(*(grams(k) for k in lengths or [SHINGLE_WORDS]))))
    hits = found.join(broadcast_if_small(sketch), ["k", "h"]).filter(F.col("places") >= THRESHOLD * F.col("n") - 1e-9)
    candidates = hits.groupBy("doc_id", "text_key", "item_id").agg(F.lit(1).alias("one")).drop("one")
    candidates = written(candidates, "leak-candidates")
    own = broadcast_if_small(candidates.select(F.col("doc_id").alias("_d"), "text_key", F.col("item_id").alias("_i")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).join(own, "text_key").filter(F.col("doc_id").eqNullSafe(F.col("_d")))
    texts = texts.select("doc_id", "_i", words_of(F.col("text")).alias("w"))
    pairs = texts.join(broadcast_if_small(items), F.col("_i").eqNullSafe(F.col("item_id")))
    pairs = pairs.select("doc_id", "item_id", "n", F.size(F.array_intersect(shingles("w", F.col("k")), "shingles")).alias("shared"))
    pairs = pairs.filter(F.col("shared") >= THRESHOLD * F.col("n") - 1e-9)
    # Equal ids with different texts: the best of them.
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("shared", "n"), F.col("shared") / F.col("n")).alias("best"))
    return pairs.select("doc_id", "item_id", F.col("best.shared").cast("long").alias("shared"), F.col("best.n").cast("long").alias("n_shingles"), (F.col("best.shared") / F.col("best.n")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaks, with all their columns."""
    found = broadcast_if_small(written(leaks(docs, benchmark).select("doc_id").distinct(), "leaking"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
