"""A positional inverted index in tables, searched for many queries at once with pruning by blocks.

Documents that lie together make blocks of at most BLOCK_DOCS. ``postings`` has a row for each
term and block: how many of the block's documents have the term, its largest count in one of them and the
documents with the places of the term. However frequent a term, its rows are bounded by the block.
``terms`` has each term's document count.

A search goes from the rarest term of each alternative on: its blocks, of those the ones that have all
other terms too, each with a bound of its scores. (Of the shortest stretches with all of n words that hold a
given place, each begins with another word, so there are at most n for each place of the word with the least
count, each worth at most 0.1.) Where the best k are asked for, the blocks of highest bounds are scored first,
and the others only as far as their bounds reach the k-th best score so found. In a block, documents are
met by the SEED rarest terms before the places of all terms are taken from the postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import Stems, match_score, parse_web_query
from ..sources.sinks import materialised
from ..sources.tables import broadcast_if_small, numbered, spread

BLOCK_DOCS = 128
#: Places after which a block is full, however few its documents; stems that a task remembers.
BLOCK_PLACES, STEMS_HELD = 1_000_000, 500_000
POSTINGS = "term string, block long, n long, most int, keys array<long>, starts array<int>, places binary"
#: Terms of an alternative by which documents are met.
SEED = 3
#: Blocks of a query that are scored before the bounds of the others are looked at, for each result asked for.
FIRST_BLOCKS = 2
EACH = 0.1
#: Scores are rounded to so many digits, so that equal ones are ties.
DIGITS = 6


def posted(docs: DataFrame, key: str, text: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The postings of ``docs`` (see ``Index.postings``), made where the documents lie, without a shuffle. A block has documents of one partition, at most BLOCK_PLACES places besides those of its last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, block = Stems(), TaskContext.get().partitionId() << 32
        keys: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(k.as_py())
                held.append(stems.numbers(t.as_py()))
                size += len(held[-1])
                if len(keys) == block_docs or size > BLOCK_PLACES:
                    yield of_block(block, keys, held, stems.names)
                    block, keys, held, size = block + 1, [], [], 0
                    if len(stems) > STEMS_HELD:
                        stems = Stems()
        if keys:
            yield of_block(block, keys, held, stems.names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).filter("key IS NOT NULL")
    return spread(rows).mapInArrow(run, POSTINGS)


def of_block(block: int, keys: list[int], held: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """The postings of a block's documents: ``held`` has the numbers in ``names`` of each one's words, -1 for stop words."""
    order = np.argsort(keys, kind="stable")
    own = np.asarray(keys, np.int64)[order]
    held = [held[i] for i in order]
    sizes = [len(h) for h in held]
    stem, doc = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
    place = np.arange(len(stem), dtype=np.int32) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes).astype(np.int32)
    some = np.flatnonzero(stem >= 0)
    some = some[np.argsort(stem[some], kind="stable")]
    stem, doc, place = stem[some], doc[some], place[some]
    new = np.ones(len(stem), bool)
    new[1:] = (stem[1:] != stem[:-1]) | (doc[1:] != doc[:-1])
    pairs = np.flatnonzero(new)  # of term and document
    counts = np.diff(pairs, append=len(stem))
    of = stem[pairs]
    first = np.flatnonzero(np.diff(of, prepend=-1))  # of each term
    of_term = pa.array(np.append(first, len(pairs)), pa.int32())
    n = np.diff(first, append=len(pairs))
    begin = pairs[first]  # of each term's places
    places = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((4 * np.append(begin, len(stem))).astype(np.int32).tobytes()), pa.py_buffer(place.astype("<i4").tobytes())])
    terms = pa.array([names[i] for i in of[first]], pa.string())
    most = np.maximum.reduceat(counts, first) if len(first) else counts
    keys_, starts = pa.ListArray.from_arrays(of_term, pa.array(own[doc[pairs]])), pa.ListArray.from_arrays(of_term, pa.array(pairs - np.repeat(begin, n), pa.int32()))
    return pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(first), block, np.int64)), pa.array(n, pa.int64()), pa.array(most, pa.int32()), keys_, starts, places], ["term", "block", "n", "most", "keys", "starts", "places"])


def build(docs: DataFrame, key: str, text: str, path: str, block_docs: int = BLOCK_DOCS) -> Index:
    """Write the index of ``docs`` (a number as ``key``, ``text``) below ``path``. Keys are distinct; a row without one can't be found. Null and empty texts have no terms."""
    posted(docs, key, text, block_docs).write.parquet(f"{path}/postings")
    found = Index(docs.sparkSession, path)
    found.postings().groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks")).write.parquet(f"{path}/terms")
    return found


class Index:
    """Where an index lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def postings(self) -> DataFrame:
        """term, block, n, most, keys, starts, places: a block's rows lie together. ``places`` has those of all ``keys``, four bytes each, one document's after another's, as from ``starts`` on."""
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long, blocks long").parquet(f"{self.path}/terms")


#: query_id, alternative (its number), term, required (false: excluded).
ASKED = "query_id string, alternative int, term string, required boolean"


def asked(queries: DataFrame, parse: Callable = parse_web_query) -> DataFrame:
    """The terms of each query's alternatives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {(q, a, s, ph[0] != "-") for q, text in zip(batch["query_id"], batch["query"], strict=True) for a, phrases in enumerate(parse(text)) for ph in phrases for s in (ph[1:] if ph[0] == "-" else ph) if s}
            yield pd.DataFrame(sorted(rows), columns=["query_id", "alternative", "term", "required"])

    return queries.select(F.col("query_id").cast("string"), "query").mapInPandas(run, ASKED)


def searched_blocks(index: Index, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, block, bound, seeds: the blocks that have all required terms of an alternative, and its SEED rarest terms."""
    own = ["query_id", "alternative"]
    held = index.terms().join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")
    need = terms.filter("required").join(held, "term", "left")
    plans = need.groupBy(*own).agg(F.count(F.lit(1)).alias("need"), F.count("df").alias("have"), F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t")).filter("need = have")
    plans = materialised(plans.select(*own, "need", F.transform("t", lambda t: t["term"]).alias("t")))
    heads = materialised(postings.select("term", "block", "most"))  # read twice
    first = broadcast_if_small(plans.withColumn("term", F.get("t", F.lit(0)))).join(heads, "term").select(*own, "need", "t", "block", F.col("most").alias("least"))
    others = first.filter("need > 1").select(*own, "need", "block", "least", F.explode(F.slice("t", F.lit(2), F.size("t"))).alias("term"))
    met = others.join(heads, ["term", "block"]).groupBy(*own, "block").agg(F.count(F.lit(1)).alias("have"), F.first("need").alias("need"), F.least(F.first("least"), F.min("most")).alias("least")).filter("have = need - 1")
    both = first.filter("need = 1").unionByName(met, allowMissingColumns=True).select(*own, "block", (F.col("least") * F.col("need") * EACH).alias("bound"))
    seeds = broadcast_if_small(plans.select(*own, F.slice("t", 1, SEED).alias("seeds")))
    # Alternatives add up: a stretch fulfils one of them.
    return both.join(seeds, own).groupBy("query_id", "block").agg(F.sum("bound").alias("bound"), F.collect_set("seeds").alias("seeds"))


def scored(blocks: DataFrame, queries: DataFrame, terms: DataFrame, postings: DataFrame, parse: Callable, keep: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """query_id, key, score of the documents in ``blocks`` (query_id, block, seeds) that match."""
    sets = blocks.select("query_id", "block", F.explode("seeds").alias("seeds"))
    by_seed = broadcast_if_small(sets.select("query_id", "block", "seeds", F.explode("seeds").alias("term")))
    keys = by_seed.join(postings.select("term", "block", "keys"), ["term", "block"])
    met = keys.select("query_id", "block", "seeds", F.explode("keys").alias("key")).groupBy("query_id", "block", "seeds", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size("seeds")).select("query_id", "block", "key").distinct()
    if keep:
        met = keep(materialised(met))
    wanted = materialised(met.groupBy("query_id", "block").agg(F.collect_set("key").alias("wanted")))  # at most a block's documents
    every = terms.select("query_id", "term").distinct()
    # Few matches are sent to the postings; only many are met by a shuffle.
    rows = broadcast_if_small(wanted.join(broadcast_if_small(every), "query_id")).join(postings.select("term", "block", "keys", "starts", "places"), ["term", "block"])
    here = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.array_contains(F.col("wanted"), F.get("keys", i)))
    begin, end = 4 * F.get("starts", F.col("i")), F.coalesce(4 * F.get("starts", F.col("i") + 1), F.octet_length("places"))
    rows = rows.withColumn("i", F.explode(here)).select("query_id", "term", F.get("keys", F.col("i")).alias("key"), F.substring("places", begin + 1, end - begin).alias("at"))
    found = rows.groupBy("query_id", "key").agg(F.collect_list("term").alias("terms"), F.collect_list("at").alias("places")).join(broadcast_if_small(queries.select(F.col("query_id").cast("string"), "query")), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list] = {}
        for batch in batches:
            ids, own, score = [], [], []
            for r in batch.to_pylist():
                if r["query"] not in parsed:
                    parsed[r["query"]] = parse(r["query"])
                got = match_score(parsed[r["query"]], {t: np.frombuffer(p, "<i4").tolist() for t, p in zip(r["terms"], r["places"], strict=True)})
                if got is not None:
                    ids.append(r["query_id"])
                    own.append(r["key"])
                    score.append(round(got, DIGITS))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(own, pa.int64()), pa.array(score, pa.float64())], ["query_id", "key", "score"])

    return found.mapInArrow(run, "query_id string, key long, score double")


def search(index: Index, queries: DataFrame, k: int | None = None, parse: Callable = parse_web_query, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, key, score, rank of the matching documents of (query_id, query): the best ``k`` of each, ties by key, or all.

    ``keep`` takes (query_id, block, key) and returns the rows that further filters let pass.
    """
    terms = materialised(asked(queries, parse))
    wanted = broadcast_if_small(terms.select("term").distinct())
    postings = index.postings().join(wanted, "term", "left_semi")
    blocks = materialised(searched_blocks(index, terms, postings))
    if k is None:
        return numbered(scored(blocks, queries, terms, postings, parse, keep), ["query_id"], [F.desc("score"), F.asc("key")], "rank")
    placed = materialised(numbered(blocks, ["query_id"], [F.desc("bound"), F.asc("block")], "place"))
    first, rest = placed.filter(F.col("place") <= FIRST_BLOCKS * k), placed.filter(F.col("place") > FIRST_BLOCKS * k)
    found = scored(first, queries, terms, postings, parse, keep)
    if not rest.isEmpty():
        found = materialised(found)
        best = numbered(found, ["query_id"], [F.desc("score"), F.asc("key")], "rank").filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = rest.join(best, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS)).drop("least")
        found = found.unionByName(scored(rest, queries, terms, postings, parse, keep))
    return numbered(found, ["query_id"], [F.desc("score"), F.asc("key")], "rank").filter(F.col("rank") <= k)
