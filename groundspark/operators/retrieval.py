"""Chunking, lexical and vector retrieval, fusion, evidence selection and retrieval metrics, over sets of queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, collapse
from ..sources.tables import numbered, spread

CHUNK_WORDS, CHUNK_OVERLAP = 220, 40
RRF_K, POOL, TOP_K, PER_SECTION = 60, 30, 5, 1
NO_RANK = 10_000


def word_chunks(docs: DataFrame, text: str = "text", words: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping windows of words: chunk_index, start_word, end_word, token_count, char_count, chunk_text. A text without words has none."""
    if overlap >= words:
        raise ValueError("the overlap must be smaller than the window")
    step = words - overlap
    split = docs.withColumn("_w", F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda x: x != "")).filter(F.size("_w") > 0)
    n = F.size("_w")
    last = F.greatest(F.ceil((n - words) / step), F.lit(0)).cast("int")
    cut = split.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    body = F.slice("_w", start + 1, words)
    out = cut.select(*(c for c in docs.columns if c != text), "chunk_index", start.alias("start_word"), F.least(start + words, n).alias("end_word"), F.array_join(body, " ").alias("chunk_text"))
    return out.withColumns({"token_count": F.col("end_word") - F.col("start_word"), "char_count": F.length("chunk_text")})


def embedding_text(fields: list[tuple[str, Column, str]], body: Column) -> Column:
    """A header line for each field, with its fallback for nulls and empty values, a blank line, and the body."""
    head = [F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(collapse(value.cast("string")), F.lit("")), F.lit(fallback))) for name, value, fallback in fields]
    return F.concat_ws("\n", *head, F.lit(""), body)


EMBED_WIDTH, EMBED_ROWS = 64, 64


class _Places(dict):
    """Words and their places: that of the vector, after those with the other sign. The words of at most PLACES_HELD are kept."""

    def __missing__(self, word: str) -> int:
        h = hashlib.md5(word.encode()).digest()
        place = h[0] % EMBED_WIDTH + (EMBED_WIDTH if h[1] % 2 else 0)
        if len(self) < PLACES_HELD:
            self[word] = place
        return place


PLACES_HELD = 1 << 19
_places = _Places()


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """The offline default: tokens hashed to signed places of a vector, at unit length."""
    out = np.zeros((len(texts), EMBED_WIDTH))
    for row, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        counts = np.bincount(np.fromiter(map(_places.__getitem__, words), np.int64, len(words)), minlength=2 * EMBED_WIDTH)
        out[row] = counts[EMBED_WIDTH:] - counts[:EMBED_WIDTH]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def embedded(rows: DataFrame, text: str = "text", embedder: Callable[[list[str]], np.ndarray] = hashing_embedder, element: str = "float") -> DataFrame:
    """``rows`` with embedding (an array of ``element``) in place of ``text``; the embedder, any function of a list of texts, is given EMBED_ROWS at once."""
    kept = [f for f in rows.schema if f.name not in (text, "embedding")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"embedding array<{element}>"])

    kind = pa.float32() if element == "float" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            made = [embedder(texts[at : at + EMBED_ROWS]) for at in range(0, len(texts), EMBED_ROWS)]
            flat = np.concatenate(made).astype(kind.to_pandas_dtype()) if made else np.empty((0, 0), kind.to_pandas_dtype())
            starts = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (flat.shape[1] if len(flat) else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.ListArray.from_arrays(starts, pa.array(flat.ravel(), kind))], [*(f.name for f in kept), "embedding"])

    return spread(rows.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text))).mapInArrow(run, schema)


def chunk_metadata(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """Chunk records: the chunk's columns, its type, and ``fields`` with the chunking's own settings as metadata."""
    meta = F.struct(*fields, F.lit("section_word_window").alias("chunking_strategy"), F.lit(CHUNK_WORDS).alias("max_words"), F.lit(CHUNK_OVERLAP).alias("overlap_words"))
    return chunks.select("*", F.lit("section_text").alias("chunk_type"), meta.alias("metadata"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def top_k(scored: DataFrame, key: str, k: int, rank: str = "rank") -> DataFrame:
    """The best k of each query, ties by key; Spark limits each group before the exchange."""
    return numbered(scored, ["query_id"], [F.desc("score"), F.asc(key)], rank).filter(F.col(rank) <= k)


#: Vectors and queries of a block: what a task multiplies at once.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024


def cosine_top(vectors: DataFrame, queries: DataFrame, key: str, k: int, vector: str = "embedding", filtered: str | None = None) -> DataFrame:
    """query_id, key, score, rank: the best k unit vectors of each query, ties by key. ``filtered``: a column of both sides that must be equal (exactly), null in the query for any.

    A stated set of queries against all rows, in blocks: each block of vectors meets each block of queries in one matrix product, of which the best k of a query go on.
    """
    label = F.col(filtered).cast("string") if filtered else F.lit(None).cast("string")
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n, m = blocks(vectors, BLOCK_VECTORS), blocks(queries, BLOCK_QUERIES)
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), label.alias("label"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("b"))
    asked = queries.select("query_id", F.col("vector").alias("v"), label.alias("label"), F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            score = np.round(np.stack(right["v"]).astype(np.float64) @ np.stack(left["v"]).astype(np.float64).T, 6)
            if filtered:
                asks = right["label"].notna().to_numpy()
                score[asks[:, None] & (right["label"].to_numpy()[:, None] != left["label"].to_numpy()[None, :])] = np.nan
            ids = left["id"].to_numpy()
            for q, row in zip(right["query_id"], score, strict=True):
                best = np.lexsort((ids, -row))[:k]  # NaN comes last
                out.append(pd.DataFrame({"query_id": q, "id": ids[best], "score": row[best]}).dropna())
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    found = own.groupBy("a", "b").cogroup(asked.groupBy("a", "b")).applyInPandas(run, "query_id string, id long, score double")
    return top_k(found.withColumnRenamed("id", key), key, k)


def fuse(lexical: DataFrame, dense: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: score, lexical_rank, dense_rank, rank."""
    both = lexical.select("query_id", key, F.col("rank").alias("lexical_rank")).join(dense.select("query_id", key, F.col("rank").alias("dense_rank")), ["query_id", key], "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("lexical_rank") + part("dense_rank"), 10))
    order = [F.desc("score"), F.coalesce("lexical_rank", F.lit(NO_RANK)), F.coalesce("dense_rank", F.lit(NO_RANK)), F.asc(key)]
    return numbered(scored, ["query_id"], order, "rank")


def diversified(ranked: DataFrame, section: str, k: int = TOP_K, cap: int = PER_SECTION) -> DataFrame:
    """Within the best k, at most ``cap`` of a section in rank order, without filling up; numbered E1, E2, ..."""
    best = ranked.filter(F.col("rank") <= k)
    kept = numbered(best, ["query_id", section], [F.asc("rank")], "in_section").filter(F.col("in_section") <= cap).drop("in_section")
    return numbered(kept, ["query_id"], [F.asc("rank")], "position").withColumn("evidence_id", F.concat(F.lit("E"), F.col("position").cast("string")))


def prompt_blocks(evidence: DataFrame, head: Column, body: Column) -> DataFrame:
    """One text for each query: its evidence in order, each under its id. At most TOP_K rows for a query."""
    rows = evidence.select("query_id", F.struct("position", F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), head, F.lit("\n"), body).alias("block")).alias("b"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("prompt"))


def overlap_score(query: Column, passage: Column) -> Column:
    """Stand-in for a model's relevance score: the share of the query's terms that the passage has."""
    q = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(passage))), F.size(q)), F.lit(0.0)), 6)


def reranked(ranked: DataFrame, key: str, query: str, passage: str, score: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """By a score of query and passage, of a model (``scoring.pair_score``) or by default of their overlap; the rank before stays as original_rank."""
    scored = ranked.withColumnRenamed("rank", "original_rank").withColumn("rerank_score", score(F.col(query), F.col(passage)))
    return numbered(scored, ["query_id"], [F.desc("rerank_score"), F.asc("original_rank"), F.asc(key)], "rank")


def relevant(families: Column, family: Column, needles: Column, text: Column) -> Column:
    """An empty list of families or needles asks for nothing."""
    low = F.lower(collapse(text))
    return ((F.size(families) == 0) | F.array_contains(families, family)) & ((F.size(needles) == 0) | F.exists(needles, lambda n: F.contains(low, F.lower(n))))


def retrieval_metrics(cases: DataFrame, judged: DataFrame, k: int = TOP_K) -> DataFrame:
    """cases, hit_at_1, hit_at_k and mrr. ``judged``: query_id, rank, relevant."""
    first = judged.filter(F.col("relevant") & (F.col("rank") <= k)).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = cases.select("query_id").join(first, "query_id", "left")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.agg(F.count(F.lit(1)).alias("cases"), mean(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("hit_at_1"), mean(F.col("first").isNotNull().cast("double")).alias("hit_at_k"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
