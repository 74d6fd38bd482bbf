"""From raw documents to token counts: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but
the last return the columns of documents; the last adds n_tokens, ids_sha256 and decoded_sha256.

Defined results: null and empty texts get the score of a zero margin and are kept or rejected by it, then are one
text; of rows equal in doc_id and text one stays; a null doc_id is smaller than all others in exact dedup and never
names a group of near copies unless all of it are null; equal scores and sizes are settled by doc_id, then by a hash
of the text; texts of any length pass whole; an empty table stays empty; further columns are kept, whatever their names,
but for the three that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundspark.llm import bpe, decontaminate, exact_dedup, quality, simhash
from groundspark.llm._common import discard, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.thin_out(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.pipeline_stage(docs)


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("decontamination", leak_stage), ("tokens", token_stage)]

#: The classifier, SimHash and BPE have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if hasattr(before, "written_to"):
            discard(before)
    return docs
