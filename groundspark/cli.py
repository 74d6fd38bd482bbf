"""Command line: run a registered query, plan or route a question, detect its drug, resolve a term, search.

``python -m groundspark.cli query evidence_pack --data DIR``; the other commands take a text.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index
from .operators import planning as P
from .plans import planning, registry, retrieval
from .schemas import QUESTIONS
from .session import get_session


def asked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.createDataFrame([("1", a.text, a.drug, a.family, 5)], QUESTIONS).drop("top_k")


def search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    q = spark.createDataFrame([("1", a.text)], "query_id string, query string")
    return index.search(retrieval.document_index(spark, a.data), q, a.top_k)


COMMANDS = {
    "query": lambda s, a: registry.queries()[a.text](s, a.data),
    "family": lambda s, a: P.family_plan(asked(s, a)),
    "mention": lambda s, a: P.mentions(asked(s, a), *planning.concepts(s)),
    "route": lambda s, a: P.workflow(asked(s, a), *planning.concepts(s)),
    "resolve": lambda s, a: P.resolve_terms(s.createDataFrame([(a.text,)], "term string"), *planning.concepts(s)),
    "answer": lambda s, a: P.answers(asked(s, a), *planning.concepts(s), planning.sections(s, a.data)),
    "prompt": lambda s, a: P.label_evidence(asked(s, a), planning.sections(s, a.data)).select(F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("["), e["evidence_id"], F.lit("] "), e["text"])), "\n").alias("prompt")),
    "search": search,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="groundspark")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("text", help="a question, a term, a search, or for query its name")
    parser.add_argument("--data", default=".", help="the folder of the tables")
    parser.add_argument("--drug")
    parser.add_argument("--family")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--rows", type=int, default=20, help="rows shown")
    a = parser.parse_args(argv)
    COMMANDS[a.command](get_session("groundspark"), a).show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
