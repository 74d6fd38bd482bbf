"""Models as plugs, outputs of models, evidence against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.operators import planning as P
from groundspark.operators import retrieval as R
from groundspark.operators import scoring as S

seen = []


def counting():
    """A model that scores a pair by its place in the micro-batch, and fails on batches that are too large or long."""
    seen.append(1)

    def score(pairs):
        sizes = [len(q.split()) + len(p.split()) for q, p in pairs]
        assert len(pairs) <= 4 and max(sizes) <= 10 and sizes == sorted(sizes)
        return np.array(sizes, float) + len(seen)

    return score


def test_any_function_of_pairs_is_a_model(spark):
    rng = random.Random(1)
    rows = [(n, " ".join(["q"] * rng.randrange(0, 13)) if n else None, " ".join(["p"] * rng.randrange(0, 30))) for n in range(200)]
    df = spark.createDataFrame(rows, "n int, q string, p string").repartition(2)
    got = {r.n: r.s for r in df.select("n", S.pair_score(counting, batch=4, most=10)("q", "p").alias("s")).collect()}
    want = {n: min(10, len((q or "").split()) + len(p.split())) + 1 for n, q, p in rows}  # + 1: loaded once a worker
    assert got == want


def test_pairs_are_cut():
    assert S.cut("a b c", "d e f", 5) == ("a b c", "d e", 5) and S.cut("a b c", "d", 2) == ("a b", "", 2) and S.cut(None, " x  y ", 9) == ("", " x  y", 2)


def test_overlap_is_the_default(spark):
    rows = [("liver warning dose", "A warning: the LIVER"), ("", "x"), (None, None), ("the the", "the")]
    df = spark.createDataFrame(rows, "q string, p string").select(S.pair_score()("q", "p").alias("a"), R.overlap_score(F.col("q"), F.col("p")).alias("b"))
    assert all(r.a == r.b for r in df.collect())
    ranked = spark.createDataFrame([("1", 7, "liver dose", "nothing", 1), ("1", 8, "liver dose", "dose liver", 2)], "query_id string, k long, q string, p string, rank int")
    assert [(r.k, r["rank"]) for r in R.reranked(ranked, "k", "q", "p", score=S.pair_score()).orderBy("rank").collect()] == [(8, 1), (7, 2)]


@pytest.mark.parametrize(("raw", "status", "citations", "error"), [
    ('{"status":"answered","answer":"a","citations":["E1"]}', "answered", ["E1"], None),
    ('Sure: {"status":"answered","answer":"a","citations":["E1"],"more":{"x":[1,{"y":2}]}} done', "answered", ["E1"], None),
    ('{"status":"answered","answer":"a","citations":[1,"E2"]}', "answered", ["1", "E2"], None),
    ('{"status":"answered","answer":"a","citations":"E1"}', "answered", None, "citations_not_a_list"),
    ('{"status":"answered","answer":"a"}', "answered", None, None),
    ('{"status":"answered","answer":"a","citations":null}', "answered", None, None),
    ('{"status":"answered","answer":', None, None, "no_object"),
    ('{"status":"answered","answer":}', None, None, "broken_json"),
    ('{"status":"a","status":"b"}', None, None, "broken_json"),
    ("{one} and {two}", None, None, "broken_json"),
    ("no json", None, None, "no_object"),
    (None, None, None, "no_object"),
])
def test_outputs_of_models(spark, raw, status, citations, error):
    a = spark.createDataFrame([(raw,)], "raw string").select(P.parsed_answer(F.col("raw")).alias("a")).first().a
    assert (a.status, a.citations, a.error) == (status, citations, error)


def test_a_nested_answer_and_a_verifier(spark):
    rows = [("1", "Is it?", '{"status":"answered","answer":{"text":"used for x"},"citations":["E1"]}', [("E1", "used for x")]), ("2", "Is it?", '{"status":"answered","answer":"something else","citations":["E1"]}', [("E1", "used for x")]), ("3", "Is it?", '{"status":"answered","answer":"a","citations":"E1"}', [("E1", "a")])]
    df = spark.createDataFrame(rows, "query_id string, query string, raw string, evidence array<struct<evidence_id:string,text:string>>")
    gates = lambda **more: {r.query_id: r.gate for r in P.answer_gates(df, **more).collect()}
    assert gates() == {"1": "passed", "2": "verifier", "3": "citations_do_not_fit_status"}
    assert gates(verifier=lambda answer, text: F.when(S.pair_score()(answer, text) > 0.9, "supported").otherwise("weak"))["2"] == "verifier"
    assert gates(verifier=lambda answer, text: F.lit("supported"))["2"] == "passed"


def test_evidence_equals_a_plain_search(spark):
    """Few distinct words, so that sections of a class and equal scores are many."""
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice(["dose", "liver", "risk", "stroke", "the", "use", "zz"]) for _ in range(n))
    sections = [(n, rng.choice(["a", "B"]), rng.choice(["f", "g"]), draw(rng.randrange(5))) for n in range(300)]
    questions = [(str(n), draw(rng.randrange(5)), rng.choice([None, "b", "A", "none"]), rng.choice([None, "f"])) for n in range(80)]
    q = spark.createDataFrame(questions, "query_id string, query string, drug string, family string")
    s = spark.createDataFrame(sections, "section_id long, concept_name string, family string, text string").repartition(3)
    want = {}
    for n, query, drug, family in questions:
        terms = {*query.split()} - P.STOP - {(drug or "").lower()}
        scored = [(-len(terms & {*t.split()}), k, t) for k, c, f, t in sections if (drug is None or c.lower() == drug.lower()) and family in (None, f)]
        want[n] = [t for score, _, t in sorted(scored) if score < 0][:5]
    got = {r.query_id: [e.text for e in r.evidence] for r in P.label_evidence(q, s).collect()}
    assert got == want
