"""Plans, routes, mentions and answers of stated questions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundspark.operators import planning as P
from groundspark.plans import planning


@pytest.fixture(scope="module")
def plans(spark):
    return {r.query_id: r for r in planning.queries()["family_plan"](spark, "/root/testdata/sf0.001").collect()}


@pytest.mark.parametrize(("query", "status", "family"), [
    ("q01", "routed_single_family", "indications_and_usage"), ("q02", "routed_single_family", "drug_interactions"), ("q03", "routed_single_family", "adverse_reactions"),
    ("q04", "routed_single_family", "dosage_and_administration"), ("q05", "candidate_family_group_unfiltered", None), ("q06", "not_attempted_explicit_family_present", None),
    ("q07", "candidate_family_group_unfiltered", None), ("q08", "routed_single_family", "indications_and_usage"), ("q09", "routed_single_family", "indications_and_usage"),
    ("q15", "no_route_detected", None), ("q18", "routed_single_family", "contraindications"), ("q20", "ambiguous", None),
])
def test_family_plan(plans, query, status, family):
    assert (plans[query].plan_status, plans[query].plan_family) == (status, family)


def test_routes(spark):
    got = {r.query_id: r for r in planning.queries()["source_route"](spark, "/root/testdata/sf0.001").collect()}
    assert got["q10"].planned_source == "multi_source_composed" and got["q10"].route_status == "ambiguous_mixed_source"
    assert got["q01"].planned_source == "dailymed_label"
    assert got["q13"].planned_source == "rxnorm_identity"
    assert got["q12"].identity_intent == "drug_identity_definition"


def test_mentions(spark):
    got = {r.query_id: (r.mention_status, r.retrieval_drug) for r in planning.queries()["mention_detect"](spark, "/root/testdata/sf0.001").collect()}
    assert got["q02"] == ("direct_corpus_mention", "apixaban")
    assert got["q11"] == ("rxnorm_resolved_query_mention", "metformin")
    assert got["q12"] == ("rxnorm_resolved_query_mention", "metformin")
    assert got["q15"][0] == "no_mention_detected"


def test_filters_fail_closed(spark):
    got = {r.query_id: (r.filter_status, r.filter_drug) for r in planning.queries()["filter_resolution"](spark, "/root/testdata/sf0.001").collect()}
    assert got["q13"] == ("rxnorm_resolved", "metformin") and got["q14"] == ("direct_corpus_match", "apixaban")
    assert got["q16"] == ("unresolved", None) and got["q01"] == ("not_requested", None)


def test_identity_answers(spark):
    rows = [("a", "Is Eliquis the same as apixaban?", "brand_generic_equivalence"), ("b", "Is Eliquis equivalent to metformin?", "brand_generic_equivalence"), ("c", "What is the generic name of the Glucophage?", "generic_name_lookup"),
            ("d", "Is Eliquis a brand name?", "brand_name_lookup"), ("e", "What is the brand name of apixaban?", "brand_name_lookup"), ("f", "What is zzz?", "drug_identity_definition")]
    q = spark.createDataFrame(rows, "query_id string, query string, identity_intent string")
    got = {r.query_id: (r.answered, r.answer, r.citations) for r in P.identity_answers(P.identity_terms(q), *planning.concepts(spark)[:2]).collect()}
    assert got["a"] == (True, "Yes. Eliquis and apixaban share an ingredient.", ["R1", "R2"]) and got["b"][1].startswith("No.")
    assert "metformin" in got["c"][1] and got["d"][1].startswith("Yes.") and "Eliquis" in got["e"][1] and got["f"] == (False, None, [])


def test_decomposition(spark):
    q = spark.createDataFrame([("1", "is Eliquis the same as apixaban and can it prevent stroke?", "apixaban"), ("2", "Is Glucophage a brand name AND what is it used for", "metformin"), ("3", "no second part", "x")], "query_id string, query string, retrieval_drug string")
    got = {r.query_id: (r.composition, r.identity_query, r.clinical_query) for r in P.decomposed(q).collect()}
    assert got["1"] == ("composed_answered", "Is Eliquis the same as apixaban?", "Can apixaban prevent stroke?")
    assert got["2"] == ("composed_answered", "Is Glucophage a brand name?", "What is metformin used for?")
    assert got["3"] == ("unsupported_decomposition", None, None)


def test_approximate_names(spark):
    """Near names decide together, errors in the first letter are found, and all pairs within two edits are compared."""
    import random

    from groundspark.schemas import ALIASES, CONCEPT_RELATIONS

    rows = [("hydroxyzine", "1", "hydroxyzine", None, "IN"), ("hydroxyzide", "2", "hydroxyzide", None, "IN"), ("metformin", "3", "metformin", None, "IN"), *((f"abcdefg{x}", f"x{x}", f"abcdefg{x}", None, "IN") for x in "hijklmn")]
    corpus = spark.createDataFrame([("hydroxyzine",), ("hydroxyzide",), ("metformin",)], "concept_name string")
    terms = spark.createDataFrame([("hydroxyzi e",), ("netformin",), ("etformin",), ("abcdefgz",)], "term string")
    got = {r.term: r for r in P.resolve_terms(terms, spark.createDataFrame(rows, ALIASES), spark.createDataFrame([], CONCEPT_RELATIONS), corpus).collect()}
    assert (got["hydroxyzi e"].resolution, got["hydroxyzi e"].corpus_matches) == ("ambiguous", ["hydroxyzide", "hydroxyzine"])
    assert {(got[t].resolution, got[t].rxcui) for t in ("netformin", "etformin")} == {("resolved", "3")}
    assert (got["abcdefgz"].candidates, got["abcdefgz"].rxcui) == (5, "xh")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 10))) for _ in range(150)})
    named = spark.createDataFrame([(w, w, "IN", w) for w in words], "rxcui string, name string, tty string, normal string")
    near = P.near_names(spark.createDataFrame([(w, w) for w in words], "term string, normal string"), named).collect()
    assert sorted((r.term, r.other) for r in near) == sorted((a, b) for a in words if len(a) >= 5 for b in words if edits(a, b) <= 2)


def test_approximate_names_with_a_common_suffix(spark):
    """What all names and terms end in makes no pairs: with 30,000 each, 900 million of them would be compared."""
    import time

    letters = F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 12), "0123456789", "ghijklmnop")
    own = spark.range(30_000).select(letters.alias("w"))
    named = own.select(F.col("w").alias("rxcui"), F.col("w").alias("name"), F.lit("BN").alias("tty"), F.concat("w", F.lit(" tablets")).alias("normal"))
    asked = own.select(F.concat(F.lit("q"), F.substring("w", 2, 10), F.lit("q tablets")).alias("normal")).withColumn("term", F.col("normal"))
    began = time.time()
    got = P.near_names(asked, named).agg(F.count_if(F.substring("term", 2, 10) == F.substring("other", 2, 10)).alias("own"), F.count(F.lit(1)).alias("n")).first()
    assert got.own >= 30_000 and got.n < 31_000 and time.time() - began < 60


def test_spans_are_found_in_the_row(spark):
    """Nothing is shuffled or grouped for them; each normal form once, 18 at most."""
    asked = spark.createDataFrame([("a", "Eliquis, eliquis and Eliquis-XR"), ("b", " ".join(f"word{chr(97 + n)}" for n in range(26))), ("c", None), ("d", "is it of")], "query_id string, query string")
    got = P.candidate_spans(asked)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.query_id, r.place, r.span) for r in got.collect())
    assert [r[2] for r in rows if r[0] == "a"] == ["Eliquis", "Eliquis-XR", "Eliquis eliquis", "eliquis and", "and Eliquis-XR", "Eliquis eliquis and", "eliquis and Eliquis-XR"]
    assert [r[1] for r in rows if r[0] == "b"] == list(range(1, 19)) and {r[0] for r in rows} == {"a", "b"}


def test_every_branch_answers(spark):
    got = {r.query_id: r for r in planning.queries()["workflow_answers"](spark, "/root/testdata/sf0.001").collect()}
    assert {r.branch for r in got.values()} == {"label", "identity", "mixed", "insufficient_evidence"}
    assert (got["q16"].branch, got["q16"].final_status) == ("insufficient_evidence", "insufficient_evidence")
    assert got["q13"].branch == "identity" and got["q13"].answer == "The generic name of Glucophage is metformin." and got["q13"].citations == "R1"
    assert got["q10"].composition_status == "composed_answered" and got["q10"].citations == "R1,R2,E1" and "\n\n" in got["q10"].answer
    assert got["q01"].branch == "label" and got["q01"].citations == "E1"


def test_the_same_question_is_worked_out_once(spark, monkeypatch):
    """Each different query, drug and family; nulls are as good as any, and a query_id may repeat."""
    asks = [("What is metformin?", None, None), ("What is metformin?", "apixaban", None), ("What is metformin?", None, "overdosage"), (None, None, None), ("Can eliquiss prevent stroke?", None, None)]
    ids = [(f"q{n // 2}", *ask) for n, ask in enumerate(asks * 40)]
    asked = spark.createDataFrame(ids, "query_id string, query string, drug string, family string")
    seen = []
    spans = P.candidate_spans
    monkeypatch.setattr(P, "candidate_spans", lambda q: seen.append(q.select("query_id").count()) or spans(q))
    got = P.workflow(asked, *planning.concepts(spark)).collect()
    assert seen == [2]  # without a drug and a direct mention: null and the misspelt one
    assert sorted(r.query_id for r in got) == sorted(x[0] for x in ids)
    what = "What is metformin?"
    assert Counter((r.query, r.drug_found, r.effective_family) for r in got) == dict.fromkeys([(what, "metformin", None), (what, "apixaban", None), (what, "metformin", "overdosage"), (None, None, None), ("Can eliquiss prevent stroke?", "apixaban", "indications_and_usage")], 40)
    seen.clear()
    assert P.mentions(asked, *planning.concepts(spark)).count() == 200 and seen == [2]


def test_citation_prefixes(spark):
    rows = spark.createDataFrame([(["R1", "E1"], ["R", "E"]), (["R1", "E1"], ["E"]), (["X"], []), ([], ["E"])], "c array<string>, p array<string>")
    assert [r[0] for r in rows.select(P.prefixes_pass(rows.c, rows.p)).collect()] == [True, False, True, True]
