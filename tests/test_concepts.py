"""Lookups in the concept graph on small tables, and against a plain search."""

import datetime
import random

import pytest

from groundspark.operators import concepts as C

CONCEPTS = "rxcui string, name string, synonym string, tty string, active boolean"
ROWS = [
    ("1", "metformin", None, "IN", True), ("2", "metformin hydrochloride", None, "PIN", True), ("3", "Glucophage", "Glucophage XR", "BN", True), ("4", "apixaban", None, "IN", True),
    ("5", "Eliquis", None, "BN", True), ("6", "Twice", None, "BN", True), ("7", "twice", None, "BN", True), ("8", "oldname", None, "BN", False), ("9", "Combo", None, "BN", True), ("10", None, None, None, True),
]
EDGES = [("3", "1", "IN"), ("3", "2", "PIN"), ("3", "1", "IN"), ("1", "3", "BN"), ("5", "4", "IN"), ("6", "1", "IN"), ("7", "4", "IN"), ("9", "1", "IN"), ("9", "4", "IN"), ("9", "404", "IN"), (None, "1", "IN")]


@pytest.fixture(scope="module")
def graph(spark):
    return (
        spark.createDataFrame(ROWS, CONCEPTS), spark.createDataFrame([("5", "apix tablets"), ("404", "nowhere")], "rxcui string, alias string"),
        spark.createDataFrame(EDGES, "rxcui string, related_rxcui string, related_tty string"), spark.createDataFrame([("Metformin",), ("apixaban",), (None,)], "concept_name string"),
    )


def normal(spark, graph, *terms):
    return {r.input_term: r for r in C.normalised(spark.createDataFrame([(t,) for t in terms], "term string"), *graph).collect()}


def test_release(spark):
    rows = [("a", "3.1", datetime.date(2025, 1, 1)), ("c", None, datetime.date(2025, 6, 1)), ("b", "3.1", datetime.date(2025, 6, 1))]
    kind = "version string, api_version string, published date"
    assert C.release(spark.createDataFrame(rows, kind)).collect() == [("c", None)]
    assert C.release(spark.createDataFrame([], kind)).collect() == [(None, None)]


def test_properties(spark, graph):
    ids = spark.createDataFrame([("3",), ("3",), ("404",), (None,), ("10",)], "rxcui string")
    assert sorted(C.properties(ids, graph[0]).collect()) == [("10", None, None, None, True), ("3", "Glucophage", "Glucophage XR", "BN", True), ("404", None, None, None, False)]


def test_related(spark, graph):
    pairs = lambda *types: sorted((r.rxcui, r.related.rxcui) for r in C.related_by_type(graph[0], graph[2], graph[0], types).collect())
    assert pairs("IN") == [("3", "1"), ("5", "4"), ("6", "1"), ("7", "4"), ("9", "1"), ("9", "4")]
    assert pairs("BN") == [("1", "3")]
    assert pairs("PIN", "BN") == [("1", "3"), ("3", "2")]


def test_statuses(spark, graph):
    got = normal(spark, graph, "metformin", " Glucophage\n", "GLUCOPHAGE xr", "apix-tablets", "metformn", "Combo", "twice", "TWICE", "oldname", "oldnama", "xyzzy", "", None, "!!")
    assert {t: (r.status, r.corpus_concept, r.selected and r.selected.rxcui) for t, r in got.items()} == {
        "metformin": ("resolved", "Metformin", "1"), "Glucophage": ("resolved", "Metformin", "3"), "GLUCOPHAGE xr": ("resolved", "Metformin", "3"), "apix-tablets": ("resolved", "apixaban", "5"),
        "metformn": ("resolved", "Metformin", "1"), "Combo": ("ambiguous", None, None), "twice": ("resolved", "apixaban", "7"), "TWICE": ("ambiguous", None, None),
        "oldname": ("rxnorm_match_no_corpus_match", None, None), "oldnama": ("no_rxnorm_match", None, None), "xyzzy": ("no_rxnorm_match", None, None), "": ("no_rxnorm_match", None, None), "!!": ("no_rxnorm_match", None, None),
    }
    assert got["metformn"].candidates[0].candidate.asDict() == {"rxcui": "1", "name": "metformin", "synonym": None, "tty": "IN", "match_method": "approximate", "score": 88, "rank": 1}
    whole = got["Glucophage"].candidates[0]
    assert [i.rxcui for i in whole.related_ingredients] == ["1", "2"] and whole.corpus_matches == ["Metformin"] and whole.candidate.rank is None
    assert got["Combo"].corpus_matches == ["Metformin", "apixaban"]
    assert got["xyzzy"].candidates == []


def test_a_synonym_leads_to_the_corpus(spark, graph):
    held = spark.createDataFrame([("glucophage xr",)], "concept_name string")
    got = normal(spark, (*graph[:3], held), "Glucophage")
    assert (got["Glucophage"].status, got["Glucophage"].corpus_concept) == ("resolved", "glucophage xr")


def test_corpus_names_that_normalise_alike(spark, graph):
    held = spark.createDataFrame([("METFORMIN",), ("metformin!",), ("metformin",)], "concept_name string")
    assert normal(spark, (*graph[:3], held), "metformin")["metformin"].corpus_matches == ["metformin!"]


def test_empty_tables(spark, graph):
    empty = [df.limit(0) for df in graph]
    assert normal(spark, graph) == {}
    assert normal(spark, empty, "metformin")["metformin"].status == "no_rxnorm_match"
    assert normal(spark, (*graph[:2], empty[2], empty[3]), "metformin")["metformin"].status == "rxnorm_match_no_corpus_match"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_names_equal_a_plain_search(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(4, 9))) for _ in range(300)})
    concepts = spark.createDataFrame([(f"{n:03d}", name, None, "BN", n % 9 != 0) for n, name in enumerate(names)], CONCEPTS)
    asked = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9))) for _ in range(60)} - set(names))
    terms = spark.createDataFrame([(t, t) for t in asked], "term string, normal string")
    got = C.approximate(terms, C.names_of(concepts, spark.createDataFrame([], "rxcui string, alias string"))).collect()
    want = []
    for t in asked:
        near = sorted((edits(t, name), name, f"{n:03d}") for n, name in enumerate(names) if n % 9 and len(t) >= 5 and edits(t, name) <= 2)
        want += [(t, i, e, 100 * (max(len(t), len(name)) - e) // max(len(t), len(name)), place) for place, (e, name, i) in enumerate(near[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want) and any(w[4] == 5 for w in want)
