"""Phrases found through automata against a plain search."""

import random

import pytest

from groundspark.operators import phrases as P


def plain(texts, wanted):
    return sorted((k, p, at) for k, t in texts if t for p in wanted if p for at in range(len(t.split(" "))) if t.split(" ")[at : at + len(p.split(" "))] == p.split(" "))


def drawn(seed, n, most, letters="abcd"):
    rng = random.Random(seed)
    return [" ".join(rng.choice(letters) for _ in range(rng.randrange(1, most))) for _ in range(n)]


@pytest.mark.parametrize(("held", "chunk"), [(50_000, 100_000), (30, 100_000), (30, 40), (1, 7)])
def test_hits_equal_a_plain_search(spark, monkeypatch, held, chunk):
    """One automaton, then shards; of the phrases a third begin with the same word."""
    monkeypatch.setattr(P, "SHARD_PHRASES", held)
    monkeypatch.setattr(P, "CHUNK_TEXTS", chunk)
    texts = [*enumerate(drawn(1, 120, 20)), (900, None), (901, ""), (902, "a"), (903, "none of them")]
    wanted = {*drawn(2, 60 if held > 1 else 12, 6), "", "a a a b", "a b c d a b c d a"}
    t = spark.createDataFrame(texts, "k long, t string").repartition(3)
    got = P.phrase_hits(t, "k", "t", spark.createDataFrame([(p,) for p in [*wanted, *wanted, None]], "phrase string")).collect()
    assert sorted((r.k, r.phrase, r.place) for r in got) == plain(texts, wanted) != []


def test_a_large_dictionary(spark):
    names = spark.range(300_000).selectExpr("concat_ws(' ', concat('n', id % 1000), concat('m', id), 'x') AS phrase")
    texts = spark.range(500).selectExpr("id AS k", "concat_ws(' ', 'see', concat('n', (id * 7) % 1000), concat('m', id * 7), 'x', 'and', concat('n', id), 'y') AS t")
    got = P.phrase_hits(texts, "k", "t", names).collect()
    assert {(r.k, r.phrase, r.place) for r in got} == {(k, f"n{7 * k % 1000} m{7 * k} x", 1) for k in range(500)}


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "phrase string"), spark.createDataFrame([("a",)], "phrase string")
    t = spark.createDataFrame([(1, "a b")], "k long, t string")
    assert P.phrase_hits(t, "k", "t", none).count() == P.phrase_hits(t.limit(0), "k", "t", some).count() == 0 and P.phrase_hits(t, "k", "t", some).count() == 1
