import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.operators import retrieval as R
from groundspark.operators import sections as S


@pytest.mark.parametrize(("words", "starts"), [(0, []), (220, [0]), (221, [0, 180]), (401, [0, 180, 360])])
def test_chunk_windows(spark, words, starts):
    got = R.word_chunks(spark.createDataFrame([(1, " ".join(["w"] * words))], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [r.start_word for r in got] == starts and (not got or got[-1].end_word == words)


def test_chunk_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError, match="overlap"):
        R.word_chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), words=5, overlap=5)


def test_fusion_scores(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, k int, rank int")
    b = spark.createDataFrame([("q", 1, 1), ("q", 3, 2)], "query_id string, k int, rank int")
    got = {r.k: (r.score, r.rank) for r in R.fuse(a, b, "k").collect()}
    assert got[1] == (round(2 / 61, 10), 1) and got[2] == (round(1 / 62, 10), 2) and got[3][1] == 3  # a tie goes to the lexical arm


def test_cap_is_not_filled_up(spark):
    rows = spark.createDataFrame([("q", n, "s1" if n < 4 else f"s{n}", n) for n in range(1, 9)], "query_id string, k int, section string, rank int")
    assert [(r.k, r.evidence_id) for r in R.diversified(rows, "section").orderBy("position").collect()] == [(1, "E1"), (4, "E2"), (5, "E3")]


def test_empty_needles_ask_for_nothing(spark):
    row = spark.range(1).select(R.relevant(F.array().cast("array<string>"), F.lit("x"), F.array().cast("array<string>"), F.lit("t")).alias("r")).first()
    assert row.r


def test_section_tree_inherits(spark):
    xml = '<document xmlns="urn:hl7-org:v3"><component><structuredBody><component><section><id root="a"/><code code="34084-4"/><text>t</text><component><section><title>x</title></section></component></section></component></structuredBody></component></document>'
    rows = S.section_tree(spark.createDataFrame([("1", xml), ("2", "<broken"), ("3", None)], "label_id string, xml string")).orderBy("order_index").collect()
    assert [(r.depth, r.retrieval_family, r.mapping_method) for r in rows] == [(0, "adverse_reactions", "loinc"), (1, "adverse_reactions", "unmapped")]
    assert len(S.CODES) == 56 and len(S.TITLES) == 62 and len(S.FAMILIES) == 38


def test_cosine_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_VECTORS", 30)
    monkeypatch.setattr(R, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    v[50:60] = v[0]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(n, x.tolist(), n % 3) for n, x in enumerate(v)]
    asked = [(str(n), v[n].tolist(), None if n % 2 else n % 3) for n in range(0, 200, 11)]
    got = R.cosine_top(spark.createDataFrame(rows, "id long, embedding array<double>, label int"), spark.createDataFrame(asked, "query_id string, vector array<double>, label int"), "id", 7, filtered="label").collect()
    for q, x, label in asked:
        fit = [n for n in range(200) if label is None or n % 3 == label]
        best = sorted(fit, key=lambda n: (-round(float(np.dot(v[n], x)), 6), n))[:7]
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == best
