"""The inverted-file index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.operators import vectors as V
from groundspark.sources import sinks


def some(n, kind):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 16))
    if kind == "clustered":
        v = rng.normal(size=(12, 16))[rng.integers(0, 12, n)] * 3 + v * 0.4
    if kind == "hot":
        v[: n // 3] = v[0]  # a third alike
    return V.unit(v)


def nearest(v, ids, labels, asked, k):
    out = {}
    for q, x, label in asked:
        fit = [n for n in range(len(v)) if label is None or labels[n] == label]
        out[q] = [ids[n] for n in sorted(fit, key=lambda n: (-round(float(np.dot(v[n], x)), 6), ids[n]))[:k]]
    return out


@pytest.fixture
def made(spark):
    def make(v, **more):
        rows = spark.createDataFrame([(7 * n, x.tolist(), n % 3) for n, x in enumerate(v)] + [(-1, None, 1), (None, v[0].tolist(), 1)], "k long, embedding array<double>, label int").repartition(3)
        return V.build(rows, "k", sinks.new_folder(spark, "test-vectors"), label="label", **more)

    return make


@pytest.mark.parametrize("kind", ["clustered", "even", "hot"])
def test_exact_mode_equals_all_pairs(spark, made, kind, monkeypatch):
    monkeypatch.setattr(V, "PART_VECTORS", 50)
    monkeypatch.setattr(V, "CHUNK_QUERIES", 7)
    v = some(600, kind)
    asked = [(str(n), v[n] * 2, None if n % 2 else n % 3) for n in range(0, 600, 29)]
    queries = spark.createDataFrame([(q, x.tolist(), label) for q, x, label in asked] + [("none", None, None)], "query_id string, vector array<double>, label int")
    got = {}
    for r in V.search(made(v), queries, 7, filtered=True).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == nearest(v * 2, [7 * n for n in range(600)], [n % 3 for n in range(600)], [(q, x / 2, label) for q, x, label in asked], 7)


def test_bounds_drop_cells_and_probes_find_most(spark, made, monkeypatch):
    v = some(1200, "clustered")
    index = made(v, cells=12)
    queries = spark.createDataFrame([(str(n), v[n].tolist()) for n in range(0, 1200, 31)], "query_id string, vector array<double>")
    met = []
    best = V._best
    monkeypatch.setattr(V, "_best", lambda rows, *a: met.append(rows.count()) or best(rows, *a))
    exact = V.search(index, queries, 10)
    exact.collect()
    assert sum(met) < 0.5 * 39 * 12  # far fewer than all queries by all cells
    right = spark.createDataFrame([(q, n) for q, ns in nearest(v, [7 * n for n in range(1200)], None, [(str(n), v[n], None) for n in range(0, 1200, 31)], 10).items() for n in ns], "query_id string, id long")
    assert V.recall(exact, right).first().recall == 1
    probes = V.probes_for(index, queries, 10)
    assert probes < 6 and V.recall(V.search(index, queries, 10, exact=False, probes=probes), right).first().recall >= 0.9


def test_few_vectors(spark, made):
    one = made(some(1, "even"))
    ask = spark.createDataFrame([("q", some(1, "even")[0].tolist())], "query_id string, vector array<double>")
    assert [(r.id, r["rank"]) for r in V.search(one, ask, 5).collect()] == [(0, 1)]
    empty = V.build(spark.createDataFrame([], "k long, embedding array<float>"), "k", sinks.new_folder(spark, "test-vectors"))
    assert V.search(empty, ask, 5).count() == V.search(empty, ask, 5, exact=False).count() == 0
    assert V.search(one, ask.filter(F.lit(False)), 5).count() == 0


def test_cells_in_slices(spark, tmp_path, monkeypatch):
    """A batch of queries meets the cells a slice at a time, since each row has the query's vector; the rows are the same."""
    from groundspark.operators import vectors as operators

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, embedding array<double>")
    index = operators.build(rows, "id", str(tmp_path / "slices"), cells=6)
    asked = operators._asked(rows.selectExpr("id as query_id", "embedding as vector"), False)
    cells = lambda: sorted((r.query_id, r.cell, r.place) for r in operators.cells_of(index, asked).collect())
    whole = cells()
    monkeypatch.setattr(operators, "CELL_ROWS", 8)
    assert cells() == whole and whole
