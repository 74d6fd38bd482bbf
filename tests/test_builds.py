"""Readers, the command line, and what health and embedders promise."""

import io
import zipfile

import numpy as np
import pytest

from groundspark import cli
from groundspark.operators import retrieval as R
from groundspark.operators.builder import Builder, Step, digest
from groundspark.plans import builds
from groundspark.sources import sinks
from groundspark.sources import tables as T

DATA = "/root/testdata/sf0.001"


def test_commands(spark, capsys):
    for argv, said in [(["route", "What is Eliquis?"], "identity"), (["resolve", "metformn"], "approximate"), (["family", "Is there an interaction?"], "drug_interactions"), (["query", "distinct_concepts", "--data", DATA], "src0"), (["answer", "What is the brand name of metformin?", "--data", DATA], "Glucophage"), (["prompt", "stroke", "--drug", "apixaban", "--data", DATA], "[E1]")]:
        cli.main(argv)
        assert said in capsys.readouterr().out


def test_paged_listing_and_histories(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"p{n}.json").write_text(f'{{"metadata":{{"total_pages":2}},"data":[{{"setid":"s{n}","title":"t"}},\n{{"setid":"x{n}"}}]}}')
    assert sorted(r.setid for r in T.pages_of(spark, str(tmp_path), "setid STRING, title STRING").collect()) == ["s1", "s2", "x1", "x2"]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text('{"data":{"spl":{"title":"T","setid":"s"},\n"history":[{"spl_version":2,"published_date":"d2"},{"spl_version":1,"published_date":"d1"}]}}')
    assert [(r.set_id, r.history_spl_version) for r in T.histories(spark, str(tmp_path / "h")).orderBy("history_spl_version").collect()] == [("s", "1"), ("s", "2")]


def test_largest_xml_member(spark, tmp_path):
    def archive(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name, text)
        return out.getvalue()

    for name, raw in {"a.zip": archive({"s.xml": "<a/>", "l.XML": "<a>long</a>", "x.jpg": "y" * 99}), "b.zip": archive({"x.txt": "z"}), "c.zip": b"broken"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path[-5:]: r.xml for r in T.largest_xml_members(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.zip": "<a>long</a>", "b.zip": None, "c.zip": None}


def test_seeds_and_suites_from_yaml(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("drugs:\n  - {concept_name: a, query_name: a, set_id: x, locked_spl_version: 3}\n  - {concept_name: b, query_name: b}\n")
    assert [r.concept_name for r in T.locked(T.seeds_from_yaml(spark, str(tmp_path / "s.yaml"))).collect()] == ["a"]
    (tmp_path / "e.yaml").write_text("")
    assert T.eval_suite(spark, str(tmp_path / "e.yaml")).count() == 0


def test_embedder_is_a_plug(spark):
    sizes = []
    rows = spark.createDataFrame([(n, "x" * n) for n in range(5)], "doc_id long, text string")
    got = R.embedded(rows, embedder=lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert sorted((r.doc_id, r.embedding) for r in got) == [(n, [float(n), 1.0]) for n in range(5)] and not sizes
    assert np.allclose(np.linalg.norm(R.hashing_embedder(["a b c", "d"]), axis=1), 1) and not R.hashing_embedder([""]).any()


def test_a_build_goes_on_where_it_is_needed(spark):
    ran = []

    def step(name, *inputs, make, group="build", version="1"):
        return Step(name, group, inputs, lambda *a: ran.append(name) or make(*a), version)

    def run(steps, a, b, **more):
        ran.clear()
        frames = {"a": spark.createDataFrame(a, "k long"), "b": spark.createDataFrame(b, "k long")}
        return {r.step: (r.status, r.rows) for r in Builder(spark, root, steps).run(frames, **more).collect()}

    root = sinks.new_folder(spark, "test-build")
    steps = [step("twice", "a", make=lambda a: a.selectExpr("2 * k AS k")), step("even", "b", make=lambda b: b.filter("k % 2 = 0")), step("both", "twice", "even", make=lambda x, y: x.union(y)), step("checks", "both", make=lambda x: x.filter("k < 0"), group="validation")]
    one = [(1,), (2,)]
    assert {s for s, _ in run(steps, one, one, plan_only=True).values()} == {"planned"} and not ran
    assert run(steps, one, one, leave_out=("validation",)) == {"twice": ("done", 2), "even": ("done", 1), "both": ("done", 3), "checks": ("left out", None)}
    assert run(steps, one, one)["checks"] == ("done", 0) and ran == ["checks"]
    assert {s for s, _ in run(steps, one[::-1], one).values()} == {"unchanged"} and not ran  # the same rows in another order
    run(steps, [(1,), (2,), (3,)], one)
    assert ran == ["twice", "both", "checks"]  # followers of what changed
    run(steps, [(1,), (2,), (3,)], [(2,), (5,)])
    assert ran == ["even"]  # it wrote what it had written: its followers stay
    run([*steps[:1], step("even", "b", make=lambda b: b, version="2"), *steps[2:]], [(1,), (2,), (3,)], [(2,), (5,)])
    assert ran == ["even", "both", "checks"]
    with pytest.raises(ValueError, match="needs c"):
        run([step("x", "c", make=None)], one, one)


def test_a_build_that_dies_goes_on_with_the_step_it_died_in(spark):
    ran = []

    def fail(df):
        raise RuntimeError("no source")

    root = sinks.new_folder(spark, "test-build")
    first = Step("one", "build", ("a",), lambda a: ran.append(1) or a)
    frames = {"a": spark.range(3).selectExpr("id AS k")}
    with pytest.raises(RuntimeError):
        Builder(spark, root, [first, Step("two", "build", ("one",), fail), Step("three", "build", ("two",), lambda x: ran.append(3) or x)]).run(frames)
    assert ran == [1]
    rows = Builder(spark, root, [first, Step("two", "build", ("one",), lambda x: x.limit(1)), Step("three", "build", ("two",), lambda x: ran.append(3) or x)]).run(frames).collect()
    assert [(r.status, r.rows) for r in rows] == [("unchanged", 3), ("done", 1), ("done", 1)] and ran == [1, 3]


def test_the_last_row_wins_in_split_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"part-{n}.csv").write_text("k,v\n" + "".join(f"{k % 50},{n}-{k}\n" for k in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        got = T.keyed_csv(spark, str(tmp_path), "k int, v string", ["k"])
        assert {r.k: r.v for r in got.collect()} == {k: f"2-{3950 + k}" for k in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_suite_files_are_bounded(spark, monkeypatch):
    """A nation's cases lie in files of so many numbers each, whatever their number; all are read."""
    read, made = [], builds.T.eval_suite
    monkeypatch.setattr(builds, "SUITE_KEYS", 10)
    monkeypatch.setattr(builds.T, "eval_suite", lambda s, path: read.append(path) or made(s, path))
    got = builds.suite(spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert spark.read.text(read[0], wholetext=True).selectExpr("max(size(split(value, '\n'))) - 1").first()[0] <= 10


def test_digests_tell_contents_apart(spark):
    """Also where a hash passes over nulls and ends of arrays."""
    kind = "a string, b string, f array<float>, t array<string>, s struct<x:int,y:int>"
    rows = [(None, "x", [1.0, None], ["ab"], None), ("x", None, [1.0, None], ["ab"], None), ("x", None, [None, 1.0], ["ab"], None), ("x", None, [1.0], ["ab"], None), ("x", None, [], ["ab"], None), ("x", None, None, ["ab"], None), ("x", None, None, ["a", "b"], None), ("x", None, None, ["ab", ""], None), ("x", None, None, [None, "ab"], None), ("x", None, None, None, (1, None)), ("x", None, None, None, (None, 1)), ("x", None, None, None, (None, None))]
    found = [digest(spark.createDataFrame([r], kind))[0] for r in rows]
    assert len(set(found)) == len(rows)
    both = spark.createDataFrame(rows, kind)
    assert digest(both) == digest(both.orderBy("b", "a").repartition(3)) and digest(both)[1] == len(rows)
