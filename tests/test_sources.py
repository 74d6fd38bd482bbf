"""Paged listings, versions of tables, and indexes kept like their tables."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from groundspark.operators import sync
from groundspark.sources import sinks
from groundspark.sources.paged import PagedListing
from groundspark.sources.versions import Change, Versions


@pytest.fixture(scope="module")
def paged(spark):
    spark.dataSource.register(PagedListing)
    return lambda url, **more: spark.read.format("paged").options(url=url, wait="0.01", **more)


def pages(folder, total, files=None, per=3):
    for n in range(1, (files or total) + 1):
        (folder / f"p{n}.json").write_text(json.dumps({"metadata": {"total_pages": total}, "data": [{"setid": f"s{n}-{k}", "title": "t", "spl_version": str(n)} for k in range(per)]}))
    return f"{folder.as_uri()}/p{{page}}.json"


def test_the_number_of_pages_is_honoured(paged, tmp_path):
    df = paged(pages(tmp_path, 4, files=6)).load()
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert sorted(r.setid for r in rows) == sorted(f"s{n}-{k}" for n in range(1, 5) for k in range(3)) and {r.spl_version for r in rows} == {1, 2, 3, 4} and rows[0].published_date is None
    named = paged(pages(tmp_path, 2)).schema("title string, setid string").load()
    assert named.columns == ["title", "setid"] and named.count() == 6


@pytest.fixture
def service():
    """Fails twice for page 2, always for page 9, and says that page 5 isn't there."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.rpartition("=")[2])
            asked[n] += 1
            ok = n not in (5, 9) and not (n == 2 and asked[2] < 3)
            self.send_response(200 if ok else 404 if n == 5 else 503)
            self.end_headers()
            if ok:
                self.wfile.write(json.dumps({"metadata": {"total_pages": int(self.path.split("/")[1])}, "data": [{"setid": f"s{n}"}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield lambda total: f"http://127.0.0.1:{server.server_port}/{total}/spls?page={{page}}", asked
    server.shutdown()


def test_a_failing_page_is_asked_for_again(paged, service):
    url, asked = service
    assert sorted(r.setid for r in paged(url(3)).load().collect()) == ["s1", "s2", "s3"] and asked[2] == 3
    with pytest.raises(Exception, match="page 5"):
        paged(url(5)).load().collect()
    assert asked[5] == 1  # what isn't there isn't asked for again
    with pytest.raises(Exception, match="503"):
        paged(url(9).replace("page={page}", "page=9"), retries="2").load().collect()
    assert asked[9] == 3


def test_a_stream_goes_on_with_new_pages(spark, paged, tmp_path):
    (tmp_path / "in").mkdir()
    for total in (2, 5):
        url = pages(tmp_path / "in", total)
        stream = spark.readStream.format("paged").options(url=url, wait="0.01").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
        q.processAllAvailable()
        q.stop()
        assert Counter(r.spl_version for r in spark.read.parquet(str(tmp_path / "out")).collect()) == Counter({n: 3 for n in range(1, total + 1)})


@pytest.fixture
def versions(spark):
    return Versions(spark, sinks.new_folder(spark, "test-versions"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def test_tables_change_together(spark, versions):
    assert versions.commit({"request": Change(frame(spark, (1, "a"))), "evidence": Change(frame(spark, (1, "x"), (1, "y")))}) == 1
    broken = frame(spark, (2, "z")).withColumn("v", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        versions.commit({"request": Change(frame(spark, (2, "b"))), "evidence": Change(broken)})
    assert versions.read("request").count() == 1 and versions.read("evidence").count() == 2  # no half answer
    assert versions.commit({"request": Change(frame(spark, (2, "b"))), "evidence": Change(frame(spark, (2, "z")))}, "second") == 2
    assert versions.commit({"request": Change(frame(spark, (2, "b"))), "evidence": Change(frame(spark, (2, "z")))}, "second") == 2  # replayed
    assert versions.read("request").count() == 2 and versions.read("request", 1).count() == 1
    assert versions.commit({"request": Change(frame(spark, (2, "new"), (3, "c")), "upsert", ("k",))}) == 3
    assert {tuple(r) for r in versions.read("request").collect()} == {(1, "a"), (2, "new"), (3, "c")} and {tuple(r) for r in versions.read("request", 2).collect()} == {(1, "a"), (2, "b")}
    assert versions.commit({"evidence": Change(frame(spark), "replace")}) == 4 and versions.read("evidence").count() == 0 and versions.read("request").count() == 3
    with pytest.raises(ValueError, match="no table"):
        versions.read("nothing")


def test_writers_that_meet(spark, versions, monkeypatch):
    """Another writer publishes between a writer's look and its own publication: both are kept, the upsert is done anew."""
    versions.commit({"t": Change(frame(spark, (1, "a")))})
    publish, met = Versions._publish, []

    def slow(self, manifest):
        if not met:
            met.append(1)
            Versions(spark, versions.root).commit({"t": Change(frame(spark, (2, "b")))})
        return publish(self, manifest)

    monkeypatch.setattr(Versions, "_publish", slow)
    assert versions.commit({"t": Change(frame(spark, (1, "mine"), (2, "mine")), "upsert", ("k",))}) == 3
    assert {tuple(r) for r in versions.read("t").collect()} == {(1, "mine"), (2, "mine")} and versions.numbers() == [1, 2, 3]


def test_only_ranges_that_differ_are_compared(spark):
    table = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    index = table.filter("k NOT IN (5, 77)").withColumn("v", F.when(F.col("k") == 1000, None).otherwise(F.col("v"))).unionByName(frame(spark, (-3, "old"), (99_999, None)))
    found, compared = sync.differences(table, index, ["k"])
    assert {tuple(r) for r in found.collect()} == {(5, "missing"), (77, "missing"), (1000, "changed"), (-3, "stale"), (99_999, "stale")}
    assert compared.first().of_table < 100
    after = sync.mended(table, index, found, ["k"])
    again, compared = sync.differences(table, after, ["k"])
    assert again.count() == 0 and compared.first().of_table == 0 and after.count() == 20_000
    empty = table.limit(0)
    assert sync.differences(empty, empty, ["k"])[0].count() == 0 and sync.differences(table.limit(3), empty, ["k"])[0].count() == 3


def test_many_pages_share_a_partition():
    from groundspark.sources import paged

    assert [list(p.numbers) for p in paged.dealt(1, 3)] == [[1], [2], [3]] and paged.dealt(4, 3) == []
    many = paged.dealt(1, 54_000)
    assert len(many) == 1688 and [n for p in many for n in p.numbers] == list(range(1, 54_001))
    assert [n for p in paged.dealt(8, 206) for n in p.numbers] == list(range(8, 207))
