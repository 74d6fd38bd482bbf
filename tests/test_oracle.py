"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from groundspark.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, con, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    said = con.execute(ORACLE[name])
    names = [c[0] for c in said.description]
    assert columns == sorted(names)
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in said.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == theirs


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
