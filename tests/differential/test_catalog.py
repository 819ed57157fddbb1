"""Every catalogue query against its SQL on another engine, on the smallest tables."""

import math

import duckdb
import pytest

from docengine.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v)
    return "null" if v is None else repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


def test_all_have_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    own = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert own == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
