"""Queries that work on a document's own row: their plans, and their rows on tables with odd keys."""

import duckdb
import pytest

from docengine.plans.catalog import ORACLES, QUERIES

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Orders with ids that occur once, two and three times (of other priorities), and null ids."""
    d = tmp_path_factory.mktemp("odd")
    some = f"SELECT * FROM '{ORDERS}' WHERE o_orderkey < 300"
    again = "SELECT * REPLACE ({} AS o_orderkey, '5-' || o_orderkey AS o_orderpriority) FROM '" + ORDERS + "' WHERE {}"
    duckdb.connect().execute(f"COPY ({some} UNION ALL {again.format('o_orderkey - 300', 'o_orderkey BETWEEN 310 AND 349')} UNION ALL {again.format('o_orderkey - 400', 'o_orderkey BETWEEN 410 AND 429')} UNION ALL {again.format('NULL', 'o_orderkey BETWEEN 500 AND 509')}) TO '{d}/orders.parquet' (FORMAT parquet)")
    return str(d)


def rows_of_both(spark, name, folder):
    df = QUERIES[name](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    return sorted(map(tuple, df.collect())), sorted(duck.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())


def test_annotation_match_shuffles_no_texts(spark):
    plan = plan_of(QUERIES["annotation_match"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and plan.count("Exchange hash") == 1


def test_annotation_match_with_odd_keys(spark, odd):
    own, sql = rows_of_both(spark, "annotation_match", odd)
    assert own == sql and own


def test_bbox_estimate_shuffles_no_texts(spark):
    plan = plan_of(QUERIES["bbox_estimate"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and plan.count("Exchange hash") == 1


def test_bbox_estimate_with_odd_keys(spark, odd):
    own, sql = rows_of_both(spark, "bbox_estimate", odd)
    assert own == sql and own
