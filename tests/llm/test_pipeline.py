"""The pipeline's stages on a small fixture, each against what it states."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from docengine.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        assert got.columns == (columns if k < 4 else [*columns, "shard", "grown_shard"])
        before, after = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in got.select("doc_id").collect()}
        assert after <= before and after
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
            assert len(good - after) <= 0.02 * len(good)
        if name == "near_duplicates":
            assert got.count() == got.select("text").distinct().count()
        docs = got
    assert docs.select("shard").distinct().count() <= 8


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table = "pages" if name.startswith(("op4", "op5")) else "documents"
    if not name.startswith(("op1_", "op9_")):
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert out.count() > 0
