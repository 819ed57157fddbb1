"""Inputs that several families share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.blocks import flatten_blocks
from ..derived import coded_docs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(c: Column) -> Column:
    """Arrays as text, so that engines compare alike."""
    return F.array_join(c, "|")


def prose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_blocks(read(spark, sf_dir, "documents"))


def typed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of coded documents with a type and a box."""
    b = flatten_blocks(coded_docs(spark, sf_dir))
    t = F.col("text")
    heading = t.rlike(r"^\d+\.\s+") | t.rlike(r"^\d+(\.\d+)+\s+") | t.rlike(r"^[가-힣]\.\s+")
    kind = F.when(F.col("block_ord") == 1, "title").when(heading, "heading").otherwise("paragraph")
    y1 = ((F.col("doc_id") * 7 + F.col("block_ord") * 83) % 820).cast("double")
    x1 = ((F.col("doc_id") * 3 + F.col("block_ord") * 11) % 500).cast("double")
    height = (12 + (F.col("doc_id") + F.col("block_ord") * 5) % 30).cast("double")
    return b.withColumn("type", kind).withColumn("x1", x1).withColumn("y1", y1).withColumn("x2", x1 + F.length(t) * 4.0).withColumn("y2", y1 + height)


BOXES_SQL = "((doc_id * 7 + block_ord * 83) % 820)::DOUBLE AS y1, ((doc_id * 3 + block_ord * 11) % 500)::DOUBLE AS x1, ((doc_id * 3 + block_ord * 11) % 500)::DOUBLE + length(text) * 4.0::DOUBLE AS x2, ((doc_id * 7 + block_ord * 83) % 820)::DOUBLE + (12 + (doc_id + block_ord * 5) % 30)::DOUBLE AS y2"
