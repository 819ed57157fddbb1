"""The nested document form: nesting, flattening, validation, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The block types of the document schema.
BLOCK_TYPES = ["paragraph", "title", "heading", "table", "diagram", "image", "list", "caption", "footnote", "formula"]


def nest(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """SNK-3: (version, doc_id, metadata, sections) from documents (doc_id, title, doc_type) and sessionised blocks."""
    block = F.struct(F.col("block_ord"), F.concat(F.lit("block_"), F.col("block_ord").cast("string")).alias("id"), "type", F.lit(1).alias("page"), F.struct("text").alias("content"))
    sec = sections.groupBy("doc_id", "section_ord").agg(F.first("section_id").alias("id"), F.first("path").alias("path"), F.first("heading").alias("heading"), F.first("level").alias("level"), F.transform(F.array_sort(F.collect_list(block)), lambda b: F.struct(b["id"].alias("id"), b["type"].alias("type"), b["page"].alias("page"), b["content"].alias("content"))).alias("blocks"))
    tree = sec.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "id", "path", "heading", "level", "blocks"))), lambda s: F.struct(s["id"].alias("id"), s["path"].alias("path"), s["heading"].alias("heading"), s["level"].alias("level"), s["blocks"].alias("blocks"))).alias("sections"))
    meta = F.struct("title", "doc_type", F.array(F.lit("ko"), F.lit("en")).alias("language"), F.lit(0).alias("pages"))
    return docs.join(tree, "doc_id", "left").select(F.lit("2.0").alias("version"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"), meta.alias("metadata"), F.coalesce("sections", F.array().cast(tree.schema["sections"].dataType)).alias("sections"))


def flatten(nested: DataFrame) -> DataFrame:
    """SNK-3, the other way: (doc_id, section_ord, block_ord, type, text)."""
    s = nested.select("doc_id", F.posexplode("sections").alias("section_ord", "s"))
    return s.select("doc_id", "section_ord", F.posexplode("s.blocks").alias("block_ord", "b")).select("doc_id", "section_ord", "block_ord", "b.type", "b.content.text")


def is_valid(version: Column, doc_id: Column, title: Column, doc_type: Column, pages: Column, sections: Column) -> Column:
    """JS-1: the document schema as a predicate."""
    block_ok = lambda b: b["id"].isNotNull() & F.coalesce(b["type"].isin(BLOCK_TYPES), F.lit(False)) & F.coalesce(b["page"] >= 1, F.lit(False))
    section_ok = lambda s: s["id"].isNotNull() & s["path"].isNotNull() & s["heading"].isNotNull() & F.coalesce(s["level"] >= 1, F.lit(False)) & s["blocks"].isNotNull() & F.coalesce(F.forall(s["blocks"], block_ok), F.lit(False))
    return F.coalesce(version.rlike(r"^\d+\.\d+$"), F.lit(False)) & doc_id.isNotNull() & title.isNotNull() & doc_type.isNotNull() & (F.coalesce(pages, F.lit(0)) >= 0) & sections.isNotNull() & F.coalesce(F.forall(sections, section_ok), F.lit(False))


def split_valid(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-1: (valid, rejected)."""
    ok = is_valid(F.col("version"), F.col("doc_id"), F.col("metadata.title"), F.col("metadata.doc_type"), F.col("metadata.pages"), F.col("sections"))
    marked = nested.withColumn("_ok", ok)
    return marked.filter("_ok").drop("_ok"), marked.filter("NOT _ok").drop("_ok")


def save(nested: DataFrame, path: str) -> DataFrame:
    """SNK-1: valid documents as JSON lines under ``path``; returns the rejected ones."""
    good, bad = split_valid(nested)
    good.write.mode("overwrite").json(path)
    return bad


def load(spark, path: str, schema) -> DataFrame:
    """SNK-2: valid documents of a folder of JSON lines; broken lines are dropped by validation."""
    return split_valid(spark.read.schema(schema).option("mode", "PERMISSIVE").json(path))[0]
