"""SRC-38 and SRC-39: template definitions from JSON files, as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "template_id string, name string, description string, document_type string, version string, elements array<struct<name:string, element_type:string, extraction_method:string, patterns:array<string>, required:boolean, confidence_threshold:double>>"


def read_templates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, elements, patterns), with ordinals; files without an id are dropped, other keys ignored."""
    t = spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).filter("template_id IS NOT NULL")
    e = t.select("template_id", F.posexplode("elements").alias("element_ord", "e")).select("template_id", "element_ord", "e.*")
    p = e.select("template_id", "element_ord", F.posexplode("patterns").alias("pattern_ord", "pattern"))
    return t.drop("elements"), e.drop("patterns"), p


def as_template(spark: SparkSession, path: str, template_id: str) -> tuple[str, list[tuple[str, str, str, bool, list[str]]]]:
    """One template as the plan-time form that matching unrolls; templates are small by nature."""
    rows = spark.read.schema(SCHEMA).option("multiLine", "true").json(path).filter(F.col("template_id") == template_id).limit(1).collect()
    if not rows:
        raise ValueError(f"no template {template_id}")
    return template_id, [(e["name"], e["element_type"], e["extraction_method"], bool(e["required"]), list(e["patterns"] or [])) for e in rows[0]["elements"]]
