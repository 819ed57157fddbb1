"""Sinks beside the nested form: templates, annotations, vector exports, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.fields import importance_threshold


def upsert(current: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """SNK-9, SNK-10, CH-16: rows of ``changed`` replace those with their key; a changed row with ``deleted`` set removes it."""
    kept = current.join(changed.select(key), key, "left_anti")
    live = changed.filter(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in changed.columns else changed
    return kept.unionByName(live)


def user_template(fields: DataFrame) -> DataFrame:
    """SNK-15: elements of an element template from annotated fields (name, field_type, importance)."""
    kind = F.when(F.col("field_type").isin("code", "date", "version", "text", "title"), F.lit("fixed")).when(F.col("field_type") == "header", F.lit("structural")).when(F.col("field_type") == "table_cell", F.lit("table")).when(F.col("field_type") == "diagram", F.lit("diagram")).otherwise(F.lit("content"))
    return fields.select("name", kind.alias("element_type"), F.col("importance").isin("critical", "high").alias("required"), importance_threshold(F.col("importance")).alias("confidence_threshold"))


def annotation_summary(fields: DataFrame) -> DataFrame:
    """SNK-14: (doc_id, fields, boxed, critical)."""
    return fields.groupBy("doc_id").agg(F.count("*").alias("fields"), F.count_if(F.col("x1").isNotNull()).alias("boxed"), F.count_if(F.col("importance") == "critical").alias("critical"))


def improvement(confidence: DataFrame, base: float = 0.33) -> DataFrame:
    """SNK-6: change against the stated base confidence, in percent."""
    return confidence.withColumn("improvement", (F.col("confidence") - base) / base * 100)


def write_vectors(chunks: DataFrame, path: str) -> None:
    """SNK-7: one folder a granularity."""
    chunks.write.mode("overwrite").partitionBy("granularity").parquet(path)


def as_xml(docs: DataFrame) -> DataFrame:
    """SNK-11: (doc_id, xml) of flat columns."""
    return docs.select("doc_id", F.to_xml(F.struct(*docs.columns), {"rowTag": "Document"}).alias("xml"))
