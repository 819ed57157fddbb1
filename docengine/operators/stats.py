"""Run statistics, learning over runs and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def template_stats(runs: DataFrame) -> DataFrame:
    """AG-1: one row: templates, types, the first most used one, mean success; input (template_id, doc_type, success)."""
    t = runs.groupBy("template_id").agg(F.count("*").alias("used"), F.avg("success").alias("s"), F.first("doc_type").alias("doc_type"))
    return t.agg(F.count("*").alias("templates"), F.max_by("template_id", F.struct("used", -F.col("template_id"))).alias("most_used"), F.avg("s").alias("success"))


def type_counts(runs: DataFrame) -> DataFrame:
    """AG-1, AG-8, AG-10 and AG-13: counts by a type column; a missing type is unknown."""
    return runs.groupBy(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"))


def recent_runs(runs: DataFrame, last: int = 10) -> DataFrame:
    """AG-2: (level, n, seconds, quality, total) over the last runs of each group; input (grp, run_id, level, seconds, quality)."""
    w = Window.partitionBy("grp").orderBy(F.desc("run_id"))
    r = runs.withColumn("r", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("grp")))
    return r.filter(F.col("r") <= last).groupBy("grp").agg(F.max("total").alias("total"), F.count("*").alias("analyzed"), F.avg(F.coalesce("seconds", F.lit(0.0))).alias("seconds"), F.avg(F.coalesce("quality", F.lit(0.0))).alias("quality"), F.count_if(F.col("level") == "purchase").alias("complete"))


def batch_learning(runs: DataFrame, least: float = 0.5) -> DataFrame:
    """AG-4 and AG-5: per template with two confident runs or more: means, fields common to all, hints.

    Input (template_id, run_id, confidence, bbox_accuracy, fields).
    """
    ok = runs.filter(F.col("confidence") > least)
    base = ok.groupBy("template_id").agg(F.count("*").alias("documents"), F.avg("confidence").alias("confidence"), F.avg("bbox_accuracy").alias("bbox_accuracy"), F.count_distinct(F.size("fields")).alias("sizes")).filter("documents >= 2")
    each = ok.select("template_id", "run_id", F.explode(F.array_distinct("fields")).alias("field")).groupBy("template_id", "field").agg(F.count_distinct("run_id").alias("n"))
    common = each.join(base.select("template_id", "documents"), "template_id").filter("n = documents").groupBy("template_id").agg(F.array_sort(F.collect_list("field")).alias("common"))
    hints = F.array_compact(F.array(F.when(F.col("confidence") < 0.6, F.lit("improve patterns")), F.when(F.col("confidence") > 0.8, F.lit("good template")), F.when(F.col("bbox_accuracy") < 0.5, F.lit("improve positions")), F.when(F.col("sizes") > 1, F.lit("field counts differ"))))
    return base.join(common, "template_id", "left").select("template_id", "documents", "confidence", "bbox_accuracy", F.coalesce("common", F.array().cast("array<string>")).alias("common"), hints.alias("hints"))


def method_share(fields: DataFrame) -> DataFrame:
    """AG-9 and AG-11: count and share by method, and whether it infers."""
    g = fields.groupBy("method").agg(F.count("*").alias("n"))
    return g.select("method", "n", (F.col("n") / F.sum("n").over(Window.partitionBy()) * 100).alias("share"), F.col("method").isin("docjson_metadata", "process_flow").alias("inferred"))


def counters(runs: DataFrame) -> DataFrame:
    """AG-3 and AG-7: processed, failed, total and mean seconds by group."""
    return runs.groupBy("grp").agg(F.count_if(F.col("success")).alias("processed"), F.count_if(~F.col("success")).alias("failed"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("average"))
