"""Annotations: detection, template matching, extraction, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import fixed
from ..functions import text as T


def metadata_fields(docs: DataFrame) -> DataFrame:
    """PRJ-28: rows for the known metadata keys that have a value, in the keys' order; ``docs`` has a map ``metadata``."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), F.lit(t).alias("field_type"), F.lit(i).alias("importance"), F.element_at("metadata", F.lit(n)).alias("value")) for k, (n, t, i) in enumerate(fixed.METADATA_FIELDS)]))
    return docs.select("doc_id", rows.alias("f")).select("doc_id", F.lit(0).alias("stream"), "f.*").filter(F.coalesce("value", F.lit("")) != "")


def block_fields(blocks: DataFrame) -> DataFrame:
    """PRJ-29: significant blocks as fields, value cut to 100 characters."""
    kind = V.field_type(F.col("text"), F.col("type"))
    return blocks.filter(V.is_significant(F.col("text"))).select("doc_id", F.lit(1).alias("stream"), F.col("block_ord").alias("ord"), V.field_name(F.col("text")).alias("name"), kind.alias("field_type"), V.field_importance(F.col("text"), kind).alias("importance"), F.substring("text", 1, 100).alias("value"))


def edge_fields(items: DataFrame) -> DataFrame:
    """PRJ-30: headers and footers (doc_id, area, ord, text) of more than three characters, numbered within their area."""
    n = F.row_number().over(Window.partitionBy("doc_id", "area").orderBy("ord"))
    kept = items.filter(F.length(T.strip(F.col("text"))) > 3).withColumn("n", n)
    return kept.select("doc_id", F.when(F.col("area") == "header", 2).otherwise(3).alias("stream"), "ord", F.concat_ws("_", "area", "n").alias("name"), F.col("area").alias("field_type"), F.lit("medium").alias("importance"), F.col("text").alias("value"))


def detect_fields(docs: DataFrame, blocks: DataFrame, items: DataFrame) -> DataFrame:
    """PRJ-31: metadata, then blocks, then headers and footers: one stream with ordinals."""
    return metadata_fields(docs).unionByName(block_fields(blocks)).unionByName(edge_fields(items))


def field_scores(text: Column) -> list[Column]:
    """JN-14 by field names: for each field 0.7 if one of its keywords occurs."""
    return [F.when(T.has_any(text, w), F.lit(0.7)).otherwise(F.lit(0.0)) for _, w in fixed.FIELD_KEYWORDS]


def description_score(text: Column, description: Column) -> Column:
    """JN-14 by a description: a numbered item that occurs 0.9, detected text whose first 20 characters occur 0.8."""
    item = T.strip(F.replace(description, F.lit("번호 매겨진 항목: "), F.lit("")))
    auto = T.strip(F.replace(description, F.lit("자동 감지: "), F.lit("")))
    return F.when(description.contains("번호 매겨진 항목:"), F.when(F.contains(text, item), F.lit(0.9)).otherwise(F.lit(0.0))).when(description.contains("자동 감지:") & F.contains(text, F.substring(auto, 1, 20)), F.lit(0.8)).otherwise(F.lit(0.0))


def match_fields(docs: DataFrame) -> DataFrame:
    """JN-14 by field names: (doc_id, field_ord, field, confidence)."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field_ord"), F.lit(n).alias("field"), c.alias("confidence")) for k, ((n, _), c) in enumerate(zip(fixed.FIELD_KEYWORDS, field_scores(F.col("text")), strict=True))]))
    return docs.select("doc_id", rows.alias("f")).select("doc_id", "f.*")


def match_descriptions(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """JN-14 by descriptions: (doc_id, field_ord, confidence) of (field_ord, description)."""
    score = description_score(F.col("text"), F.col("description"))
    return docs.crossJoin(F.broadcast(fields)).select("doc_id", "field_ord", score.alias("confidence"))  # one row a template field


def pattern_bonus(t: Column, headers: list[str], sections: list[str], patterns: list[str]) -> Column:
    """SC-6: 0.3 at most."""
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    bonus = sum([one(t.contains(h), 0.1) for h in headers], F.lit(0.0))
    if sections:
        bonus = bonus + sum([one(t.contains(x), 1.0) for x in sections], F.lit(0.0)) / float(len(sections)) * 0.2
    return F.least(F.lit(0.3), bonus + sum([one(t.rlike(p), 0.1) for p in patterns], F.lit(0.0)))


def match_template(matches: DataFrame, docs: DataFrame, headers: list[str], sections: list[str], patterns: list[str]) -> DataFrame:
    """JN-15 with SC-6: share of fields above 0.5, plus the pattern bonus, one at most."""
    share = matches.groupBy("doc_id").agg((F.sum(F.when(F.col("confidence") > 0.5, 1.0).otherwise(0.0)) / F.count("*")).alias("share"))
    return docs.join(share, "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("share") + pattern_bonus(F.col("text"), headers, sections, patterns)).alias("confidence"))


def match_best_template(docs: DataFrame, templates: list[tuple[list[Column], list[str], list[str], list[str]]], least: float = 0.3, digits: int = 6) -> DataFrame:
    """JN-15 and JN-16 in one pass: (doc_id, template_ord, confidence), the first best template of each document, above the threshold.

    A template is its fields' scores over ``text`` and its headers, sections and patterns. Texts are not shuffled, only counts of
    hits and bonuses; rows of one id share their fields, as in ``match_template``.
    """
    parts = []
    for k, (scores, *rest) in enumerate(templates):
        hits = sum([F.when(c > 0.5, F.lit(1)).otherwise(F.lit(0)) for c in scores], F.lit(0))
        parts += [F.sum(hits).alias(f"_hits{k}"), F.max(pattern_bonus(F.col("text"), *rest)).alias(f"_bonus{k}")]
    sums = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n"), *parts)
    each = [F.struct(F.round(F.least(F.lit(1.0), F.col(f"_hits{k}") / (F.col("_n") * len(scores)) + F.col(f"_bonus{k}")), digits).alias("confidence"), F.lit(-k).alias("ord")) for k, (scores, *_) in enumerate(templates)]
    best = sums.select("doc_id", F.greatest(*each).alias("b") if len(each) > 1 else each[0].alias("b"))
    return best.filter(F.col("b.confidence") > least).select("doc_id", (-F.col("b.ord")).alias("template_ord"), "b.confidence")


def best_template(scores: DataFrame, least: float = 0.3) -> DataFrame:
    """JN-16: the first best template (by ``template_ord``) of each document, above the threshold."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "template_ord"))
    return scores.filter(F.col("confidence") > least).withColumn("_r", rank).filter("_r = 1").drop("_r")


def extract_content(blocks: DataFrame, keywords: DataFrame) -> DataFrame:
    """EX-8: (doc_id, field, content): of the texts after any of a field's keywords (field, keyword_ord, keyword) the first longest."""
    hit = blocks.crossJoin(F.broadcast(keywords)).filter(F.contains(F.lower("text"), F.lower("keyword")))
    after = hit.withColumn("content", T.text_after(T.strip(F.col("text")), F.col("keyword"))).filter("content <> ''")
    return after.groupBy("doc_id", "field").agg(F.max_by("content", F.struct(F.length("content"), -F.col("block_ord"), -F.col("keyword_ord"))).alias("content"))


def field_keywords(name: str, description: str) -> list[str]:
    """EX-9, for a template field (plan time): sorted, distinct, longer than one character."""
    out: list[str] = []
    if name.startswith("항목_"):
        n = name.split("_")[1]
        out += [f"{n}.", n]
    if "제목" in name:
        out += ["제목", "목적", "적용범위", "기준"]
    if description:
        if ":" in description:
            out.append(description.split(":")[1].strip())
        out += [w for w in fixed.TECH_WORDS if w in description]
    return sorted({k for k in out if len(k) > 1})


def validate(fields: DataFrame) -> DataFrame:
    """JS-3: (doc_id, errors, warnings, valid) of (doc_id, field_type, importance, value)."""
    missing = (F.col("importance") == "critical") & F.col("value").isNull()
    number = (F.col("field_type") == "number") & F.col("value").isNotNull() & F.col("value").try_cast("double").isNull()
    date = (F.col("field_type") == "date") & F.col("value").isNotNull() & ~F.col("value").rlike(r"\d")
    return fields.groupBy("doc_id").agg((F.count_if(missing) + F.count_if(number)).alias("errors"), F.count_if(date).alias("warnings")).withColumn("valid", F.col("errors") == 0)
