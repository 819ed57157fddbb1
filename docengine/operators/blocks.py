"""Blocks, sections and their neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def flatten_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_ord, text): one block a line, from 0. A null text has no blocks."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("block_ord", "text"))


def sentence_units(blocks: DataFrame) -> DataFrame:
    """TX-9 with PRJ-9, SC-13 and SC-14: (doc_id, block_ord, unit_ord, text, type, importance, density)."""
    units = blocks.select("doc_id", "block_ord", F.posexplode(T.sentences(F.col("text"))).alias("unit_ord", "text"))
    kind = T.sentence_class(F.col("text"))
    return units.withColumn("type", kind).withColumn("importance", T.class_weight(F.col("type"))).withColumn("density", T.density(F.col("text")))


def sessionize(blocks: DataFrame, starts: str = "type IN ('title', 'heading')") -> DataFrame:
    """WN-3: blocks with ``section_ord`` (from 0), ``section_id``, ``heading``, ``level`` and ``path``.

    A starting block opens a section; blocks before the first one form an implicit section. Partitioned by document.
    """
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    opened = blocks.withColumn("_start", F.expr(starts)).withColumn("_n", F.sum(F.when(F.col("_start"), 1).otherwise(0)).over(order))
    lead = F.min(F.when(F.col("_n") == 0, 0)).over(Window.partitionBy("doc_id"))  # 0 if there are blocks before the first heading
    opened = opened.withColumn("section_ord", F.when(lead.isNotNull(), F.col("_n")).otherwise(F.col("_n") - 1).cast("int"))
    head = Window.partitionBy("doc_id", "section_ord").orderBy("block_ord")
    first = lambda c: F.first(c).over(head)
    own = opened.withColumn("_title", first(F.when(F.col("_start"), F.col("text")))).withColumn("_kind", first(F.when(F.col("_start"), F.col("type"))))
    implicit = F.col("_n") == 0
    return (
        own.withColumn("section_id", F.format_string("section_%03d", F.col("section_ord")))
        .withColumn("heading", F.when(implicit, F.lit("서론")).otherwise(F.col("_title")))
        .withColumn("level", F.when(implicit, F.lit(1)).otherwise(T.heading_level(F.col("_title"), F.col("_kind"))))
        .withColumn("path", F.when(implicit, F.array(F.lit("0"))).otherwise(T.section_path(F.col("_title"), F.col("section_ord"))))
        .drop("_start", "_n", "_title", "_kind")
    )


def sessionize_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """WN-4: (doc_id, section_ord, title, level, body): a heading is a styled or numbered paragraph and isn't in its own body."""
    low = F.lower(F.coalesce("style", F.lit("")))
    heads = T.has_any(low, ["heading", "제목", "title"]) | T.is_heading(F.col("text"))
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    made = paragraphs.withColumn("_head", heads).withColumn("section_ord", F.sum(F.when(F.col("_head"), 1).otherwise(0)).over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("block_ord", "text")))), lambda x: x["text"]), "\n")
    return made.groupBy("doc_id", "section_ord").agg(F.max(F.when(F.col("_head"), F.col("text"))).alias("title"), F.coalesce(F.max(F.when(F.col("_head"), T.style_level(F.col("style")))), F.lit(1)).alias("level"), body.alias("body")).withColumn("section_ord", F.col("section_ord").cast("int"))


def numbered_sections(blocks: DataFrame) -> DataFrame:
    """WN-9: (doc_id, block_ord, number, title, level)."""
    t = T.strip(F.col("text"))
    number = F.regexp_extract(t, fixed.NUMBERED, 1)
    return blocks.filter(t.rlike(fixed.NUMBERED)).select("doc_id", "block_ord", number.alias("number"), F.regexp_extract(t, fixed.NUMBERED, 2).alias("title"), F.size(F.split(number, r"\.")).alias("level"))


def block_context(blocks: DataFrame, by: tuple[str, ...] = ("doc_id", "section_ord")) -> DataFrame:
    """WN-1 and WN-2: shortened neighbours within the section, empty at its ends."""
    w = Window.partitionBy(*by).orderBy("block_ord")
    return blocks.withColumn("prev_block", F.coalesce(T.shorten(F.lag("text").over(w)), F.lit(""))).withColumn("next_block", F.coalesce(T.shorten(F.lead("text").over(w)), F.lit("")))


def collect_text(blocks: DataFrame, separator: str = " ") -> DataFrame:
    """AG-12: (doc_id, text), blocks in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda x: x["text"])
    return blocks.groupBy("doc_id").agg(F.array_join(parts, separator).alias("text"))


def key_concepts(chunks: DataFrame, by: str = "doc_id", most: int = 20) -> DataFrame:
    """AG-6: the most frequent identifiers of each group; ties go to the one that comes first."""
    each = chunks.select(by, "ord", F.posexplode(T.identifiers(F.col("text"))).alias("pos", "concept"))
    counts = each.groupBy(by, "concept").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).select(by, "rank", "concept", "n")


def title_of(blocks: DataFrame) -> DataFrame:
    """EX-3: the first paragraph that can be a title: (doc_id, title)."""
    t = F.col("text")
    fits = ~t.contains("적용범위") & ~t.rlike(r"^\d+\.") & (F.length(t) > 5) & ~t.rlike(r"TP-\d{3}") & ~t.rlike(r"\d{2}\.\d{2}\.\d{2}")
    return blocks.filter(fits).groupBy("doc_id").agg(T.strip(F.min_by("text", "block_ord")).alias("title"))
