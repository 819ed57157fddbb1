"""Joins and projections that fill in, refine and summarise what matching and parsing found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .tables import table_embedding, table_text

#: Fields that documents of a type have in common: name, field type, importance, description.
COMMON_FIELDS = {"기술기준": [("문서번호", "code", "critical", "기술기준 문서의 고유 번호"), ("개정번호", "version", "high", "문서 개정 정보"), ("발행일자", "date", "high", "문서 발행 날짜"), ("페이지", "text", "medium", "페이지 정보")]}


def structural_hits(docs: DataFrame, patterns: list[str], lines: Column | None = None) -> DataFrame:
    """EX-5: (doc_id, line_ord, pattern_ord, value, level): all hits of all patterns on all lines."""
    each = docs.select("doc_id", F.posexplode(F.split(F.col("text") if lines is None else lines, "\n", -1)).alias("line_ord", "line"))
    hit = F.array(*[F.struct(F.lit(k).alias("pattern_ord"), F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)).alias("value")) for k, p in enumerate(patterns)])
    return each.select("doc_id", "line_ord", "line", F.explode(F.filter(hit, lambda h: h["value"].isNotNull())).alias("h")).select("doc_id", "line_ord", "h.pattern_ord", "h.value", T.dotted_level(F.col("line")).alias("level"))


def backfill_steps(missing: DataFrame, steps: DataFrame) -> DataFrame:
    """JN-11: missing fields ``process_flow_step_n`` from process steps: (doc_id, field, value, confidence)."""
    named = steps.select("doc_id", F.concat(F.lit("process_flow_step_"), F.col("sequence").cast("string")).alias("field"), F.trim(F.concat_ws(" ", "marker", "title")).alias("value"))
    return missing.join(named, ["doc_id", "field"]).select("doc_id", "field", "value", F.lit(0.9).alias("confidence"))


def containing_block(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN-13: (doc_id, field, block_ord): the first block that contains a target's text and has a box."""
    hit = targets.join(blocks.filter("x1 IS NOT NULL"), "doc_id").filter(F.contains("text", F.col("value")))
    return hit.groupBy("doc_id", "field").agg(F.min("block_ord").alias("block_ord"))


def reconcile_headers(sections: DataFrame, headers: list[str]) -> DataFrame:
    """JN-24: (doc_id, section_ord, heading, header): the template header equal to a heading, else the first that contains it or is contained."""
    h = F.col("heading")
    exact = T.first_case([(x, h == x) for x in headers], None)
    near = T.first_case([(x, h.contains(x) | F.contains(F.lit(x), h)) for x in headers], None)
    return sections.select("doc_id", "section_ord", "heading", F.coalesce(exact, F.when(h != "", near)).alias("header"))


def refine_boxes(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """JN-25: blocks that still have the default box take that of the first field whose value contains their text or is contained in it."""
    default = (F.col("x1") == 0) & (F.col("y1") == 0) & (F.col("x2") == 100) & (F.col("y2") == 20)
    f = fields.select(F.col("doc_id").alias("d"), "field_ord", "value", *[F.col(c).alias(f"f{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = blocks.filter(default).join(f, (F.col("doc_id") == F.col("d")) & (F.contains("text", "value") | F.contains("value", "text")))
    best = pairs.groupBy("doc_id", "block_ord").agg(F.min_by(F.struct("fx1", "fy1", "fx2", "fy2"), "field_ord").alias("b"))
    joined = blocks.join(best, ["doc_id", "block_ord"], "left")
    return joined.select("doc_id", "block_ord", "text", *[F.coalesce(F.col(f"b.f{c}"), F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def images_of_pages(elements: DataFrame, images: DataFrame) -> DataFrame:
    """JN-32: every image of the page for every image element: (doc_id, element_ord, image_ord)."""
    return elements.join(images, ["doc_id", "page"]).select("doc_id", "element_ord", "image_ord")


def pair_by_position(elements: DataFrame, tables: DataFrame) -> DataFrame:
    """JN-29: the i-th table of a page with its i-th element: (doc_id, page, element_ord, table_ord)."""
    n = lambda df, c: df.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(c)))
    return n(elements, "element_ord").join(n(tables, "table_ord"), ["doc_id", "page", "i"]).select("doc_id", "page", "element_ord", "table_ord")


def apply_template(fields: DataFrame, suggested: DataFrame, contents: DataFrame) -> DataFrame:
    """JN-35: template fields of a document with the suggested box, else the template's, and the extracted value."""
    s = suggested.select("doc_id", "field", F.col("bbox").alias("found"))
    return fields.join(s, ["doc_id", "field"], "left").join(contents, ["doc_id", "field"], "left").select("doc_id", "field", F.coalesce("found", "bbox").alias("bbox"), F.coalesce("content", F.lit("")).alias("value"))


def annotation_type(path: Column, descriptions: Column) -> Column:
    """PRJ-6."""
    low = F.lower(path)
    return F.when(low.contains("기술기준") | F.exists(descriptions, lambda d: d.contains("기술기준")), F.lit("기술기준")).when(low.contains("작업표준"), F.lit("작업표준")).when(low.contains("절차서"), F.lit("절차서")).otherwise(F.lit(fixed.OTHER_TYPE))


def common_fields(docs: DataFrame) -> DataFrame:
    """PRJ-22 and PRJ-32: common fields of each document's type, and a code field for each entity: (doc_id, ord, name, field_type)."""
    rows = [F.when(F.col("doc_type") == t, F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("field_type")) for n, k, _, _ in f])) for t, f in COMMON_FIELDS.items()]
    known = F.coalesce(*rows, F.array().cast("array<struct<name:string,field_type:string>>"))
    found = F.transform(F.array_distinct("entities"), lambda e: F.struct(e.alias("name"), F.lit("code").alias("field_type")))
    return docs.select("doc_id", F.posexplode(F.concat(known, found)).alias("ord", "f")).select("doc_id", "ord", "f.*")


def mined_patterns(fields: DataFrame) -> DataFrame:
    """EX-10 and CH-15: (doc_id, headers, sections, identifiers) of annotated fields (name, field_type, description)."""
    d = F.col("description")
    arr = lambda c: F.array_sort(F.array_distinct(F.collect_list(c)))
    head = F.when(((F.col("field_type") == "header") | F.lower("name").contains("header")) & (d != ""), d)
    sec = F.when((F.col("name").contains("항목") | (F.col("field_type") == "title")) & d.contains("번호 매겨진 항목:"), F.replace(d, F.lit("번호 매겨진 항목: "), F.lit("")))
    code = F.col("field_type") == "code"
    ids = F.array_union(arr(F.when(code & d.contains("TP-"), F.lit(r"TP-\d{3}-\d{3}-\d{3}"))), arr(F.when(code, d)))
    return fields.groupBy("doc_id").agg(arr(head).alias("headers"), arr(sec).alias("sections"), F.array_sort(ids).alias("identifiers"))


def synthesised_pattern(name: Column, kind: Column, value: Column) -> Column:
    """EX-11: a pattern for a field: by type, else from the first three words of the value, else from the name."""
    words = F.slice(T.tokens(value), 1, 3)
    given = F.coalesce(value, F.lit("")) != ""
    return F.when(~given, F.concat(F.lit(".*"), name, F.lit(".*"))).when(kind == "code", F.lit(r"[A-Z]{2,4}-\d{3}-\d{3}-\d{3}")).when(kind == "date", F.lit(r"\d{2,4}[./-]\d{1,2}[./-]\d{1,2}")).when(kind == "version", F.lit(r"Rev\.?\s*\d+")).when(kind == "title", F.array_join(words, ".*")).otherwise(value)


def diagram_text(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """EX-19 and EX-20: (diagram, text, description) of elements (diagram, ord, kind, text) and edges (diagram, a, b)."""
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("ord", F.concat(F.lit("- "), "kind", F.lit(": "), "text").alias("t"), "text")))), lambda x: x)
    e = elements.groupBy("diagram").agg(lines.alias("l"), F.count("*").alias("n"))
    c = edges.groupBy("diagram").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("c"))
    j = e.join(c, "diagram", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    links = F.transform("c", lambda x: F.concat(F.lit("- "), x["a"].cast("string"), F.lit(" → "), x["b"].cast("string")))
    text = F.array_join(F.concat(F.array(F.lit("Diagram Type: process"), F.lit("Elements:")), F.transform("l", lambda x: x["t"]), F.when(F.size("c") > 0, F.concat(F.array(F.lit("Connections:")), links)).otherwise(F.array().cast("array<string>"))), "\n")
    labels = F.slice(F.transform("l", lambda x: x["text"]), 1, 5)
    said = F.concat_ws(". ", F.when(F.size("l") > 0, F.concat(F.lit("주요 단계: "), F.array_join(labels, ", "))), F.when(F.size("c") > 0, F.concat(F.lit("연결 관계: "), F.size("c").cast("string"), F.lit("개"))), F.when(F.col("n") == 1, F.lit("단일 요소")).otherwise(F.concat(F.lit("총 "), F.col("n").cast("string"), F.lit("개 요소로 구성된 프로세스 플로우"))))
    return j.select("diagram", text.alias("text"), said.alias("description"))


def enhanced_metadata(docs: DataFrame, values: DataFrame) -> DataFrame:
    """EX-21 and EX-22: metadata columns overwritten by truthy matched values; the title only by a shorter one of more than five characters."""
    wide = values.groupBy("doc_id").pivot("field", ["document_number", "effective_date", "revision", "title"]).agg(F.first("value"))
    j = docs.join(wide.select("doc_id", *[F.nullif(c, F.lit("")).alias(f"new_{c}") for c in ("document_number", "effective_date", "revision", "title")]), "doc_id", "left")
    title = F.when((F.length("new_title") > 5) & (F.length("new_title") < F.length("title")), F.col("new_title")).otherwise(F.col("title"))
    return j.select("doc_id", title.alias("title"), F.coalesce("new_document_number", "number").alias("number"), F.coalesce("new_effective_date", "date").alias("date"), F.coalesce(F.trim(F.replace("new_revision", F.lit("Rev."), F.lit(""))), "revision").alias("revision"))


def structure_summary(sections: DataFrame) -> DataFrame:
    """AG-14 and AG-15: (doc_id, sections, blocks, headings, deepest)."""
    return sections.groupBy("doc_id").agg(F.count_distinct("section_ord").alias("sections"), F.count("*").alias("blocks"), F.count_if(F.col("type") == "heading").alias("headings"), F.max("level").alias("deepest"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """CH-5: (doc_id, chunk_id, text, embedding_text, keywords, confidence) of (doc_id, rows)."""
    cells = F.array_join(F.flatten("rows"), " ")
    return tables.filter(F.size("rows") > 0).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_table")).alias("chunk_id"), table_text(F.col("rows")).alias("text"), table_embedding(F.col("rows")).alias("embedding_text"), T.token_keywords(cells).alias("keywords"), F.lit(0.85).alias("confidence"))


def process_chunks(steps: DataFrame, name: str) -> DataFrame:
    """CH-6 and TX-8: (doc_id, chunk_id, text, embedding_text) of process steps."""
    full = F.concat("marker", F.lit(" "), "title", F.when(F.col("details") != "", F.concat(F.lit(" ("), "details", F.lit(")"))).otherwise(""))
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("sequence", c.alias("t")))), lambda x: x["t"])
    return steps.groupBy("doc_id").agg(F.array_join(order(full), " → ").alias("flow"), F.array_join(order(F.col("title")), " → ").alias("titles")).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_process_flow_0")).alias("chunk_id"), F.concat(F.lit(f"프로세스: {name}\n"), "flow").alias("text"), F.concat(F.lit("프로세스 단계: "), "titles").alias("embedding_text"))


def metadata_columns(docs: DataFrame) -> DataFrame:
    """PRJ-4: metadata with its defaults."""
    return docs.select("doc_id", F.coalesce("title", F.lit("Untitled Document")).alias("title"), F.coalesce("author", F.lit("Unknown")).alias("author"), F.coalesce("pages", F.lit(0)).alias("pages"), F.array(F.lit("ko"), F.lit("en")).alias("language"))


def raw_document(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """SRC-17, SRC-18 and EX-23: parsed rows as sessionised blocks: one section of all paragraphs, and one of level 2 for each table.

    ``paragraphs``: (doc_id, block_ord, text); ``cells``: (doc_id, table_ord, row, col, text).
    """
    p = paragraphs.select("doc_id", F.lit(0).alias("section_ord"), F.lit("section_1").alias("section_id"), F.lit("Document Content").alias("heading"), F.lit(1).alias("level"), F.array(F.lit("1")).alias("path"), "block_ord", F.lit("paragraph").alias("type"), "text")
    n = cells.groupBy("doc_id", "table_ord").agg((F.max("row") + 1).alias("rows"))
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_ord"))
    t = n.withColumn("i", i).select("doc_id", F.col("i").alias("section_ord"), F.format_string("table_section_%d", F.col("i") - 1).alias("section_id"), F.concat(F.lit("Table "), F.col("i").cast("string")).alias("heading"), F.lit(2).alias("level"), F.array((F.col("i") + 1).cast("string")).alias("path"), F.lit(0).alias("block_ord"), F.lit("table").alias("type"), F.concat(F.lit("Table with "), F.col("rows").cast("string"), F.lit(" rows")).alias("text"))
    return p.unionByName(t)
