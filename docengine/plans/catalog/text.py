"""Blocks, sentences, keywords, classes of documents, sections and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fields as V
from ...functions import fixed
from ...functions import text as T
from ...operators import blocks as B
from ..derived import coded_docs
from . import sql as S
from .common import joined, prose_blocks, read, typed_blocks


def flagship(spark, sf_dir):
    """Top 20 token keywords of each source."""
    words = read(spark, sf_dir, "documents").select("source", F.explode(T.token_keywords(F.col("text"))).alias("keyword"))
    counts = words.groupBy("source", "keyword").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "keyword"))
    return counts.withColumn("rank", rank).filter("rank <= 20")


def blocks_flatten(spark, sf_dir):
    return prose_blocks(spark, sf_dir)


def sentence_units(spark, sf_dir):
    u = B.sentence_units(B.flatten_blocks(coded_docs(spark, sf_dir)))
    return u.withColumn("density", F.round("density", 6))


def prose_sentences(spark, sf_dir):
    u = B.sentence_units(prose_blocks(spark, sf_dir))
    return u.groupBy("doc_id").agg(F.count("*").alias("units"), F.round(F.sum("density"), 6).alias("density"), F.sum("importance").alias("importance"))


def doc_keywords(spark, sf_dir):
    b = B.flatten_blocks(coded_docs(spark, sf_dir))
    return b.select("doc_id", "block_ord", joined(T.domain_keywords(F.col("text"))).alias("keywords"))


def doc_entities(spark, sf_dir):
    b = B.flatten_blocks(coded_docs(spark, sf_dir))
    return b.select("doc_id", "block_ord", joined(T.entities(F.col("text"))).alias("entities"), joined(T.cross_references(F.col("text"))).alias("cross_refs"))


def token_keywords(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", joined(T.token_keywords(F.col("text"))).alias("keywords"))


def doc_identifiers(spark, sf_dir):
    return coded_docs(spark, sf_dir).select("doc_id", joined(T.identifiers(F.col("text"))).alias("identifiers"), F.round(T.density(F.col("text")), 6).alias("density"))


def document_terms(spark, sf_dir):
    return coded_docs(spark, sf_dir).select("doc_id", joined(T.document_keywords(F.col("text"))).alias("keywords"), joined(T.document_entities(F.col("text"))).alias("entities"))


def doc_type_infer(spark, sf_dir):
    d = coded_docs(spark, sf_dir)
    name = F.concat(F.when(F.col("doc_id") % 11 == 0, "Tech_Standard_").otherwise("file_"), F.col("doc_id").cast("string"), F.lit(".docx"))
    explicit = F.when(F.col("doc_id") % 101 == 0, "절차서")
    return d.select("doc_id", T.document_type(explicit, F.col("title"), name).alias("doc_type"), T.type_by_identifiers(F.col("text")).alias("by_identifiers"))


def block_classes(spark, sf_dir):
    b, t = typed_blocks(spark, sf_dir), F.col("text")
    return b.select("doc_id", "block_ord", T.section_type(t).alias("section_type"), T.content_type(F.col("type"), t).alias("content_type"), T.is_structural(t).alias("structural"), T.is_heading(t).alias("heading"), T.dotted_level(t).alias("dotted"), F.round(T.block_importance(F.col("type"), t), 6).alias("importance"), V.block_location(F.col("x1"), F.col("y1")).alias("location"))


def field_type_infer(spark, sf_dir):
    b = typed_blocks(spark, sf_dir).filter(V.is_significant(F.col("text")))
    kind = V.field_type(F.col("text"), F.col("type"))
    return b.select("doc_id", "block_ord", kind.alias("field_type"), V.field_importance(F.col("text"), kind).alias("importance"), V.field_name(F.col("text")).alias("name"), F.coalesce(V.validation_rules(kind)["required"], F.lit("")).alias("required"), V.suggested_field(F.col("text")).alias("suggested"))


def value_types(spark, sf_dir):
    v = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("TP-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit("-001-002"))).when(F.col("o_orderkey") % 4 == 1, F.lit("25.07.28")).when(F.col("o_orderkey") % 4 == 2, F.lit("Rev. 10")).otherwise(F.concat(F.lit("조업 기준 "), F.col("o_orderstatus"))).alias("v"), F.concat(F.lower("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, "_title").when(F.col("o_orderkey") % 3 == 1, "_rev").otherwise("")).alias("name"))
    return v.select("o_orderkey", V.value_type(F.col("v")).alias("field_type"), V.name_importance(F.col("name")).alias("importance"))


def content_structure(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.content_structure(F.col("text")).alias("s")).select("doc_id", "s.*")


def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def html_blocks(spark, sf_dir):
    """Each block up to its closing tag, or the next block's tag; inner tags are stripped."""
    marked = F.regexp_replace("html", r"(?i)<(/?)(h1|p|li)(?:\s[^>]*)?>", "\x01$1$2\x02")
    opened = F.filter(F.split(marked, "\x01"), lambda x, i: (i > 0) & ~x.startswith("/"))
    b = read(spark, sf_dir, "pages").select("page_id", F.posexplode(opened).alias("block_ord", "part"))
    tag, text = F.lower(F.substring_index("part", "\x02", 1)), F.expr("substr(part, locate('\x02', part) + 1)")
    kind = F.when(tag == "h1", "heading").when(tag == "li", "list").otherwise("paragraph")
    return b.select("page_id", "block_ord", kind.alias("type"), T.strip_html(text).alias("text"))


def source_files(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/in/"), F.regexp_replace("p_name", " ", "_"), F.element_at(F.array(*map(F.lit, [".docx", ".PDF", ".png", ".pptx", ".txt", ".TIFF"])), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("path"), F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ["KB", "MB", " GB", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("size"))
    return p.select("p_partkey", V.file_type(F.col("path")).alias("file_type"), V.size_bytes(F.col("size")).alias("bytes"), (V.size_bytes(F.col("size")) <= 104857600).alias("valid"))


QUERIES = {f.__name__: f for f in (flagship, blocks_flatten, sentence_units, prose_sentences, doc_keywords, doc_entities, token_keywords, doc_identifiers, document_terms, doc_type_infer, block_classes, field_type_infer, value_types, content_structure, html_strip, html_blocks, source_files)}

_CLASS = S.case([*[(S.has("lower(text)", w), S.q(k)) for k, w in fixed.SENTENCE_CLASSES], (S.rx("text", fixed.DOCUMENT_NUMBER), "'technical_reference'"), (S.rx("text", r"\d+\.\s"), "'numbered_item'")], "'general_statement'")
_WEIGHT = S.case([(f"type = {S.q(k)}", f"{w}::DOUBLE") for k, w in fixed.SENTENCE_WEIGHTS.items()], "1.0::DOUBLE")
_DENSITY = f"CASE WHEN len({S.words('text')}) = 0 THEN 0.0::DOUBLE ELSE least(len({S.ids('text')})::DOUBLE / len({S.words('text')}) * 10, 2.0::DOUBLE) END"


def _units(blocks: str) -> str:
    split = f"list_transform(list_filter(regexp_split_to_array(text, '[.!?]\\s+'), lambda s: length({S.strip('s')}) >= 10), lambda s: {S.strip('s')})"
    return f"(SELECT doc_id, block_ord, unit_ord, text, type, {_WEIGHT} AS importance, {_DENSITY} AS density FROM (SELECT *, {_CLASS} AS type FROM (SELECT doc_id, block_ord, k - 1 AS unit_ord, u[k] AS text FROM (SELECT doc_id, block_ord, u, unnest(range(1, len(u) + 1)) AS k FROM (SELECT doc_id, block_ord, {split} AS u FROM {blocks})))))"


_TOKEN = "list_sort(list_distinct(" + S.matches("text", fixed.TOKENS) + "))"
_DOMAIN = "list_sort(list_distinct(list_concat(list_filter([" + ", ".join(map(S.q, fixed.DOMAIN_KEYWORDS)) + "], lambda k: contains(lower(text), k)), " + S.matches("text", fixed.UNITS) + ")))"
_TYPED = f"(SELECT doc_id, block_ord, text, {S.BLOCK_TYPE} AS type FROM {S.CODED_BLOCKS})"
_BOXED = f"(SELECT *, ((doc_id * 7 + block_ord * 83) % 820)::DOUBLE AS y1, ((doc_id * 3 + block_ord * 11) % 500)::DOUBLE AS x1 FROM {_TYPED})"
_DIGITS = "replace(replace(text, '.', ''), ',', '')"
_FTYPE = S.case([(S.rx("text", fixed.DATE_LIKE), "'date'"), (S.rx("text", fixed.CODE_LIKE), "'code'"), (S.rx(_DIGITS, r"^\d+$"), "'number'"), ("type = 'title' OR contains(lower(text), '제목')", "'title'")], "'text'")
_LEN = f"length({S.strip('text')})"
_SUGGEST = "CASE WHEN contains(t, 'TP-') AND length(t) < 50 THEN '문서번호' WHEN length(t) < 50 AND NOT regexp_matches(t, '^\\d') AND " + S.has("t", ["기준", "표준", "조치", "관리"]) + " THEN '제목' " + " ".join(f"WHEN starts_with(t, '{k}.') THEN '항목_{k}'" for k in range(1, 6)) + " END"

ORACLES = {
    "flagship": f"WITH w AS (SELECT source, unnest({_TOKEN}) AS keyword FROM documents), c AS (SELECT source, keyword, count(*)::BIGINT AS n FROM w GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, keyword)::INT AS rank FROM c) WHERE rank <= 20",
    "blocks_flatten": f"SELECT doc_id, block_ord::INT AS block_ord, text FROM {S.PROSE_BLOCKS}",
    "sentence_units": f"SELECT doc_id, block_ord::INT AS block_ord, unit_ord::INT AS unit_ord, text, type, importance, round(density, 6) AS density FROM {_units(S.CODED_BLOCKS)}",
    "prose_sentences": f"SELECT doc_id, count(*)::BIGINT AS units, round(sum(density), 6) AS density, sum(importance) AS importance FROM {_units(S.PROSE_BLOCKS)} GROUP BY doc_id",
    "doc_keywords": f"SELECT doc_id, block_ord::INT AS block_ord, CASE WHEN {_LEN} < 3 THEN '' ELSE {S.joined(_DOMAIN)} END AS keywords FROM {S.CODED_BLOCKS}",
    "doc_entities": f"SELECT doc_id, block_ord::INT AS block_ord, {S.joined(S.matches('text', fixed.ENTITIES))} AS entities, {S.joined(S.matches('text', fixed.CROSS_REFERENCES, '(?i)'))} AS cross_refs FROM {S.CODED_BLOCKS}",
    "token_keywords": f"SELECT doc_id, {S.joined(_TOKEN)} AS keywords FROM documents",
    "doc_identifiers": f"SELECT doc_id, {S.joined(S.ids('text'))} AS identifiers, round({_DENSITY}, 6) AS density FROM ({S.CODED_SQL})",
    "document_terms": f"SELECT doc_id, array_to_string(list_filter([{', '.join(map(S.q, fixed.DOCUMENT_KEYWORDS))}], lambda k: contains(lower(text), k)), '|') AS keywords, {S.joined('list_sort(list_distinct(' + S.matches('text', fixed.DOCUMENT_ENTITIES) + '))')} AS entities FROM ({S.CODED_SQL})",
    "doc_type_infer": f"SELECT doc_id, coalesce(CASE WHEN doc_id % 101 = 0 THEN '절차서' END, {S.case([*[(S.has('lower(title)', w), S.q(k)) for k, w in fixed.TITLE_TYPES], *[(S.has('f', w), S.q(k)) for k, w in fixed.FILE_TYPES]], S.q(fixed.OTHER_TYPE))}) AS doc_type, {S.case([(S.has('lower(text)', w), S.q(k)) for k, w in fixed.IDENTIFIER_TYPES], S.q(fixed.OTHER_TYPE))} AS by_identifiers FROM (SELECT *, lower(CASE WHEN doc_id % 11 = 0 THEN 'Tech_Standard_' ELSE 'file_' END || doc_id::VARCHAR || '.docx') AS f FROM ({S.CODED_SQL}))",
    "block_classes": f"SELECT doc_id, block_ord::INT AS block_ord, {S.case([(S.has('lower(text)', w), S.q(k)) for k, w in fixed.SECTION_TYPES], S.q('general'))} AS section_type, {S.case([(S.has('lower(text)', fixed.REFERENCE_WORDS), S.q('reference'))], S.q('text'))} AS content_type, {' OR '.join(S.rx('text', p) for p in fixed.STRUCTURAL)} AS structural, length(text) BETWEEN 1 AND 100 AND ({' OR '.join(S.rx('text', p) for p in fixed.HEADINGS)}) AS heading, {S.case([(S.rx('text', r'^\d+\.\d+\.\d+\s+'), '3'), (S.rx('text', r'^\d+\.\d+\s+'), '2'), (S.rx('text', r'^\d+\.\s+'), '1')], '0')} AS dotted, round(CASE WHEN len({S.matches('text', fixed.ENTITIES)}) > 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {_LEN} >= 3 AND len({_DOMAIN}) > 0 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END, 6) AS importance, {S.case([('y1 < 150', S.q('header')), ('y1 > 600', S.q('footer')), ('x1 < 200', S.q('left')), ('x1 > 400', S.q('right'))], S.q('center'))} AS location FROM {_BOXED}",
    "field_type_infer": f"SELECT doc_id, block_ord::INT AS block_ord, field_type, {S.case([(S.has('lower(text)', fixed.CRITICAL_WORDS), S.q('critical')), *[(f'field_type = {S.q(k)}', S.q(v)) for k, v in fixed.TYPE_IMPORTANCE.items()]], S.q('medium'))} AS importance, coalesce(nullif(regexp_replace(regexp_replace(substr({S.strip('text')}, 1, 30), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', '_', 'g'), ''), 'auto_field') AS name, CASE WHEN field_type = 'code' THEN 'true' ELSE 'false' END AS required, {_SUGGEST} AS suggested FROM (SELECT *, {_FTYPE} AS field_type, {S.strip('text')} AS t FROM {_TYPED}) WHERE {_LEN} BETWEEN 3 AND 200 AND regexp_matches(text, '[\\pL\\pN]')",
    "value_types": "WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'code' WHEN o_orderkey % 4 = 1 THEN 'date' WHEN o_orderkey % 4 = 2 THEN 'version' ELSE 'title' END AS field_type, lower(o_orderpriority) || CASE WHEN o_orderkey % 3 = 0 THEN '_title' WHEN o_orderkey % 3 = 1 THEN '_rev' ELSE '' END AS name FROM orders) SELECT o_orderkey, field_type, CASE WHEN contains(name, 'title') OR contains(name, 'date') OR contains(name, 'code') THEN 'critical' WHEN contains(name, 'rev') OR contains(name, 'version') THEN 'high' ELSE 'medium' END AS importance FROM v",
    "content_structure": f"SELECT doc_id, regexp_matches(text, '\\d+\\.') AS has_numbering, regexp_matches(text, '[•\\-\\*]\\s') AS has_bullet_points, len({S.ids('text')}) > 0 AS has_technical_refs, len(regexp_split_to_array(text, '[.!?]'))::BIGINT AS sentence_count, len(string_split(text, chr(10) || chr(10)))::BIGINT AS paragraph_count FROM documents",
    "html_strip": "SELECT page_id, " + S.strip("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')") + " AS text FROM pages",
    "html_blocks": "SELECT page_id, (i - 1)::INT AS block_ord, CASE lower(split_part(p[i], chr(2), 1)) WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list' ELSE 'paragraph' END AS type, " + S.strip("regexp_replace(regexp_replace(substr(p[i], strpos(p[i], chr(2)) + 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')") + r" AS text FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, list_filter(string_split(regexp_replace(html, '(?i)<(/?)(h1|p|li)(?:\s[^>]*)?>', chr(1) || '\1\2' || chr(2), 'g'), chr(1))[2:], lambda x: NOT starts_with(x, '/')) AS p FROM pages))",
    "source_files": "SELECT p_partkey, ['docx', 'pdf', 'image', 'pptx', 'unknown', 'image'][1 + p_partkey % 6] AS file_type, (p_size::DOUBLE * [1024.0, 1048576.0, 1073741824.0, 1.0][1 + p_partkey % 4])::BIGINT AS bytes, (p_size::DOUBLE * [1024.0, 1048576.0, 1073741824.0, 1.0][1 + p_partkey % 4])::BIGINT <= 104857600 AS valid FROM part",
}
