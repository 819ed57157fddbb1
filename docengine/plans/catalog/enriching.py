"""Back-fills, refinements, patterns, summaries and composite chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as T
from ...operators import blocks as B
from ...operators import enrich as E
from ...operators import matching as M
from ...operators import tables as X
from ..derived import coded_docs, table_rows
from . import sql as S
from .chunks import _DOCS, _docs
from .common import BOXES_SQL, joined, read, typed_blocks
from .matching import _EXACT
from .structure import _SECTIONED, TYPED
from .tables import _R, _STEPS, HEADER, _drawings
from .text import _TOKEN

LEVELS = [r"^\d+\.\s+(.+)", r"^\d+\.\d+\s+(.+)", r"^\d+\.\d+\.\d+\s+(.+)"]
HEADERS = ["1. 적용범위", "목적", "4.1 노황변동의 의미 및 조치"]


def structural_hits(spark, sf_dir):
    return E.structural_hits(coded_docs(spark, sf_dir), LEVELS)


def step_backfill(spark, sf_dir):
    steps = X.process_steps(_drawings(spark, sf_dir))
    missing = coded_docs(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.lit(f"process_flow_step_{k}") for k in (1, 2, 4, 5)])).alias("field"))
    return E.backfill_steps(missing, steps)


def containing_block(spark, sf_dir):
    t = M.exact_fields(coded_docs(spark, sf_dir)).filter("value IS NOT NULL").select("doc_id", "field", "value")
    return E.containing_block(t, typed_blocks(spark, sf_dir).withColumn("x1", F.when(F.col("block_ord") != 0, F.col("x1"))))


def header_reconcile(spark, sf_dir):
    s = B.sessionize(typed_blocks(spark, sf_dir)).groupBy("doc_id", "section_ord").agg(F.first("heading").alias("heading"))
    return E.reconcile_headers(s, HEADERS)


def bbox_refine(spark, sf_dir):
    b = typed_blocks(spark, sf_dir)
    plain = lambda c, v: F.when(F.col("block_ord") % 2 == 0, F.lit(v)).otherwise(F.col(c)).alias(c)
    blocks = b.select("doc_id", "block_ord", "text", plain("x1", 0.0), plain("y1", 0.0), plain("x2", 100.0), plain("y2", 20.0))
    f = b.filter("block_ord IN (2, 4, 7)").select("doc_id", F.col("block_ord").alias("field_ord"), F.substring("text", 1, 9).alias("value"), "x1", "y1", "x2", "y2")
    return E.refine_boxes(blocks, f)


def page_images(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_partkey").alias("k"), "l_returnflag")
    e = li.filter("l_returnflag = 'R'").select("doc_id", "page", F.col("k").alias("element_ord")).distinct()
    i = li.filter("l_returnflag <> 'R'").select("doc_id", "page", F.col("k").alias("image_ord")).distinct()
    return E.images_of_pages(e, i)


def table_positions(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_partkey").alias("k"), "l_returnflag")
    e = li.filter("l_returnflag = 'R'").select("doc_id", "page", F.col("k").alias("element_ord")).distinct()
    t = li.filter("l_returnflag <> 'R'").select("doc_id", "page", F.col("k").alias("table_ord")).distinct()
    return E.pair_by_position(e, t)


def template_apply(spark, sf_dir):
    d = coded_docs(spark, sf_dir)
    fields = d.select("doc_id", F.explode(F.array(F.lit("document_number"), F.lit("author"))).alias("field")).withColumn("bbox", F.concat(F.lit("t:"), "field"))
    found = d.select("doc_id", F.lit("author").alias("field"), F.when(F.col("doc_id") % 3 == 0, F.lit("f")).alias("bbox"))  # null: nothing was found
    return E.apply_template(fields, found, M.exact_fields(d).select("doc_id", "field", F.col("value").alias("content")))


def annotation_types(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    path = F.concat(F.lit("/docs/"), F.element_at(F.array(*map(F.lit, ["작업표준", "절차서", "x", "기술기준"])), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return o.select("o_orderkey", E.annotation_type(path, F.array(F.when(F.col("o_orderkey") % 10 == 2, "기술기준 a").otherwise("b"))).alias("doc_type"))


def suggested_fields(spark, sf_dir):
    d = coded_docs(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 2 == 0, "기술기준").otherwise("일반문서")
    return E.common_fields(d.select("doc_id", kind.alias("doc_type"), T.entities(F.col("text")).alias("entities")))


def mined_patterns(spark, sf_dir):
    b = typed_blocks(spark, sf_dir)
    k = F.col("block_ord")
    f = b.select("doc_id", F.when(k == 2, "항목_1").when(k == 5, "page_header").otherwise("x").alias("name"), F.when(k == 0, "code").when(k == 4, "header").otherwise("text").alias("field_type"), F.when(k == 2, F.concat(F.lit("번호 매겨진 항목: "), "text")).otherwise(F.col("text")).alias("description"))
    m = E.mined_patterns(f)
    return m.select("doc_id", joined(F.col("headers")).alias("headers"), joined(F.col("sections")).alias("sections"), joined(F.col("identifiers")).alias("identifiers"))


def synthesised_patterns(spark, sf_dir):
    b = typed_blocks(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ["code", "date", "version", "title", "text"])), (F.col("block_ord") % 5 + 1).cast("int"))
    return b.select("doc_id", "block_ord", E.synthesised_pattern(F.lit("n"), kind, F.when(F.col("block_ord") != 9, F.col("text"))).alias("pattern"))


def diagram_text(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    e = p.select(F.floor(F.col("p_partkey") / 7).alias("diagram"), F.col("p_partkey").alias("ord"), F.lit("shape").alias("kind"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).otherwise("").alias("text"))
    c = p.filter("p_size % 3 = 0").select(F.floor(F.col("p_partkey") / 7).alias("diagram"), F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return E.diagram_text(e, c)


def enhanced_metadata(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "title", "number", "date", "revision")
    v = M.exact_fields(coded_docs(spark, sf_dir)).select("doc_id", "field", "value").unionByName(d.select("doc_id", F.lit("title").alias("field"), F.substring("title", 1, 8).alias("value")))
    return E.enhanced_metadata(d, v)


def structure_summary(spark, sf_dir):
    return E.structure_summary(B.sessionize(typed_blocks(spark, sf_dir)))


def table_chunks(spark, sf_dir):
    c = E.table_chunks(X.gather_rows(table_rows(spark, sf_dir), HEADER))
    return c.select("doc_id", "chunk_id", F.length("text").cast("long").alias("chars"), joined(F.col("keywords")).alias("keywords"), "confidence")


def process_chunks(spark, sf_dir):
    return E.process_chunks(X.process_steps(_drawings(spark, sf_dir)), "flow")


def metadata_columns(spark, sf_dir):
    d = coded_docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("title")).alias("title"), F.when(F.col("doc_id") % 2 == 0, "w").alias("author"), F.when(F.col("doc_id") % 5 == 0, 7).alias("pages"))
    return E.metadata_columns(d).withColumn("language", joined(F.col("language")))


def raw_document(spark, sf_dir):
    b = B.flatten_blocks(coded_docs(spark, sf_dir))
    cells = table_rows(spark, sf_dir).select("doc_id", (F.col("row_ord") % 2).alias("table_ord"), (F.col("row_ord") - 1).alias("row"), F.lit(0).alias("col"), F.col("c0").alias("text"))
    return E.raw_document(b, cells).select("doc_id", "section_ord", "section_id", "level", "block_ord", "type", "text")


QUERIES = {f.__name__: f for f in (structural_hits, step_backfill, containing_block, header_reconcile, bbox_refine, page_images, table_positions, template_apply, annotation_types, suggested_fields, mined_patterns, synthesised_patterns, diagram_text, enhanced_metadata, structure_summary, table_chunks, process_chunks, metadata_columns, raw_document)}

_BOXED = f"(SELECT doc_id, block_ord, text, {BOXES_SQL} FROM {S.CODED_BLOCKS})"
_LI = "(SELECT DISTINCT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_partkey AS k, l_returnflag = 'R' AS r FROM lineitem)"
_SORTED = lambda c, cond: f"array_to_string(list_sort(list_distinct(coalesce(list({c}) FILTER ({cond}), []))), '|')"
_ENT = S.matches("text", [r"고로\s*\d+호?", r"터빈\s*\d+호?", r"펌프\s*\d+호?", r"밸브\s*\d+", r"[A-Z]{2,}-\d+"])

ORACLES = {
    "structural_hits": f"SELECT doc_id, block_ord::INT AS line_ord, k AS pattern_ord, regexp_extract(text, p, 1) AS value, CASE WHEN regexp_matches(text, '^\\d+\\.\\d+\\.\\d+\\s+') THEN 3 WHEN regexp_matches(text, '^\\d+\\.\\d+\\s+') THEN 2 WHEN regexp_matches(text, '^\\d+\\.\\s+') THEN 1 ELSE 0 END AS level FROM (" + " UNION ALL ".join(f"SELECT doc_id, block_ord, text, {k} AS k, {S.q(p)} AS p FROM {S.CODED_BLOCKS} WHERE {S.rx('text', p)}" for k, p in enumerate(LEVELS)) + ")",
    "step_backfill": f"SELECT doc_id, 'process_flow_step_' || sequence::VARCHAR AS field, trim(marker || ' ' || title) AS value, 0.9::DOUBLE AS confidence FROM {_STEPS} WHERE sequence IN (1, 2, 4, 5)",
    "containing_block": f"SELECT e.doc_id, field, min(block_ord)::INT AS block_ord FROM {_EXACT} e JOIN {S.CODED_BLOCKS} b ON e.doc_id = b.doc_id AND contains(b.text, e.value) WHERE value IS NOT NULL AND block_ord <> 0 GROUP BY 1, 2",
    "header_reconcile": f"SELECT doc_id, section_ord, heading, coalesce({' , '.join(f'CASE WHEN heading = {S.q(h)} THEN {S.q(h)} END' for h in HEADERS)}, CASE WHEN heading <> '' THEN {S.case([(f'contains(heading, {S.q(h)}) OR contains({S.q(h)}, heading)', S.q(h)) for h in HEADERS], 'NULL')} END) AS header FROM (SELECT doc_id, section_ord, arg_min(heading, block_ord) AS heading FROM {_SECTIONED} GROUP BY 1, 2)",
    "bbox_refine": f"WITH b AS MATERIALIZED (SELECT * FROM {_BOXED}), f AS (SELECT doc_id, list({{'o': block_ord, 'v': substr(text, 1, 9), 'a': x1, 'b': y1, 'c': x2, 'd': y2}} ORDER BY block_ord) AS l FROM b WHERE block_ord IN (2, 4, 7) GROUP BY doc_id), m AS (SELECT b.doc_id, b.block_ord, list_filter(l, lambda x: contains(text, x['v']) OR contains(x['v'], text))[1] AS m FROM b JOIN f ON b.doc_id = f.doc_id WHERE b.block_ord % 2 = 0) SELECT b.doc_id, b.block_ord::INT AS block_ord, text, coalesce(m.m.a, CASE WHEN b.block_ord % 2 = 0 THEN 0.0 ELSE x1 END) AS x1, coalesce(m.m.b, CASE WHEN b.block_ord % 2 = 0 THEN 0.0 ELSE y1 END) AS y1, coalesce(m.m.c, CASE WHEN b.block_ord % 2 = 0 THEN 100.0 ELSE x2 END) AS x2, coalesce(m.m.d, CASE WHEN b.block_ord % 2 = 0 THEN 20.0 ELSE y2 END) AS y2 FROM b LEFT JOIN m ON b.doc_id = m.doc_id AND b.block_ord = m.block_ord",
    "page_images": f"SELECT a.doc_id, a.k AS element_ord, b.k AS image_ord FROM {_LI} a JOIN (SELECT DISTINCT doc_id, page, k FROM {_LI} WHERE NOT r) b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.r",
    "table_positions": f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS i FROM {_LI} WHERE r), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS i FROM (SELECT DISTINCT doc_id, page, k FROM {_LI} WHERE NOT r)) SELECT e.doc_id, e.page, e.k AS element_ord, t.k AS table_ord FROM e JOIN t USING (doc_id, page, i)",
    "template_apply": f"SELECT doc_id, field, CASE WHEN field = 'author' AND doc_id % 3 = 0 THEN 'f' ELSE 't:' || field END AS bbox, coalesce(value, '') AS value FROM {_EXACT} WHERE field IN ('document_number', 'author')",
    "annotation_types": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 10 = 2 THEN '기술기준' WHEN o_orderkey % 4 = 0 THEN '작업표준' WHEN o_orderkey % 4 = 1 THEN '절차서' ELSE '일반문서' END AS doc_type FROM orders",
    "suggested_fields": f"WITH e AS (SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN [('문서번호', 'code'), ('개정번호', 'version'), ('발행일자', 'date'), ('페이지', 'text')] ELSE [] END, list_transform(ids, lambda x: (x, 'code'))) AS f FROM (SELECT doc_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS ids FROM (SELECT doc_id, {_ENT} AS c FROM ({S.CODED_SQL})))) SELECT doc_id, (i - 1)::INT AS ord, f[i][1] AS name, f[i][2] AS field_type FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM e)",
    "mined_patterns": f"WITH b AS (SELECT doc_id, block_ord AS k, text FROM {TYPED}) SELECT doc_id, {_SORTED('text', 'k IN (4, 5)')} AS headers, {_SORTED('text', 'k = 2')} AS sections, array_to_string(list_sort(list_distinct(list_concat(['TP-\\d{{3}}-\\d{{3}}-\\d{{3}}'], list(text) FILTER (k = 0)))), '|') AS identifiers FROM b GROUP BY 1",
    "synthesised_patterns": f"SELECT doc_id, block_ord::INT AS block_ord, CASE WHEN block_ord = 9 OR text = '' THEN '.*n.*' WHEN block_ord % 5 = 0 THEN '[A-Z]{{2,4}}-\\d{{3}}-\\d{{3}}-\\d{{3}}' WHEN block_ord % 5 = 1 THEN '\\d{{2,4}}[./-]\\d{{1,2}}[./-]\\d{{1,2}}' WHEN block_ord % 5 = 2 THEN 'Rev\\.?\\s*\\d+' WHEN block_ord % 5 = 3 THEN array_to_string({S.words('text')}[1:3], '.*') ELSE text END AS pattern FROM {S.CODED_BLOCKS}",
    "diagram_text": "WITH e AS (SELECT p_partkey // 7 AS diagram, count(*) AS n, list(p_name ORDER BY p_partkey) FILTER (p_size % 5 <> 0) AS l FROM part GROUP BY 1), c AS (SELECT p_partkey // 7 AS diagram, list('- ' || p_partkey::VARCHAR || ' → ' || (p_partkey + 1)::VARCHAR ORDER BY p_partkey) AS c FROM part WHERE p_size % 3 = 0 GROUP BY 1) SELECT e.diagram, array_to_string(list_concat(list_concat(['Diagram Type: process', 'Elements:'], list_transform(coalesce(l, []), lambda x: '- shape: ' || x)), CASE WHEN c IS NULL THEN [] ELSE list_concat(['Connections:'], c) END), chr(10)) AS text, concat_ws('. ', CASE WHEN len(l) > 0 THEN '주요 단계: ' || array_to_string(l[1:5], ', ') END, CASE WHEN c IS NOT NULL THEN '연결 관계: ' || len(c)::VARCHAR || '개' END, CASE WHEN n = 1 THEN '단일 요소' ELSE '총 ' || n::VARCHAR || '개 요소로 구성된 프로세스 플로우' END) AS description FROM e LEFT JOIN c USING (diagram)",
    "enhanced_metadata": f"WITH v AS (SELECT doc_id, max(value) FILTER (field = 'document_number') AS n, max(value) FILTER (field = 'effective_date') AS e, max(value) FILTER (field = 'revision') AS r FROM {_EXACT} GROUP BY 1) SELECT d.doc_id, CASE WHEN length(substr(title, 1, 8)) > 5 AND length(title) > 8 THEN substr(title, 1, 8) ELSE title END AS title, coalesce(nullif(n, ''), number) AS number, coalesce(nullif(e, ''), date) AS date, coalesce(trim(replace(nullif(r, ''), 'Rev.', '')), revision) AS revision FROM {_DOCS} d LEFT JOIN v USING (doc_id)",
    "structure_summary": f"SELECT doc_id, count(DISTINCT section_ord)::BIGINT AS sections, count(*)::BIGINT AS blocks, count(*) FILTER (type = 'heading')::BIGINT AS headings, max(level) AS deepest FROM {_SECTIONED} GROUP BY 1",
    "table_chunks": f"SELECT doc_id, doc_id::VARCHAR || '_table' AS chunk_id, length(t)::BIGINT AS chars, {S.joined(_TOKEN)} AS keywords, 0.85::DOUBLE AS confidence FROM (SELECT doc_id, '표 헤더: part | qty | flag' || string_agg(chr(10) || '행 ' || row_ord::VARCHAR || ': ' || c0 || ' | ' || c1 || ' | ' || c2, '' ORDER BY row_ord) AS t, 'part qty flag ' || string_agg(c0 || ' ' || c1 || ' ' || c2, ' ' ORDER BY row_ord) AS text FROM {_R} GROUP BY 1)",
    "process_chunks": f"SELECT doc_id, doc_id::VARCHAR || '_process_flow_0' AS chunk_id, '프로세스: flow' || chr(10) || string_agg(marker || ' ' || title || CASE WHEN details <> '' THEN ' (' || details || ')' ELSE '' END, ' → ' ORDER BY sequence) AS text, '프로세스 단계: ' || string_agg(title, ' → ' ORDER BY sequence) AS embedding_text FROM {_STEPS} GROUP BY 1",
    "metadata_columns": f"SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN title ELSE 'Untitled Document' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'w' ELSE 'Unknown' END AS author, CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 0 END AS pages, 'ko|en' AS language FROM ({S.CODED_SQL})",
    "raw_document": f"SELECT doc_id, 0 AS section_ord, 'section_1' AS section_id, 1 AS level, block_ord::INT AS block_ord, 'paragraph' AS type, text FROM {S.CODED_BLOCKS} UNION ALL SELECT doc_id, i::INT, 'table_section_' || (i - 1)::VARCHAR, 2, 0, 'table', 'Table with ' || n::VARCHAR || ' rows' FROM (SELECT doc_id, max(row_ord) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY row_ord % 2) AS i FROM {_R} GROUP BY doc_id, row_ord % 2)",
}
