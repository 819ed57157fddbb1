"""Annotation detection, matching, extraction and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed
from ...operators import annotations as A
from ..derived import coded_docs
from . import sql as S
from .common import typed_blocks
from .structure import TYPED
from .text import _FTYPE, _LEN, _TYPED

HEADERS, SECTIONS, PATTERNS = ["문서번호", "기준"], ["1. 적용범위", "2. 목적", "9. 없음"], [r"TP-\d{3}-\d{3}-\d{3}", r"WS-\d{3}"]
FIELDS = [("항목_1", "번호 매겨진 항목: 1. 적용범위"), ("항목_2", "번호 매겨진 항목: 2. 목적 purpose"), ("제목_또는_주요내용", "자동 감지: 고로 노황변동 조치 기준"), ("작성자", "")]
KEYWORDS = [(n, k, w) for n, d in FIELDS for k, w in enumerate(A.field_keywords(n, d))]


def annotation_fields(spark, sf_dir):
    return A.match_fields(coded_docs(spark, sf_dir))


def _described(spark, sf_dir):
    fields = spark.createDataFrame([(k, d) for k, (_, d) in enumerate(FIELDS)], "field_ord int, description string")
    return A.match_descriptions(fields, coded_docs(spark, sf_dir))


def annotation_descriptions(spark, sf_dir):
    return _described(spark, sf_dir)


def annotation_match(spark, sf_dir):
    t = F.col("text")
    described = [A.description_score(t, F.lit(d)) for _, d in FIELDS]
    return A.match_best_template(coded_docs(spark, sf_dir), [(A.field_scores(t), HEADERS, SECTIONS, PATTERNS), (described, [], [], PATTERNS)], 0.5)


def field_content(spark, sf_dir):
    return A.extract_content(typed_blocks(spark, sf_dir), spark.createDataFrame(KEYWORDS, "field string, keyword_ord int, keyword string"))


def auto_detect_fields(spark, sf_dir):
    b = typed_blocks(spark, sf_dir)
    meta = coded_docs(spark, sf_dir).select("doc_id", F.create_map(F.lit("title"), "title", F.lit("author"), F.when(F.col("doc_id") % 2 == 0, "writer"), F.lit("revision"), F.lit("3"), F.lit("other"), F.lit("x")).alias("metadata"))
    items = b.filter("block_ord IN (0, 10)").select("doc_id", F.when(F.col("block_ord") == 0, "header").otherwise("footer").alias("area"), F.col("block_ord").alias("ord"), "text")
    return A.detect_fields(meta, b, items)


def annotation_validate(spark, sf_dir):
    b = A.block_fields(typed_blocks(spark, sf_dir))
    drop = F.col("ord") % 4 == 1
    return A.validate(b.select("doc_id", F.when(F.col("ord") == 3, "number").otherwise(F.col("field_type")).alias("field_type"), "importance", F.when(~drop, F.col("value")).alias("value")))


QUERIES = {f.__name__: f for f in (annotation_fields, annotation_descriptions, annotation_match, field_content, auto_detect_fields, annotation_validate)}

_MATCHED = "(" + " UNION ALL ".join(f"SELECT doc_id, {k} AS field_ord, {S.q(n)} AS field, CASE WHEN {S.has('text', w)} THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM ({S.CODED_SQL})" for k, (n, w) in enumerate(fixed.FIELD_KEYWORDS)) + ")"
_DESCRIBED = "(" + " UNION ALL ".join(f"SELECT doc_id, {k} AS field_ord, CASE WHEN {'contains(text, ' + S.q(d.split(': ')[1]) + ')' if '번호' in d else 'contains(text, ' + S.q(d.split(': ')[1][:20]) + ')' if d else 'false'} THEN {0.9 if '번호' in d else 0.8}::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM ({S.CODED_SQL})" for k, (_, d) in enumerate(FIELDS)) + ")"
_ONE = lambda c, w: f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END"
_BONUS_A = "least(0.3::DOUBLE, " + " + ".join([_ONE(f"contains(text, {S.q(h)})", 0.1) for h in HEADERS] + ["(" + " + ".join(_ONE(f"contains(text, {S.q(x)})", 1.0) for x in SECTIONS) + ") / 3.0::DOUBLE * 0.2::DOUBLE"] + [_ONE(S.rx("text", p), 0.1) for p in PATTERNS]) + ")"
_BONUS_B = "least(0.3::DOUBLE, " + " + ".join(_ONE(S.rx("text", p), 0.1) for p in PATTERNS) + ")"
_SHARE = "(SELECT doc_id, sum(CASE WHEN confidence > 0.5 THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS share FROM {} GROUP BY 1)"
_AFTER = "substr(" + S.strip("string_split(replace(replace(" + S.strip("substr(t, strpos(lower(t), lower(keyword)) + length(keyword))") + ", '.', '.' || chr(10)), '다.', '다.' || chr(10)), chr(10))[1]") + ", 1, 150)"
_KEYS = "(VALUES " + ", ".join(f"({S.q(n)}, {k}, {S.q(w)})" for n, k, w in KEYWORDS) + ") AS k(field, keyword_ord, keyword)"
_IMP = S.case([(S.has("lower(text)", fixed.CRITICAL_WORDS), "'critical'"), *[(f"field_type = {S.q(k)}", S.q(v)) for k, v in fixed.TYPE_IMPORTANCE.items()]], "'medium'")
_NAME = f"coalesce(nullif(regexp_replace(regexp_replace(substr({S.strip('text')}, 1, 30), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', '_', 'g'), ''), 'auto_field')"
_BLOCK_FIELDS = f"(SELECT doc_id, 1 AS stream, block_ord::INT AS ord, {_NAME} AS name, field_type, {_IMP} AS importance, substr(text, 1, 100) AS value FROM (SELECT *, {_FTYPE} AS field_type FROM {_TYPED}) WHERE {_LEN} BETWEEN 3 AND 200 AND regexp_matches(text, '[\\pL\\pN]'))"

ORACLES = {
    "annotation_fields": f"SELECT * FROM {_MATCHED}",
    "annotation_descriptions": f"SELECT * FROM {_DESCRIBED}",
    "annotation_match": f"WITH s AS (SELECT d.doc_id, 0 AS template_ord, round(least(1.0::DOUBLE, share + {_BONUS_A}), 6) AS confidence FROM ({S.CODED_SQL}) d JOIN {_SHARE.format(_MATCHED)} USING (doc_id) UNION ALL SELECT d.doc_id, 1, round(least(1.0::DOUBLE, share + {_BONUS_B}), 6) FROM ({S.CODED_SQL}) d JOIN {_SHARE.format(_DESCRIBED)} USING (doc_id)) SELECT doc_id, template_ord, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, template_ord) AS r FROM s WHERE confidence > 0.5) WHERE r = 1",
    "field_content": f"SELECT doc_id, field, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY length(content) DESC, block_ord, keyword_ord) AS r FROM (SELECT doc_id, field, block_ord, keyword_ord, {_AFTER} AS content FROM (SELECT *, {S.strip('text')} AS t FROM {TYPED} CROSS JOIN {_KEYS}) WHERE contains(lower(text), lower(keyword))) WHERE content <> '') WHERE r = 1",
    "auto_detect_fields": f"SELECT * FROM {_BLOCK_FIELDS} UNION ALL SELECT doc_id, 0, 0, 'title', 'title', 'critical', title FROM ({S.CODED_SQL}) UNION ALL SELECT doc_id, 0, 3, 'author', 'text', 'medium', 'writer' FROM ({S.CODED_SQL}) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, 5, 'revision', 'version', 'medium', '3' FROM ({S.CODED_SQL}) UNION ALL SELECT doc_id, CASE WHEN block_ord = 0 THEN 2 ELSE 3 END, block_ord::INT, CASE WHEN block_ord = 0 THEN 'header_1' ELSE 'footer_1' END, CASE WHEN block_ord = 0 THEN 'header' ELSE 'footer' END, 'medium', text FROM {S.CODED_BLOCKS} WHERE block_ord IN (0, 10) AND {_LEN} > 3",
    "annotation_validate": f"WITH f AS (SELECT doc_id, CASE WHEN ord = 3 THEN 'number' ELSE field_type END AS field_type, importance, CASE WHEN ord % 4 = 1 THEN NULL ELSE value END AS value FROM {_BLOCK_FIELDS}), e AS (SELECT doc_id, count(*) FILTER ((importance = 'critical' AND value IS NULL)) + count(*) FILTER (field_type = 'number' AND value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL) AS errors, count(*) FILTER (field_type = 'date' AND value IS NOT NULL AND NOT regexp_matches(value, '\\d')) AS warnings FROM f GROUP BY 1) SELECT doc_id, errors::BIGINT AS errors, warnings::BIGINT AS warnings, errors = 0 AS valid FROM e",
}
