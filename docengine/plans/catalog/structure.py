"""Sections, headings, neighbourhood, header fields, summaries and recognition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import fields as V
from ...functions import text as T
from ...operators import blocks as B
from ..derived import coded_docs
from . import sql as S
from .common import joined, read, typed_blocks


def header_fields(spark, sf_dir):
    t = F.col("text")
    return coded_docs(spark, sf_dir).select("doc_id", V.document_number(t).alias("number"), V.revision(t).alias("revision"), V.effective_date(t).alias("effective_date"))


def sections_sessionize(spark, sf_dir):
    return B.sessionize(typed_blocks(spark, sf_dir)).select("doc_id", "block_ord", "section_ord", "section_id", "heading", "level", joined(F.col("path")).alias("path"))


def conversation_sections(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_ord"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("type"), "text")
    s = B.sessionize(turns)
    return s.groupBy("doc_id", "section_ord").agg(F.count("*").alias("blocks"), F.max("level").alias("level"), F.max(F.length("heading")).cast("long").alias("heading_chars"))


def paragraph_sections(spark, sf_dir):
    b = typed_blocks(spark, sf_dir).select("doc_id", "block_ord", "text", F.when(F.col("type") == "title", "Heading 1").when(F.col("block_ord") == 6, "제목 2").alias("style"))
    return B.sessionize_paragraphs(b)


def numbered_sections(spark, sf_dir):
    return B.numbered_sections(typed_blocks(spark, sf_dir)).select("doc_id", "block_ord", "number", "title", "level")


def block_context(spark, sf_dir):
    return B.block_context(B.sessionize(typed_blocks(spark, sf_dir))).select("doc_id", "block_ord", "prev_block", "next_block")


def turn_context(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_ord"), "text")
    return B.block_context(turns, ("doc_id",)).select("doc_id", "block_ord", "prev_block", "next_block")


def collect_text(spark, sf_dir):
    return B.collect_text(typed_blocks(spark, sf_dir).filter("type <> 'heading'"), " ")


def key_concepts(spark, sf_dir):
    chunks = coded_docs(spark, sf_dir).select((F.col("doc_id") % 20).alias("grp"), F.col("doc_id").alias("ord"), "text")
    return B.key_concepts(chunks, "grp")


def document_titles(spark, sf_dir):
    return B.title_of(typed_blocks(spark, sf_dir))


def doc_summary_topk(spark, sf_dir):
    """WN-10: the five most important of the document chunk and its section chunks, as one text."""
    b = B.sessionize(typed_blocks(spark, sf_dir))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda x: x["text"]), "\n")
    sec = b.groupBy("doc_id", "section_ord").agg(F.first("heading").alias("heading"), body.alias("text"))
    sec = sec.withColumn("importance", T.section_importance(F.col("heading"), F.concat(F.lit("섹션: "), "heading", F.lit("\n\n"), "text"))).select("doc_id", (F.col("section_ord") + 1).alias("ord"), "importance", F.concat("heading", F.lit(" 섹션")).alias("part"))
    doc = coded_docs(spark, sf_dir).select("doc_id", F.lit(0).alias("ord"), F.lit(3.0).alias("importance"), F.concat(F.lit("문서제목: "), "title").alias("part"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("importance"), "ord"))
    top = doc.unionByName(sec).withColumn("r", rank).filter("r <= 5")
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "part"))), lambda x: x["part"]), ". ").alias("summary"))


def section_scores(spark, sf_dir):
    """SC-11 for every section."""
    b = B.sessionize(typed_blocks(spark, sf_dir))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda x: x["text"]), "\n")
    sec = b.groupBy("doc_id", "section_ord").agg(F.first("heading").alias("heading"), body.alias("text"))
    return sec.select("doc_id", "section_ord", "heading", F.round(T.section_importance(F.col("heading"), F.col("text")), 6).alias("importance"))


def recognition_score(spark, sf_dir):
    t = F.col("text")
    d = coded_docs(spark, sf_dir).select("doc_id", V.document_number(t).alias("number"), V.revision(t).alias("rev"), V.effective_date(t).alias("date"))
    n = B.numbered_sections(typed_blocks(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("sections"))
    x = d.join(B.title_of(typed_blocks(spark, sf_dir)), "doc_id", "left").join(n, "doc_id", "left").withColumn("sections", F.coalesce("sections", F.lit(0)))
    score = V.recognition_score(F.col("number"), F.col("title"), F.col("date"), F.lit(None).cast("string"), F.col("rev"), F.col("sections"), F.col("doc_id") % 3, F.col("doc_id") % 2, F.lit(4))
    return x.select("doc_id", F.round(score, 6).alias("score"))


QUERIES = {f.__name__: f for f in (header_fields, sections_sessionize, conversation_sections, paragraph_sections, numbered_sections, block_context, turn_context, collect_text, key_concepts, document_titles, doc_summary_topk, section_scores, recognition_score)}

TYPED = f"(SELECT doc_id, block_ord, text, {S.BLOCK_TYPE} AS type FROM {S.CODED_BLOCKS})"
_LEVEL = "CASE WHEN type = 'title' THEN 1 WHEN regexp_matches(heading, '^\\d+\\.\\s+') THEN 1 WHEN regexp_matches(heading, '^\\d+\\.\\d+\\s+') THEN 2 WHEN regexp_matches(heading, '^\\d+\\.\\d+\\.\\d+\\s+') THEN 3 WHEN regexp_matches(heading, '^[가-힣]\\.\\s+') THEN 2 WHEN regexp_matches(heading, '^[가-힣]\\)\\s+') THEN 2 WHEN regexp_matches(heading, '^\\([가-힣]\\)\\s+') THEN 3 ELSE 2 END"
_PATH = "CASE WHEN regexp_matches(heading, '^\\d+(\\.\\d+)*') THEN string_split(regexp_extract(heading, '^(\\d+(?:\\.\\d+)*)', 1), '.') WHEN regexp_matches(heading, '^[가-힣][.)]') THEN [(unicode(heading) - 44032 + 1)::VARCHAR] ELSE [(section_ord + 1)::VARCHAR] END"


def sessions(blocks: str) -> str:
    return f"""(WITH b AS (SELECT * FROM {blocks}),
n AS (SELECT *, sum(CASE WHEN type IN ('title', 'heading') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_ord) AS n FROM b),
o AS (SELECT *, (n - CASE WHEN min(n) OVER (PARTITION BY doc_id) = 0 THEN 0 ELSE 1 END)::INT AS section_ord FROM n),
h AS (SELECT *, first_value(text) OVER w AS heading, first_value(type) OVER w AS htype FROM o WINDOW w AS (PARTITION BY doc_id, section_ord ORDER BY block_ord))
SELECT doc_id, block_ord, text, type, section_ord, format('section_{{:03d}}', section_ord) AS section_id, CASE WHEN n = 0 THEN '서론' ELSE heading END AS heading, CASE WHEN n = 0 THEN 1 ELSE {_LEVEL.replace("type = 'title'", "htype = 'title'")} END AS level, CASE WHEN n = 0 THEN ['0'] ELSE {_PATH} END AS path FROM h)"""


_SECTIONED = sessions(TYPED)
_TURNS = "(SELECT conv_id AS doc_id, turn AS block_ord, CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END AS type, text FROM conversations)"
_FACTOR = "CASE WHEN " + S.has("lower(heading)", ["목적", "purpose", "개요"]) + " THEN 1.3::DOUBLE WHEN " + S.has("lower(heading)", ["안전", "safety", "위험"]) + " THEN 1.4::DOUBLE WHEN " + S.has("lower(heading)", ["절차", "procedure", "방법"]) + " THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END"


def _importance(text: str) -> str:
    return f"least(2.5::DOUBLE * {_FACTOR} * CASE WHEN len({S.ids(text)}) > 5 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 3.0::DOUBLE)"


def _context(blocks: str, by: str) -> str:
    short = lambda c: f"coalesce(CASE WHEN length({c}) > 100 THEN substr({c}, 1, 100) || '...' ELSE {c} END, '')"
    return f"SELECT doc_id, block_ord, {short('p')} AS prev_block, {short('n')} AS next_block FROM (SELECT doc_id, block_ord, lag(text) OVER w AS p, lead(text) OVER w AS n FROM {blocks} WINDOW w AS (PARTITION BY {by} ORDER BY block_ord))"


_NUMBER = "nullif(regexp_extract(text, 'TP-\\d{3}-\\d{3}-\\d{3}'), '')"
_REV = "nullif(regexp_extract(text, 'Rev[\\.\\s]*:\\s*(\\d+)', 1), '')"
_NEAR = "시행일[:\\s]*['\"]?\\s*(\\d{2,4})[.\\-/](\\d{1,2})[.\\-/](\\d{1,2})".replace("'", "''")
_FAR = "(?s)시행일.*?['\"]?\\s*(\\d{2})[.\\-/](\\d{1,2})[.\\-/](\\d{1,2})".replace("'", "''")
_DATE = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 1) || '.' || lpad(regexp_extract(text, '{p}', 2), 2, '0') || '.' || lpad(regexp_extract(text, '{p}', 3), 2, '0') END" for p in (_NEAR, _FAR)) + ")"
_TITLES = f"(SELECT doc_id, {S.strip('arg_min(text, block_ord)')} AS title FROM {TYPED} WHERE NOT contains(text, '적용범위') AND NOT regexp_matches(text, '^\\d+\\.') AND length(text) > 5 AND NOT regexp_matches(text, 'TP-\\d{{3}}') AND NOT regexp_matches(text, '\\d{{2}}\\.\\d{{2}}\\.\\d{{2}}') GROUP BY doc_id)"
_NUMBERED = f"(SELECT doc_id, block_ord, regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\s+(.+?)$', 1) AS number, regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\s+(.+?)$', 2) AS title FROM (SELECT *, {S.strip('text')} AS t FROM {TYPED}) WHERE regexp_matches(t, '^(\\d+(?:\\.\\d+)*)\\s+(.+?)$'))"
_PARA = f"(SELECT doc_id, block_ord, text, CASE WHEN type = 'title' THEN 'Heading 1' WHEN block_ord = 6 THEN '제목 2' END AS style FROM {TYPED})"
_HEADS = "(" + " OR ".join(S.rx("text", p) for p in [r"^\d+\.\s+", r"^\d+\.\d+\s+", r"^[가-힣]\.\s+", r"^[가-힣]\)\s+", r"^\([가-힣]\)\s+", r"^\d+\)\s+"]) + ") AND length(text) BETWEEN 1 AND 100"

ORACLES = {
    "header_fields": f"SELECT doc_id, {_NUMBER} AS number, {_REV} AS revision, {_DATE} AS effective_date FROM ({S.CODED_SQL})",
    "sections_sessionize": f"SELECT doc_id, block_ord::INT AS block_ord, section_ord, section_id, heading, level, array_to_string(path, '|') AS path FROM {_SECTIONED}",
    "conversation_sections": f"SELECT doc_id, section_ord, count(*)::BIGINT AS blocks, max(level) AS level, max(length(heading))::BIGINT AS heading_chars FROM {sessions(_TURNS)} GROUP BY 1, 2",
    "paragraph_sections": f"WITH p AS (SELECT *, (style IS NOT NULL) OR ({_HEADS}) AS head FROM {_PARA}), n AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_ord) AS s FROM p) SELECT doc_id, s::INT AS section_ord, max(text) FILTER (head) AS title, coalesce(max(CASE WHEN style = '제목 2' THEN 2 ELSE 1 END) FILTER (head), 1) AS level, coalesce(string_agg(text, chr(10) ORDER BY block_ord) FILTER (NOT head), '') AS body FROM n GROUP BY 1, 2",
    "numbered_sections": f"SELECT doc_id, block_ord::INT AS block_ord, number, title, len(string_split(number, '.'))::INT AS level FROM {_NUMBERED}",
    "block_context": f"SELECT doc_id, block_ord::INT AS block_ord, prev_block, next_block FROM ({_context(_SECTIONED, 'doc_id, section_ord')})",
    "turn_context": _context(_TURNS, "doc_id"),
    "collect_text": f"SELECT doc_id, string_agg(text, ' ' ORDER BY block_ord) AS text FROM {TYPED} WHERE type <> 'heading' GROUP BY 1",
    "key_concepts": f"WITH e AS (SELECT grp, ord, k, c[k] AS concept FROM (SELECT grp, ord, c, unnest(range(1, len(c) + 1)) AS k FROM (SELECT doc_id % 20 AS grp, doc_id AS ord, {S.ids('text')} AS c FROM ({S.CODED_SQL})))), n AS (SELECT grp, concept, count(*)::BIGINT AS n, min((ord, k)) AS f FROM e GROUP BY 1, 2) SELECT grp, rank::INT AS rank, concept, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) AS rank FROM n) WHERE rank <= 20",
    "document_titles": f"SELECT doc_id, title FROM {_TITLES}",
    "doc_summary_topk": f"WITH s AS (SELECT doc_id, section_ord, arg_min(heading, block_ord) AS heading, string_agg(text, chr(10) ORDER BY block_ord) AS text FROM {_SECTIONED} GROUP BY 1, 2), x AS (SELECT doc_id, section_ord + 1 AS ord, {_importance(chr(40) + chr(39) + '섹션: ' + chr(39) + ' || heading || chr(10) || chr(10) || text' + chr(41))} AS importance, heading || ' 섹션' AS part FROM s UNION ALL SELECT doc_id, 0, 3.0, '문서제목: ' || title FROM ({S.CODED_SQL})), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, ord) AS r FROM x) SELECT doc_id, string_agg(part, '. ' ORDER BY r) AS summary FROM r WHERE r <= 5 GROUP BY 1",
    "section_scores": f"SELECT doc_id, section_ord, heading, round({_importance('text')}, 6) AS importance FROM (SELECT doc_id, section_ord, arg_min(heading, block_ord) AS heading, string_agg(text, chr(10) ORDER BY block_ord) AS text FROM {_SECTIONED} GROUP BY 1, 2)",
    "recognition_score": f"WITH d AS (SELECT doc_id, {_NUMBER} AS number, {_REV} AS rev, {_DATE} AS date FROM ({S.CODED_SQL})), n AS (SELECT doc_id, count(*) AS k FROM {_NUMBERED} GROUP BY 1) SELECT d.doc_id, round((CASE WHEN number IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN title <> '' THEN 20 ELSE 0 END + CASE WHEN date IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN rev IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN k >= 4 THEN 10 ELSE 0 END + CASE WHEN d.doc_id % 3 >= 1 THEN 10 ELSE 0 END + CASE WHEN d.doc_id % 2 > 0 THEN 5 ELSE 0 END + 5)::DOUBLE / 110.0::DOUBLE * 100.0::DOUBLE, 6) AS score FROM d LEFT JOIN {_TITLES} t USING (doc_id) LEFT JOIN n USING (doc_id)",
}
