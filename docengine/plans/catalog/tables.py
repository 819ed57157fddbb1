"""Tables, diagrams, flows, layout, statistics and the nested document form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fields as V
from ...functions import text as T
from ...operators import blocks as B
from ...operators import docjson as J
from ...operators import stats as R
from ...operators import tables as X
from ..derived import coded_docs, table_rows
from . import sql as S
from .chunks import _DOCS, _docs
from .common import joined, read, typed_blocks
from .structure import _SECTIONED

HEADER = ["part", "qty", "flag"]


def _rows(spark, sf_dir):
    return X.gather_rows(table_rows(spark, sf_dir), HEADER)


def table_text(spark, sf_dir):
    r = F.col("rows")
    return _rows(spark, sf_dir).select("doc_id", X.table_text(r).alias("text"), X.table_embedding(r).alias("embedding"))


def table_structure(spark, sf_dir):
    r = F.col("rows")
    return _rows(spark, sf_dir).select("doc_id", F.size(r).cast("long").alias("row_count"), joined(X.column_types(r)).alias("types"))


def table_html(spark, sf_dir):
    r = F.col("rows")
    return _rows(spark, sf_dir).select("doc_id", X.table_html(r).alias("html"), T.strip_html(X.table_html(r)).alias("text"))


def table_kinds(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.array(F.array(F.when(F.col("o_orderkey") % 3 == 0, "작성자").when(F.col("o_orderkey") % 3 == 1, "품질영향 항목").otherwise("other"), F.col("o_orderpriority"))).alias("rows"))
    kind = X.table_kind(F.col("rows"))
    return o.select("o_orderkey", kind.alias("kind"), F.when(kind == "author_info", F.get(F.element_at("rows", 1), F.lit(1))).alias("author"))


def caption_join(spark, sf_dir):
    b = B.flatten_blocks(coded_docs(spark, sf_dir))
    p = b.select("doc_id", F.col("block_ord").alias("ord"), "text")
    t = b.filter("block_ord IN (2, 5, 9)").select("doc_id", F.col("block_ord").alias("ord"))
    return X.captions(p, t)


def graph_edges(spark, sf_dir):
    """Shapes from parts on slides of twenty; connectors from order lines, near their parts."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    shapes = p.select(F.floor(k / 20).alias("slide"), k.alias("id"), (k * 37 % 900).alias("left"), (k * 53 % 700).alias("top"), (F.col("p_size") + 10).alias("width"), F.col("p_size").alias("height"))
    conn = p.select(F.floor(k / 20).alias("slide"), k.alias("id"), (k * 37 % 900).alias("begin_x"), (k * 53 % 700).alias("begin_y"), ((k + 1) * 37 % 900).alias("end_x"), ((k + 1) * 53 % 700).alias("end_y"))
    return X.graph_edges(conn, shapes)


def shape_links(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 7).alias("diagram"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 3 == 0, "connector").otherwise("shape").alias("kind"))
    return X.first_two_shapes(p)


def _drawings(spark, sf_dir):
    b = B.flatten_blocks(coded_docs(spark, sf_dir)).filter("block_ord >= 8")
    return b.select("doc_id", F.when(F.col("block_ord") < 10, 0).otherwise(1).alias("drawing_ord"), F.col("block_ord").alias("text_ord"), "text")


def process_flows(spark, sf_dir):
    return X.process_steps(_drawings(spark, sf_dir))


def flow_confidence(spark, sf_dir):
    return X.flow_summary(X.process_steps(_drawings(spark, sf_dir))).withColumn("confidence", F.round("confidence", 6))


def diagram_roles(spark, sf_dir):
    b = B.flatten_blocks(coded_docs(spark, sf_dir))
    return b.select("doc_id", "block_ord", X.diagram_roles(F.col("text")).alias("r")).select("doc_id", "block_ord", "r.*")


def layout_blocks(spark, sf_dir):
    t = typed_blocks(spark, sf_dir)
    box = F.concat_ws(",", (F.col("doc_id") % 50).cast("string"), (F.col("block_ord") % 4).cast("string"))
    layout = t.select("doc_id", F.col("block_ord").alias("element_ord"), F.when(F.col("block_ord") == 3, "figure").when(F.col("block_ord") == 5, "footer").otherwise(F.col("type")).alias("element_type"), box.alias("bbox"), F.when(F.col("block_ord") != 7, F.col("text")).alias("text"))
    extracted = t.filter("block_ord IN (1, 5, 6)").select("doc_id", box.alias("bbox"), F.col("block_ord").alias("ord"), F.concat(F.lit("x:"), "text").alias("data"))
    return X.layout_blocks(layout, extracted)


def preferred_tables(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), F.when(F.col("l_returnflag") == "R", "b").otherwise("a").alias("extractor"), (F.col("l_quantity") / 50).alias("confidence"), F.col("l_partkey"))
    return X.preferred_tables(e).groupBy("doc_id", "page", "extractor").agg(F.count("*").alias("n"))


def scanned_pages(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), (F.col("l_quantity") * 3).alias("chars"), (F.col("l_partkey") % 2).alias("images"))
    return X.scanned(p)


def template_stats(spark, sf_dir):
    r = read(spark, sf_dir, "events").select(F.col("user_id").alias("template_id"), F.col("event_type").alias("doc_type"), (F.col("value") / 500).alias("success"))
    return R.template_stats(r).withColumn("success", F.round("success", 6))


def type_counts(spark, sf_dir):
    return R.type_counts(read(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("doc_type")))


def run_stats_last10(spark, sf_dir):
    r = read(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("run_id"), F.col("event_type").alias("level"), F.col("value").alias("seconds"), F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("double")).alias("quality"))
    s = R.recent_runs(r)
    return s.withColumn("seconds", F.round("seconds", 6)).withColumn("quality", F.round("quality", 6))


def corpus_counters(spark, sf_dir):
    r = read(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), (F.col("user_id") % 2 == 0).alias("success"), F.col("value").alias("seconds"))
    c = R.counters(r)
    return c.withColumn("seconds", F.round("seconds", 4)).withColumn("average", F.round("average", 6))


def batch_learning(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    fields = F.filter(F.array(F.lit("title"), F.when(F.col("user_id") % 3 != 0, F.lit("date")), F.when(F.col("event_id") % 40 != 0, F.lit("code"))), lambda x: x.isNotNull())
    r = e.select(F.col("user_id").alias("template_id"), F.col("event_id").alias("run_id"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), (F.col("value") / 500).alias("bbox_accuracy"), fields.alias("fields"))
    b = R.batch_learning(r)
    return b.select("template_id", "documents", F.round("confidence", 6).alias("confidence"), F.round("bbox_accuracy", 6).alias("bbox_accuracy"), joined(F.col("common")).alias("common"), joined(F.col("hints")).alias("hints"))


def method_share(spark, sf_dir):
    f = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, "docjson_metadata").when(F.col("l_linenumber") < 4, "exact").when(F.col("l_linenumber") == 5, "process_flow").otherwise("fuzzy").alias("method"))
    return R.method_share(f).withColumn("share", F.round("share", 6))


def stage_quality(spark, sf_dir):
    """SC-10, SC-15, SC-16 and SC-17 over runs made from customers."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    some = lambda m, v: F.when(k % m != 0, F.lit(v))
    quality = V.stage_quality(some(11, 0.95), some(2, 0.6), some(3, 0.8), some(5, 0.9), k % 7 != 0)
    work = V.workflow_score(k % 10 / 10.0, (k % 4).cast("double"), F.lit(0.5), k % 20 * 1.0)
    assess = V.assessment([(some(2, 99.917585), 0.25), (some(3, 96.0), 0.35), (some(5, 88.0), 0.30), (some(7, 100.0), 0.10)])
    return c.select("c_custkey", F.round(quality, 6).alias("quality"), F.round(work, 6).alias("workflow"), F.round(assess, 6).alias("assessment"), F.round(V.template_similarity(k % 6, k % 4), 6).alias("similarity"), V.importance_threshold(F.when(k % 3 == 0, "critical").when(k % 3 == 1, "high").otherwise("low")).alias("threshold"), V.page_estimate(k % 200, k % 7).alias("pages"))


def docjson_valid(spark, sf_dir):
    n = J.nest(_docs(spark, sf_dir), B.sessionize(typed_blocks(spark, sf_dir)))
    k = F.regexp_extract("doc_id", r"(\d+)", 1).cast("long")
    ok = J.is_valid(F.when(k % 5 == 0, "2").otherwise(F.col("version")), F.col("doc_id"), F.when(k % 7 != 0, F.col("metadata.title")), F.col("metadata.doc_type"), F.when(k % 11 == 0, -1).otherwise(0), F.col("sections"))
    return n.select("doc_id", ok.alias("valid"))


def docjson_roundtrip(spark, sf_dir):
    n = J.nest(_docs(spark, sf_dir), B.sessionize(typed_blocks(spark, sf_dir)))
    back = n.select(F.from_json(F.to_json(F.struct(*n.columns)), n.schema).alias("j")).select("j.*")
    return J.flatten(back)


def embedding_neighbours(spark, sf_dir):
    """Cosine of each vector with the first one of its label (an extension: the vector store of the configuration is never filled)."""
    e = read(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return e.join(first, "label").select("vec_id", "label", F.round(dot("embedding", "base") / F.sqrt(dot("embedding", "embedding") * dot("base", "base")), 5).alias("cosine"))


QUERIES = {f.__name__: f for f in (table_text, table_structure, table_html, table_kinds, caption_join, graph_edges, shape_links, process_flows, flow_confidence, diagram_roles, layout_blocks, preferred_tables, scanned_pages, template_stats, type_counts, run_stats_last10, corpus_counters, batch_learning, method_share, stage_quality, docjson_valid, docjson_roundtrip, embedding_neighbours)}

_R = f"({S.ROWS_SQL})"
_STEP_SEQ = "CASE " + " ".join(f"WHEN regexp_matches(text, '{m}([^{rest}]+)') THEN {k}" for k, (m, rest) in enumerate([("①", "②③④⑤⑥⑦⑧⑨⑩"), ("②", "③④⑤⑥⑦⑧⑨⑩"), ("③", "④⑤⑥⑦⑧⑨⑩"), ("④", "⑤⑥⑦⑧⑨⑩"), ("⑤", "⑥⑦⑧⑨⑩")], 1)) + " END"
_STEP_TITLE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{m}([^{rest}]+)') THEN {S.strip(f"regexp_extract(text, '{m}([^{rest}]+)', 1)")}" for m, rest in [("①", "②③④⑤⑥⑦⑧⑨⑩"), ("②", "③④⑤⑥⑦⑧⑨⑩"), ("③", "④⑤⑥⑦⑧⑨⑩"), ("④", "⑤⑥⑦⑧⑨⑩"), ("⑤", "⑥⑦⑧⑨⑩")]) + " END"
_DRAW = f"(SELECT doc_id, CASE WHEN block_ord < 10 THEN 0 ELSE 1 END AS d, block_ord AS t, text FROM {S.CODED_BLOCKS} WHERE block_ord >= 8)"
_STEPS = f"""(WITH d AS (SELECT * FROM {_DRAW} UNION ALL SELECT doc_id, d, max(t) + 1, string_agg(text, ' ' ORDER BY t) FROM {_DRAW} GROUP BY 1, 2),
s AS (SELECT *, {_STEP_SEQ} AS sequence, {_STEP_TITLE} AS title, {S.strip("regexp_extract(text, '\\(([^)]+)\\)', 1)")} AS details, CASE WHEN regexp_matches(text, '^[①②③④⑤⑥⑦⑧⑨⑩]') THEN substr(text, 1, 1) ELSE '' END AS marker FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sequence ORDER BY length(title) DESC, d, t) AS r, {S.strip("regexp_replace(title, '및$', '')")} AS clean FROM s WHERE sequence IS NOT NULL)
SELECT doc_id, sequence::INT AS sequence, CASE WHEN length(clean) < 3 AND sequence = 3 THEN '풍량확보 및 연화융착대형성' ELSE clean END AS title, details, marker FROM r WHERE r = 1)"""
_EVENTS = "events"

ORACLES = {
    "table_text": f"SELECT doc_id, '표 헤더: part | qty | flag' || string_agg(chr(10) || '행 ' || row_ord::VARCHAR || ': ' || c0 || ' | ' || c1 || ' | ' || c2, '' ORDER BY row_ord) AS text, '표 구성: part | qty | flag / 데이터 ' || count(*)::VARCHAR || '행 3열 / 예시: ' || arg_min(c0 || ' | ' || c1 || ' | ' || c2, row_ord) AS embedding FROM {_R} GROUP BY 1",
    "table_structure": f"SELECT doc_id, count(*)::BIGINT + 1 AS row_count, 'numeric|' || CASE WHEN bool_and(c1 = '' OR regexp_matches(c1, '^[\\d.,]+$')) THEN 'numeric' ELSE 'text' END || '|' || CASE WHEN bool_and(c2 = '' OR regexp_matches(c2, '^[\\d.,]+$')) THEN 'numeric' ELSE 'text' END AS types FROM {_R} GROUP BY 1",
    "table_html": f"SELECT doc_id, html, {S.strip("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")} AS text FROM (SELECT doc_id, '<table><tr><td>part</td><td>qty</td><td>flag</td></tr>' || string_agg('<tr><td>' || c0 || '</td><td>' || c1 || '</td><td>' || c2 || '</td></tr>', '' ORDER BY row_ord) || '</table>' AS html FROM {_R} GROUP BY 1)",
    "table_kinds": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'author_info' WHEN o_orderkey % 3 = 1 THEN 'management_items' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS author FROM orders",
    "caption_join": f"WITH p AS (SELECT doc_id, block_ord AS ord, text FROM {S.CODED_BLOCKS} WHERE {S.has('lower(text)', ['표', 'table', '그림', 'figure'])}), t AS (SELECT doc_id, block_ord AS ord FROM {S.CODED_BLOCKS} WHERE block_ord IN (2, 5, 9)) SELECT t.doc_id, t.ord::INT AS ord, {S.strip('arg_min(text, p.ord)')} AS caption FROM t LEFT JOIN p ON t.doc_id = p.doc_id AND abs(t.ord - p.ord) BETWEEN 1 AND 2 GROUP BY 1, 2",
    "graph_edges": "WITH n AS (SELECT p_partkey // 20 AS slide, p_partkey AS id, p_partkey * 37 % 900 + (p_size + 10) // 2 AS nx, p_partkey * 53 % 700 + p_size // 2 AS ny FROM part), e AS (SELECT p_partkey // 20 AS slide, p_partkey AS id, 0 AS s, p_partkey * 37 % 900 AS x, p_partkey * 53 % 700 AS y FROM part UNION ALL SELECT p_partkey // 20, p_partkey, 1, (p_partkey + 1) * 37 % 900, (p_partkey + 1) * 53 % 700 FROM part), d AS (SELECT e.slide, e.id, s, n.id AS node, sqrt((x - nx) ** 2 + (y - ny) ** 2) AS d FROM e JOIN n USING (slide)), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide, id, s ORDER BY d, node) AS r FROM d WHERE d < 100) WHERE r = 1) SELECT a.slide, a.id AS edge, a.node AS from_node, b.node AS to_node FROM m a JOIN m b ON a.slide = b.slide AND a.id = b.id AND a.s = 0 AND b.s = 1 WHERE a.node <> b.node",
    "shape_links": "WITH p AS (SELECT p_partkey // 7 AS diagram, p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN 'connector' ELSE 'shape' END AS kind FROM part), s AS (SELECT diagram, ord, row_number() OVER (PARTITION BY diagram ORDER BY ord) AS r FROM p WHERE kind = 'shape') SELECT c.diagram, c.ord AS connector, a.ord AS a, b.ord AS b FROM p c JOIN s a ON c.diagram = a.diagram AND a.r = 1 JOIN s b ON c.diagram = b.diagram AND b.r = 2 WHERE c.kind = 'connector'",
    "process_flows": f"SELECT * FROM {_STEPS}",
    "flow_confidence": f"SELECT doc_id, string_agg(title || CASE WHEN details <> '' THEN ' (' || details || ')' ELSE '' END, ' → ' ORDER BY sequence) AS summary, round(CASE WHEN count(*) < 2 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN max(sequence) - min(sequence) + 1 = count(*) THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END + least(0.2::DOUBLE, count(*) * 0.05::DOUBLE)) END, 6) AS confidence, count(*)::BIGINT AS steps FROM {_STEPS} GROUP BY 1",
    "diagram_roles": f"SELECT doc_id, block_ord::INT AS block_ord, {S.has('lower(text)', ['if', '판단', '결정', '선택', '?'])} AS decision, {S.case([(S.has('lower(text)', ['시작', 'start', '개시']), S.q('start')), (S.has('lower(text)', ['종료', 'end', '완료', '끝']), S.q('end'))], S.q('step'))} AS role, length({S.strip('text')}) > 2 AS concept FROM {S.CODED_BLOCKS}",
    "layout_blocks": f"WITH t AS (SELECT doc_id, block_ord, text, {S.BLOCK_TYPE} AS type, (doc_id % 50)::VARCHAR || ',' || (block_ord % 4)::VARCHAR AS bbox FROM {S.CODED_BLOCKS}), x AS (SELECT doc_id, bbox, arg_max('x:' || text, block_ord) AS data FROM t WHERE block_ord IN (1, 5, 6) GROUP BY 1, 2) SELECT t.doc_id, block_ord::INT AS element_ord, format('block_{{:04d}}', block_ord) AS block_id, CASE WHEN block_ord = 3 THEN 'image' WHEN block_ord = 5 THEN 'paragraph' ELSE type END AS type, coalesce(data, CASE WHEN block_ord <> 7 THEN text END, '') AS text FROM t LEFT JOIN x USING (doc_id, bbox)",
    "preferred_tables": "WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page, CASE WHEN l_returnflag = 'R' THEN 'b' ELSE 'a' END AS extractor, l_quantity / 50 AS confidence FROM lineitem), m AS (SELECT *, bool_or(extractor = 'a' AND confidence > 0.8::DOUBLE) OVER w AS g, bool_or(extractor = 'b') OVER w AS b FROM e WINDOW w AS (PARTITION BY doc_id, page)) SELECT doc_id, page, extractor, count(*)::BIGINT AS n FROM m WHERE CASE WHEN g THEN extractor = 'a' AND confidence > 0.8::DOUBLE WHEN b THEN extractor = 'b' ELSE true END GROUP BY 1, 2, 3",
    "scanned_pages": "WITH p AS (SELECT l_orderkey AS doc_id, l_quantity * 3 AS chars, l_partkey % 2 AS images FROM lineitem WHERE l_linenumber <= 5) SELECT doc_id, avg(CASE WHEN chars < 100 AND images > 0 THEN 0 ELSE chars END) < 50 AS scanned_base, (avg(chars) < 100 AND avg(images) > 0) OR avg(chars) < 50 AS scanned_pdf FROM p GROUP BY 1",
    "template_stats": "WITH t AS (SELECT user_id, count(*) AS used, avg(value / 500) AS s FROM events GROUP BY 1) SELECT count(*)::BIGINT AS templates, (SELECT user_id FROM t ORDER BY used DESC, user_id LIMIT 1) AS most_used, round(avg(s), 6) AS success FROM t",
    "type_counts": "SELECT CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS doc_type, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "run_stats_last10": "WITH r AS (SELECT user_id AS grp, event_type, value, CASE WHEN event_type <> 'view' THEN (props->>'$.k')::DOUBLE END AS quality, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT grp, max(total)::BIGINT AS total, count(*)::BIGINT AS analyzed, round(avg(value), 6) AS seconds, round(avg(coalesce(quality, 0)), 6) AS quality, count(*) FILTER (event_type = 'purchase')::BIGINT AS complete FROM r WHERE r <= 10 GROUP BY 1",
    "corpus_counters": "SELECT event_type AS grp, count(*) FILTER (user_id % 2 = 0)::BIGINT AS processed, count(*) FILTER (user_id % 2 <> 0)::BIGINT AS failed, round(sum(value), 4) AS seconds, round(avg(value), 6) AS average FROM events GROUP BY 1",
    "batch_learning": "WITH r AS (SELECT user_id AS t, event_id AS run, least(1.0::DOUBLE, value / 100) AS c, value / 500 AS b, user_id % 3 <> 0 AS d, event_id % 40 <> 0 AS k FROM events WHERE value / 100 > 0.5::DOUBLE), g AS (SELECT t, count(*)::BIGINT AS n, avg(c) AS c, avg(b) AS b, count(DISTINCT 1 + d::INT + k::INT) AS sizes, bool_and(d) AS d, bool_and(k) AS k FROM r GROUP BY 1 HAVING count(*) >= 2) SELECT t AS template_id, n AS documents, round(c, 6) AS confidence, round(b, 6) AS bbox_accuracy, array_to_string(list_filter([CASE WHEN k THEN 'code' END, CASE WHEN d THEN 'date' END, 'title'], lambda x: x IS NOT NULL), '|') AS common, array_to_string(list_filter([CASE WHEN c < 0.6::DOUBLE THEN 'improve patterns' END, CASE WHEN c > 0.8::DOUBLE THEN 'good template' END, CASE WHEN b < 0.5::DOUBLE THEN 'improve positions' END, CASE WHEN sizes > 1 THEN 'field counts differ' END], lambda x: x IS NOT NULL), '|') AS hints FROM g",
    "method_share": "WITH f AS (SELECT CASE WHEN l_linenumber = 1 THEN 'docjson_metadata' WHEN l_linenumber < 4 THEN 'exact' WHEN l_linenumber = 5 THEN 'process_flow' ELSE 'fuzzy' END AS method FROM lineitem) SELECT method, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM f) * 100, 6) AS share, method IN ('docjson_metadata', 'process_flow') AS inferred FROM f GROUP BY 1",
    "stage_quality": "WITH c AS (SELECT c_custkey, c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN 0.95::DOUBLE * 25.0::DOUBLE END AS p, coalesce(CASE WHEN c_custkey % 2 <> 0 THEN 0.6::DOUBLE * 35.0::DOUBLE END, CASE WHEN c_custkey % 3 <> 0 THEN 0.8::DOUBLE * 30.0::DOUBLE END) AS t, CASE WHEN c_custkey % 5 <> 0 THEN 0.9::DOUBLE * 10.0::DOUBLE END AS v, CASE WHEN c_custkey % 7 <> 0 THEN 25.0::DOUBLE END AS o FROM customer) SELECT c_custkey, round(coalesce(list_avg(list_filter([p, t, v, o], lambda x: x IS NOT NULL)), 0), 6) AS quality, round((k % 10)::DOUBLE / 10 * 40 + (k % 4)::DOUBLE / 3 * 30 + 10 + greatest(0.0::DOUBLE, least(10.0::DOUBLE, 10.0::DOUBLE - k % 20)), 6) AS workflow, round(coalesce((coalesce(CASE WHEN k % 2 <> 0 THEN 99.917585::DOUBLE * 0.25::DOUBLE END, 0) + coalesce(CASE WHEN k % 3 <> 0 THEN 96.0::DOUBLE * 0.35::DOUBLE END, 0) + coalesce(CASE WHEN k % 5 <> 0 THEN 88.0::DOUBLE * 0.30::DOUBLE END, 0) + coalesce(CASE WHEN k % 7 <> 0 THEN 100.0::DOUBLE * 0.10::DOUBLE END, 0)) / nullif(CASE WHEN k % 2 <> 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN k % 3 <> 0 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN k % 5 <> 0 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN k % 7 <> 0 THEN 0.10::DOUBLE ELSE 0 END, 0), 0), 6) AS assessment, round(CASE WHEN k % 6 = 0 OR k % 4 = 0 THEN 0.0::DOUBLE ELSE least(k % 6, k % 4)::DOUBLE / greatest(k % 6, k % 4) END, 6) AS similarity, CASE WHEN k % 3 = 0 THEN 0.95::DOUBLE WHEN k % 3 = 1 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS threshold, greatest(1, (k % 200) // 40 + (k % 7) // 2 + 1)::INT AS pages FROM c",
    "docjson_valid": f"SELECT 'doc_' || doc_id::VARCHAR AS doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS valid FROM {_DOCS}",
    "docjson_roundtrip": f"SELECT 'doc_' || doc_id::VARCHAR AS doc_id, section_ord, (row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY block_ord) - 1)::INT AS block_ord, type, text FROM {_SECTIONED}",
    "embedding_neighbours": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS base FROM embeddings GROUP BY 1) SELECT vec_id, e.label, round(list_dot_product(embedding::DOUBLE[], base::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(base::DOUBLE[], base::DOUBLE[])), 5) AS cosine FROM embeddings e JOIN f USING (label)",
}
