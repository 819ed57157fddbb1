"""The operators' queries: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_leaks
from .line_dedup import BLANK, BLOCKS, HIDDEN, TAG, dedup_lines
from .matroska import media_digests
from .minhash_dedup import near_duplicates
from .quality_knn import fit, held_out, score_quality
from .secret_scan import RULES, scan_secrets, spans_text
from .sharding import assign_shards, number_slots
from .source_mix import mix_sources
from .token_shards import write_token_shards
from .url_filter import judge_urls


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=(80, 100))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    placed = number_slots(assign_shards(narrow, shards=8), "doc_id", ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels"), "quality"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [k for k, r in enumerate(RULES) if r.base]
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text(F.filter("spans", lambda s: s["ord"].isin(base))), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "pages"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_token_shards(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_source_mix": op2_source_mix,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_matroska": op6_matroska,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_quality_knn": op8_quality_knn,
    "op9_token_shards": op9_token_shards,
    "op10_jump_sharding": op10_jump_sharding,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _secret_oracle() -> str:
    """Positions from the lengths of matches and of the pieces between them, as DuckDB has no match offsets."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS ord, '{r.kind}' AS kind, {str(r.base).lower()} AS base, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s, length(hits[i]) AS n, length(counted[i]) AS c, {r.least} AS least
FROM (SELECT doc_id, hits, gaps, counted, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {r.group}) AS counted, regexp_split_to_array(text, '{p}') AS gaps FROM d))""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
v AS (SELECT doc_id, ord, kind, base, s::BIGINT AS s, concat(kind, ':', s::BIGINT, ':', (s + n)::BIGINT) AS t FROM m WHERE c >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h, string_agg(t, ',' ORDER BY s, ord) FILTER (base) AS x, string_agg(t, ',' ORDER BY s, ord) AS y FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(x, '')) AS base_sha256, coalesce(y, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


ORACLES = {
    "op3_secret_scan": _secret_oracle(),
    "op4_line_dedup": f"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '{BLOCKS}', chr(10), 'g'), '{TAG}', '', 'g') AS text FROM pages),
l AS (SELECT page_id, host, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{BLANK}', ' ', 'g'))), lambda x: x <> '') AS lines FROM p),
e AS (SELECT host, unnest(list_distinct(lines)) AS line FROM l),
c AS (SELECT host, line, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT host, count(*) AS pages FROM l GROUP BY 1),
b AS (SELECT host, list(line) AS marks FROM c JOIN t USING (host) WHERE n >= 3 AND n > pages * 0.3::DOUBLE GROUP BY 1),
k AS (SELECT page_id, l.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(marks, []), x)) AS stay FROM l LEFT JOIN b ON l.host = b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped, array_to_string(stay, chr(10)) AS text FROM k
""",
    "op2_source_mix": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS k FROM s),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
g AS (SELECT *, max(CASE WHEN cap > weight * level THEN level END) OVER () AS free FROM f),
t AS (SELECT source, source_size, least(cap, coalesce(weight * free, cap)) AS target FROM g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
x AS (SELECT d.doc_id, d.size, r.source_size, r.target, (floor(rate) + (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate))::INT)::BIGINT AS copies FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM x
""",
    "op7_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 80 * (na + nb - k)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id, m.component_id = s.doc_id AS kept FROM s JOIN m USING (doc_id)
""",
}
