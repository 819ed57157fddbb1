"""Documents derived from the star schema, in SQL that reads the same in Spark and DuckDB.

The prose table has almost no codes, dates or headings, so technical documents are made from orders: one text of several
lines an order. ``{orders}`` and ``{lineitem}`` stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CODED = """
SELECT o_orderkey AS doc_id,
  CASE WHEN o_orderkey % 5 = 0 THEN '고로 노황변동 조치 기준' WHEN o_orderkey % 5 = 1 THEN 'Work Standard for Pump' WHEN o_orderkey % 5 = 2 THEN '터빈 점검 보고서' WHEN o_orderkey % 5 = 3 THEN 'Operation manual' ELSE 'General notes' END AS title,
  concat_ws(chr(10),
    concat('문서번호: TP-', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(o_orderkey % 77 AS STRING), 3, '0'), '-', lpad(CAST(o_orderkey % 31 AS STRING), 3, '0'), '  시행일: ', substr(CAST(year(o_orderdate) AS STRING), 3, 2), '.', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), CASE WHEN o_orderkey % 2 = 0 THEN '  Rev. : ' ELSE '  Rev. ' END, CAST(o_orderkey % 13 AS STRING)),
    CASE WHEN o_orderkey % 5 = 0 THEN '고로 노황변동 조치 기준' WHEN o_orderkey % 5 = 1 THEN 'Work Standard for Pump' WHEN o_orderkey % 5 = 2 THEN '터빈 점검 보고서' WHEN o_orderkey % 5 = 3 THEN 'Operation manual' ELSE 'General notes' END,
    '1. 적용범위',
    concat('본 기준은 고로 ', CAST(o_orderkey % 9 AS STRING), '호 및 펌프', CAST(o_orderkey % 4 AS STRING), ' 에 적용한다. See Table 2-', CAST(o_orderkey % 3 AS STRING), ' and 그림 3. Temperature is ', CAST(o_orderkey % 1500 AS STRING), ' ℃, pressure 2.5 bar.'),
    CASE WHEN o_orderkey % 3 = 0 THEN '2. 목적 purpose' ELSE '2. 안전 safety rules' END,
    concat('Each step of the procedure is done in turn. Caution: valve MV-', CAST(o_orderkey % 50 AS STRING), ' is hot! Then check code AB', CAST(1000 + o_orderkey % 777 AS STRING), ' again. 참조: TP-001-002-003'),
    '4.1 노황변동의 의미',
    concat('작성자: 담당자  ', o_orderpriority, ' ', o_orderstatus, '. Short. The document-number field of this order stays as it was before; nothing else is said here.'),
    CASE WHEN o_orderkey % 4 = 0 THEN '4.2.1 노열확보 절차' ELSE '가. 작업 방법' END,
    concat('① 노열확보 (온도 ', CAST(o_orderkey % 90 AS STRING), ') ② 통기성 확보 및'),
    CASE WHEN o_orderkey % 2 = 0 THEN '③ 풍' ELSE '④ 조업도 상승' END) AS text
FROM {orders}
"""

# rows of an order's lines: part, quantity, flag
ROWS = """
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row_ord,
  CAST(l_partkey AS STRING) AS c0, CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS c1, CASE WHEN l_partkey % 10 = 0 THEN '12' ELSE l_returnflag END AS c2
FROM {lineitem}
"""


def coded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, text)."""
    return spark.sql(CODED, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def duck(sql: str) -> str:
    """The same text for DuckDB, where the tables are views."""
    return sql.replace("{orders}", "orders").replace("{lineitem}", "lineitem")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, row_ord, c0, c1, c2): the data rows of one table a document; its header row is part, quantity, flag."""
    return spark.sql(ROWS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
