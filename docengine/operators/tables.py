"""Tables, diagrams, process flows, layout elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.fields import flow_confidence


def gather_rows(cells: DataFrame, header: list[str]) -> DataFrame:
    """(doc_id, rows): rows of cells in order, the header first; input (doc_id, row_ord, c0, c1, ...)."""
    names = [c for c in cells.columns if c not in ("doc_id", "row_ord")]
    body = F.transform(F.array_sort(F.collect_list(F.struct("row_ord", F.array(*names).alias("cells")))), lambda x: x["cells"])
    return cells.groupBy("doc_id").agg(F.concat(F.array(F.array(*map(F.lit, header))), body).alias("rows"))


def table_text(rows: Column) -> Column:
    """TX-3."""
    body = F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r, i: F.concat(F.lit("행 "), (i + 1).cast("string"), F.lit(": "), F.array_join(r, " | ")))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(F.concat(F.lit("표 헤더: "), F.array_join(F.element_at(rows, 1), " | "))), body), "\n")).otherwise("")


def table_embedding(rows: Column) -> Column:
    """TX-4."""
    head, n = F.element_at(rows, 1), F.size(rows)
    sample = F.when(n > 1, F.concat(F.lit("예시: "), F.array_join(F.get(rows, F.lit(1)), " | ")))
    return F.concat_ws(" / ", F.when(F.size(head) > 0, F.concat(F.lit("표 구성: "), F.array_join(head, " | "))), F.concat(F.lit("데이터 "), (n - 1).cast("string"), F.lit("행 "), F.size(head).cast("string"), F.lit("열")), sample)


def column_types(rows: Column) -> Column:
    """TX-5: numeric if all non-empty cells of a column are; nothing without data rows."""
    body = F.slice(rows, F.lit(2), F.size(rows))
    numeric = lambda j: F.forall(F.filter(F.transform(body, lambda r: F.get(r, j)), lambda v: F.coalesce(v, F.lit("")) != ""), lambda v: T.strip(v).rlike(r"^[\d.,]+$"))
    return F.when(F.size(rows) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(F.element_at(rows, 1)) - 1), lambda j: F.when(numeric(j), F.lit("numeric")).otherwise(F.lit("text"))))


def table_html(rows: Column) -> Column:
    """TX-2."""
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), T.strip(c), F.lit("</td>"))), ""), F.lit("</tr>"))), ""), F.lit("</table>"))


def table_kind(rows: Column) -> Column:
    """EX-2: the kind that the first row tells, else null."""
    head = F.element_at(rows, 1)
    return F.when(F.exists(head, lambda c: c.contains("작성자")), F.lit("author_info")).when(F.exists(head, lambda c: c.contains("품질영향") | c.contains("공정영향")), F.lit("management_items"))


def captions(paragraphs: DataFrame, tables: DataFrame) -> DataFrame:
    """JN-21: (doc_id, ord, caption): for each table the first paragraph within two elements that names one."""
    named = T.has_any(F.lower("text"), ["표", "table", "그림", "figure"])
    p = paragraphs.filter(named).select("doc_id", F.col("ord").alias("p"), "text")
    # a band join on a small span: each paragraph is offered to the five places around it, so the join is on equality
    offered = p.select("doc_id", "p", "text", F.explode(F.sequence(F.col("p") - 2, F.col("p") + 2)).alias("ord")).filter("ord <> p")
    best = tables.join(offered, ["doc_id", "ord"]).groupBy("doc_id", "ord").agg(F.min_by("text", "p").alias("caption"))
    return tables.join(best, ["doc_id", "ord"], "left").select("doc_id", "ord", T.strip(F.col("caption")).alias("caption"))


def nearest_nodes(points: DataFrame, nodes: DataFrame, within: float = 100.0) -> DataFrame:
    """JN-18: for each point (slide, point, x, y) the first nearest node (slide, node, node_ord, nx, ny) closer than ``within``."""
    d = F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2)
    near = points.join(nodes, "slide").withColumn("distance", d).filter(F.col("distance") < within)
    return near.groupBy("slide", "point").agg(F.min_by("node", F.struct("distance", "node_ord")).alias("node"))


def graph_edges(connectors: DataFrame, shapes: DataFrame) -> DataFrame:
    """JN-19: (slide, edge, from_node, to_node) where both ends find a node, and another one."""
    nodes = shapes.select("slide", F.col("id").alias("node"), F.col("id").alias("node_ord"), (F.col("left") + F.floor(F.col("width") / 2)).alias("nx"), (F.col("top") + F.floor(F.col("height") / 2)).alias("ny"))
    end = lambda s, to: nearest_nodes(connectors.select("slide", F.col("id").alias("point"), F.col(f"{s}_x").alias("x"), F.col(f"{s}_y").alias("y")), nodes).withColumnRenamed("node", to)
    return end("begin", "from_node").join(end("end", "to_node"), ["slide", "point"]).filter("from_node <> to_node").withColumnRenamed("point", "edge")


def parse_step(c: Column) -> Column:
    """EX-12: struct(sequence, title, details, marker) of the lowest step mark in a text, else null."""
    sequence, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for p, n in reversed(fixed.STEP_PATTERNS):
        hit = c.rlike(p)
        sequence, title = F.when(hit, F.lit(n)).otherwise(sequence), F.when(hit, T.strip(F.regexp_extract(c, p, 1))).otherwise(title)
    details = T.strip(F.regexp_extract(c, r"\(([^)]+)\)", 1))
    marker = F.when(F.substring(c, 1, 1).rlike(f"[{fixed.CIRCLED}]"), F.substring(c, 1, 1)).otherwise("")
    return F.when(sequence.isNotNull(), F.struct(sequence.alias("sequence"), title.alias("title"), details.alias("details"), marker.alias("marker")))


def process_steps(drawings: DataFrame, short_title: str = fixed.SHORT_STEP) -> DataFrame:
    """EX-13 and WN-13: (doc_id, sequence, title, details, marker) from drawing texts (doc_id, drawing_ord, text_ord, text).

    Of the steps with one number, in single texts and then in a drawing's joined text, the first with the longest title stays.
    """
    joined = drawings.groupBy("doc_id", "drawing_ord").agg(F.max("text_ord").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_ord", "text"))), lambda x: x["text"]), " ").alias("text")).select("doc_id", "drawing_ord", (F.col("last") + 1).alias("text_ord"), "text")
    steps = drawings.unionByName(joined).select("doc_id", "drawing_ord", "text_ord", parse_step(F.col("text")).alias("s")).filter("s IS NOT NULL")
    best = steps.groupBy("doc_id", F.col("s.sequence").alias("sequence")).agg(F.max_by("s", F.struct(F.length("s.title"), -F.col("drawing_ord"), -F.col("text_ord"))).alias("s"))
    title = T.strip(F.regexp_replace(F.col("s.title"), "및$", ""))
    return best.select("doc_id", "sequence", F.when((F.length(title) < 3) & (F.col("sequence") == 3), F.lit(short_title)).otherwise(title).alias("title"), "s.details", "s.marker")


def flow_summary(steps: DataFrame) -> DataFrame:
    """EX-15, TX-8 and SC-9: (doc_id, summary, confidence, steps)."""
    each = F.concat(F.col("title"), F.when(F.col("details") != "", F.concat(F.lit(" ("), "details", F.lit(")"))).otherwise(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sequence", each.alias("t")))), lambda x: x["t"])
    return steps.groupBy("doc_id").agg(F.array_join(parts, " → ").alias("summary"), flow_confidence(F.min("sequence"), F.max("sequence"), F.count("*")).alias("confidence"), F.count("*").alias("steps"))


def diagram_roles(c: Column) -> Column:
    """EX-16: role of a diagram element by its words (substrings)."""
    low = F.lower(c)
    decision = T.has_any(low, ["if", "판단", "결정", "선택", "?"])
    return F.struct(decision.alias("decision"), T.first_case([("start", T.has_any(low, ["시작", "start", "개시"])), ("end", T.has_any(low, ["종료", "end", "완료", "끝"]))], "step").alias("role"), (F.length(T.strip(c)) > 2).alias("concept"))


def first_two_shapes(elements: DataFrame) -> DataFrame:
    """JN-20: each connector links the first two shapes of its diagram: (diagram, connector, a, b)."""
    shapes = elements.filter("kind <> 'connector'").withColumn("r", F.row_number().over(Window.partitionBy("diagram").orderBy("ord"))).filter("r <= 2")
    ends = shapes.groupBy("diagram").agg(F.max(F.when(F.col("r") == 1, F.col("ord"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("ord"))).alias("b")).filter("b IS NOT NULL")
    return elements.filter("kind = 'connector'").join(ends, "diagram").select("diagram", F.col("ord").alias("connector"), "a", "b")


def layout_blocks(layout: DataFrame, extracted: DataFrame) -> DataFrame:
    """JN-1 and PRJ-1: layout elements with the content extracted at the same box (the last of several), else their own text."""
    last = extracted.groupBy("doc_id", "bbox").agg(F.max_by("data", "ord").alias("data"))
    kind = T.first_case([(v, F.col("element_type") == k) for k, v in fixed.BLOCK_TYPES.items()], "paragraph")
    return layout.join(last, ["doc_id", "bbox"], "left").select("doc_id", "element_ord", F.format_string("block_%04d", "element_ord").alias("block_id"), kind.alias("type"), F.coalesce("data", "text", F.lit("")).alias("text"))


def preferred_tables(tables: DataFrame) -> DataFrame:
    """JN-26: per page the first extractor's tables above 0.8 if any, else all of the second's, else all of the first's."""
    w = Window.partitionBy("doc_id", "page")
    good = F.max(F.when((F.col("extractor") == "a") & (F.col("confidence") > 0.8), 1).otherwise(0)).over(w)
    second = F.max(F.when(F.col("extractor") == "b", 1).otherwise(0)).over(w)
    marked = tables.withColumn("_g", good).withColumn("_b", second)
    keep = F.when(F.col("_g") == 1, (F.col("extractor") == "a") & (F.col("confidence") > 0.8)).when(F.col("_b") == 1, F.col("extractor") == "b").otherwise(F.lit(True))
    return marked.filter(keep).drop("_g", "_b")


def scanned(pages: DataFrame, first: int = 5) -> DataFrame:
    """SRC-6 and SRC-7: (doc_id, scanned_base, scanned_pdf) from the first pages (doc_id, page_no, chars, images)."""
    p = pages.filter(F.col("page_no") <= first)
    bare = F.when((F.col("chars") < 100) & (F.col("images") > 0), 0).otherwise(F.col("chars"))
    g = p.groupBy("doc_id").agg(F.avg(bare).alias("base"), F.avg("chars").alias("c"), F.avg("images").alias("i"))
    return g.select("doc_id", (F.col("base") < 50).alias("scanned_base"), (((F.col("c") < 100) & (F.col("i") > 0)) | (F.col("c") < 50)).alias("scanned_pdf"))


def quad_box(points: Column) -> Column:
    """SRC-43: [least x, least y, greatest x, greatest y] of OCR corner points."""
    xs, ys = F.transform(points, lambda p: F.element_at(p, 1)), F.transform(points, lambda p: F.element_at(p, 2))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
