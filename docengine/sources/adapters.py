"""Formats and engines that need software from outside: a registry, and what their rows must look like.

PDF pages (SRC-32 to SRC-37), OCR (SRC-33, JN-30) and layout models (SRC-41, SRC-45 to SRC-48) come as rows from a
function registered here; what is done with these rows is in ``operators``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ooxml

PDF_PAGES = "path string, page_number int, text string, width double, height double, images int"
LAYOUT = "path string, element_ord int, element_type string, bbox array<double>, confidence double, page_number int, text string"

#: Labels of layout engines and the element type of each; others are unknown.
LABELS = {"text": "text", "title": "title", "figure": "figure", "table": "table", "header": "header", "footer": "footer", "기술기준_제목": "title", "작업표준_헤더": "header", "주의사항": "text", "경고": "text", "절차단계": "list", "온도표": "table", "플로우차트": "diagram"}

_parsers: dict[str, Callable[[DataFrame], DataFrame]] = {"docx": ooxml.scan_docx}


def register(kind: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    """SRC-2: a parser of files of one type: files to rows."""
    _parsers[kind] = parser


def supported() -> list[str]:
    return sorted(_parsers)


def read_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-2 and SRC-40: one scan, the rows of each registered type; what can't be parsed is under ``rejected``."""
    files, rejected = ooxml.read_files(spark, path)
    out = {k: p(files.filter(F.col("type") == k)) for k, p in _parsers.items()}
    rest = files.filter(~F.col("type").isin(*_parsers)).drop("content")
    return out | {"rejected": rejected.unionByName(rest)}


def label_type(label: Column, custom: dict[str, str] | None = None) -> Column:
    """SRC-44: the element type of a layout label."""
    names = LABELS | (custom or {})
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), label), F.lit("unknown"))


def normalise_layout(boxes: DataFrame, ocr: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """SRC-42: one table of elements from a page's boxes, OCR lines, parsed blocks and table HTML; boxes without four numbers are dropped."""
    four = F.size("bbox") == 4
    full = F.array(*[F.lit(x) for x in (0.0, 0.0, 1000.0, 1000.0)])
    pick = lambda df, kind, conf, box: df.select("path", "page_number", kind.alias("element_type"), box.alias("bbox"), F.coalesce("confidence", F.lit(conf)).alias("confidence"), "text")
    a = pick(boxes.filter(four), label_type(F.col("label")), 0.0, F.col("bbox"))
    b = pick(ocr.filter(four), F.lit("text"), 0.9, F.col("bbox"))
    c = pick(blocks.filter(four), label_type(F.col("label")), 0.9, F.col("bbox"))
    d = pick(tables, F.lit("table"), 0.9, full)
    return a.unionByName(b).unionByName(c).unionByName(d)


def pdf_text(pages: DataFrame) -> DataFrame:
    """SRC-34: (path, text): stripped pages in order, an empty line between."""
    t = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: F.regexp_replace(x["text"], r"^\s+|\s+$", ""))
    return pages.groupBy("path").agg(F.array_join(t, "\n\n").alias("text"))


def clamp_box(bbox: Column, width: Column, height: Column) -> Column:
    """JN-30: a box cut to its image."""
    lim = lambda k, m: F.least(F.greatest(F.element_at(bbox, k), F.lit(0.0)), m)
    return F.array(lim(1, width), lim(2, height), lim(3, width), lim(4, height))
