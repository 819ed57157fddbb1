"""Office files: a distributed scan of zip parts, and their paragraphs, cells, properties and references as rows.

Executors read the bytes through Spark (``binaryFile``), so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import file_type

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/package/2006/relationships}"

ELEMENTS = "path string, part string, kind string, ord int, sub int, col int, style string, name string, text string"


def read_files(spark: SparkSession, path: str, max_bytes: int = 104_857_600) -> tuple[DataFrame, DataFrame]:
    """SRC-1, SRC-3, SRC-4: (files, rejected): (path, name, suffix, bytes, type, content); too large ones and unknown types are rejected."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = raw.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"), F.col("length").alias("bytes"), "modificationTime", file_type(F.col("path")).alias("type"), "content")
    ok = (F.col("bytes") <= max_bytes) & (F.col("type") != "unknown")
    return f.filter(ok), f.filter(~ok).drop("content")


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t"))


def _style(p: ET.Element) -> str | None:
    s = p.find(f".//{W}pStyle")
    return None if s is None else s.get(f"{W}val")


def _elements(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of one file; a broken file gives one row of kind ``error``."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        for part in sorted(z.namelist()):
            if not part.endswith((".xml", ".rels")):
                continue
            root = ET.fromstring(z.read(part))
            if part == "word/document.xml":
                body = root.find(f"{W}body")
                for k, e in enumerate([] if body is None else list(body)):  # paragraphs and tables by their place in the body
                    if e.tag == f"{W}p":
                        yield path, part, "paragraph", k, 0, None, _style(e), None, _text(e)
                        for d, drawing in enumerate(e.iter(f"{W}drawing")):
                            texts = [t.text.strip() for t in drawing.iter() if t.tag in (f"{W}t", f"{A}t") and t.text and t.text.strip()]
                            yield from ((path, part, "drawing", k, d, n, None, None, t) for n, t in enumerate(texts or [""]))
                    elif e.tag == f"{W}tbl":
                        for r, row in enumerate(e.iter(f"{W}tr")):
                            for c, cell in enumerate(row.findall(f"{W}tc")):
                                yield path, part, "cell", k, r, c, None, None, _text(cell).strip()
                for k, p in enumerate(root.iter(f"{W}p")):  # all paragraphs, those in tables too
                    yield path, part, "xml_paragraph", k, 0, None, _style(p), None, _text(p)
            elif part.startswith("word/") and ("header" in part or "footer" in part):
                kind = "header" if "header" in part else "footer"
                for k, p in enumerate(root.iter(f"{W}p")):
                    if _text(p).strip():
                        yield path, part, kind, k, 0, None, _style(p), None, _text(p).strip()
            elif part == "word/styles.xml":
                for k, s in enumerate(root.iter(f"{W}style")):
                    n = s.find(f"{W}name")
                    yield path, part, "style", k, 0, None, s.get(f"{W}styleId"), None if n is None else n.get(f"{W}val"), s.get(f"{W}type")
            elif part == "word/numbering.xml":
                for kind, tag, key in (("abstract", "abstractNum", "abstractNumId"), ("instance", "num", "numId")):
                    for k, s in enumerate(root.findall(f"{W}{tag}")):
                        yield path, part, "numbering", k, 0, None, None, f"{kind}_{s.get(W + key)}", None
            elif part == "docProps/core.xml":
                for k, e in enumerate(root):
                    yield path, part, "property", k, 0, None, None, e.tag.rpartition("}")[2], e.text
            elif part.endswith(".rels"):
                for k, e in enumerate(root.findall(f"{R}Relationship")):
                    yield path, part, "relationship", k, 0, None, e.get("Type"), e.get("Id"), e.get("Target")
    except Exception as e:  # a broken file must not fail the scan; it is a row of the rejects
        yield path, None, "error", 0, 0, None, None, type(e).__name__, str(e)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    for f in frames:
        for path, content in zip(f["path"], f["content"], strict=True):  # one file at a time
            out = pd.DataFrame(list(_elements(path, content)), columns=names)
            for c in ("ord", "sub", "col"):
                out[c] = out[c].astype("Int32")
            yield out


def scan_docx(files: DataFrame) -> DataFrame:
    """SRC-9 to SRC-16, SRC-20 to SRC-31 and EX-14: the elements of DOCX files as one long table."""
    return files.filter("type = 'docx'").select("path", "content").mapInPandas(_scan, ELEMENTS)


def paragraphs(elements: DataFrame) -> DataFrame:
    """SRC-9, SRC-20: (path, block_ord, style, text), blank ones left out, their place kept."""
    return elements.filter("kind = 'paragraph' AND trim(text) <> ''").select("path", F.col("ord").alias("block_ord"), "style", "text")


def cells(elements: DataFrame) -> DataFrame:
    """SRC-13, SRC-21: (path, table_ord, row, col, text)."""
    return elements.filter("kind = 'cell'").select("path", F.col("ord").alias("table_ord"), F.col("sub").alias("row"), "col", "text")


def edges(elements: DataFrame) -> DataFrame:
    """SRC-16, SRC-23: (path, area, text): texts of headers and of footers joined by a space, in order."""
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "text"))), lambda x: x["text"]), " ")
    return elements.filter("kind IN ('header', 'footer')").groupBy("path", F.col("kind").alias("area")).agg(t.alias("text"))


def properties(elements: DataFrame) -> DataFrame:
    """SRC-24: (path, properties map)."""
    return elements.filter("kind = 'property' AND text IS NOT NULL").groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "text")))).alias("properties"))


def relationships(elements: DataFrame) -> DataFrame:
    """SRC-15: (path, part, id, type, target)."""
    return elements.filter("kind = 'relationship'").select("path", "part", F.col("name").alias("id"), F.col("style").alias("type"), F.col("text").alias("target"))


def drawings(elements: DataFrame) -> DataFrame:
    """EX-14: (doc_id, drawing_ord, text_ord, text), for process steps."""
    return elements.filter("kind = 'drawing' AND text <> ''").select(F.col("path").alias("doc_id"), (F.col("ord") * 1000 + F.col("sub")).alias("drawing_ord"), F.col("col").alias("text_ord"), "text")
