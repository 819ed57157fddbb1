"""Office files made on the spot, templates, adapters, presets, pipeline, sinks and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docengine import sinks
from docengine.operators import docjson as J
from docengine.operators import tables as X
from docengine.plans import document_pipeline, presets
from docengine.plans.catalog.common import typed_blocks
from docengine.plans.derived import coded_docs
from docengine.sources import adapters, ooxml, templates
from docengine.streaming import runs

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def p(text, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('항목')}{cell('값')}</w:tr><w:tr>{cell('온도')}{cell('1500℃')}</w:tr></w:tbl>"
    drawing = "<w:p><w:r><w:drawing><a:t>①노열확보</a:t><a:t>② 통기성 확보 및</a:t></w:drawing></w:r></w:p>"
    with zipfile.ZipFile(d / "one.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{p('제목', 'Title')}{p('1. 서론', 'Heading1')}{p('본문')}<w:p/>{table}{drawing}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{p('문서번호: TP-030-030-050')}</w:hdr>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="Title"><w:name w:val="Title"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", '<c xmlns:d="x"><d:title>T</d:title><d:creator>A</d:creator></c>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="styles.xml"/></Relationships>')
    (d / "broken.docx").write_bytes(b"no zip")
    (d / "notes.txt").write_text("x")
    (d / "big.pdf").write_bytes(b"0" * 5000)
    return str(d)


def test_docx(spark, folder):
    files, rejected = ooxml.read_files(spark, folder, max_bytes=4000)
    assert {r["name"] for r in rejected.collect()} == {"notes.txt", "big.pdf"}
    e = ooxml.scan_docx(files).cache()
    assert e.filter("kind = 'error'").count() == 1
    assert [(r["text"], r["style"]) for r in ooxml.paragraphs(e).orderBy("block_ord").collect()] == [("제목", "Title"), ("1. 서론", "Heading1"), ("본문", None)]
    assert [r["text"] for r in ooxml.cells(e).orderBy("row", "col").collect()] == ["항목", "값", "온도", "1500℃"]
    assert ooxml.edges(e).first()["text"] == "문서번호: TP-030-030-050"
    assert ooxml.properties(e).first()["properties"] == {"title": "T", "creator": "A"}
    assert ooxml.relationships(e).first()["target"] == "styles.xml"
    steps = X.process_steps(ooxml.drawings(e)).orderBy("sequence").collect()
    assert [(s["sequence"], s["title"]) for s in steps] == [(1, "노열확보"), (2, "통기성 확보")]


def test_read_documents(spark, folder):
    got = adapters.read_documents(spark, folder)
    assert set(got) == {"docx", "rejected"} and got["rejected"].count() == 2


def test_templates(spark, tmp_path):
    t = {"template_id": "t1", "elements": [{"name": "n", "element_type": "fixed", "extraction_method": "regex", "patterns": ["a", "b"], "required": True}], "extra": 1}
    (tmp_path / "t1.json").write_text(json.dumps(t))
    (tmp_path / "bad.json").write_text("{")
    heads, elements, patterns = templates.read_templates(spark, str(tmp_path))
    assert (heads.count(), elements.count(), patterns.count()) == (1, 1, 2)
    assert templates.as_template(spark, str(tmp_path), "t1")[1][0] == ("n", "fixed", "regex", True, ["a", "b"])


def test_layout(spark):
    box = spark.createDataFrame([("f", 1, "온도표", [0.0, 0.0, 1.0, 1.0], None, None), ("f", 1, "odd", [0.0], 0.5, "x")], "path string, page_number int, label string, bbox array<double>, confidence double, text string")
    none = box.limit(0)
    got = adapters.normalise_layout(box, none, none, none).collect()
    assert [(r["element_type"], r["confidence"]) for r in got] == [("table", 0.0)]
    assert adapters.normalise_layout(none, none, none, box).first()["bbox"] == [0.0, 0.0, 1000.0, 1000.0]
    quad = spark.range(1).select(X.quad_box(F.array(F.array(F.lit(3.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(5.0)))).alias("b"))
    assert quad.first()["b"] == [0.0, 1.0, 3.0, 5.0]


def test_presets():
    p0 = presets.preset("fast")
    assert p0.level == "basic" and not p0.match_templates
    assert presets.preset("standard", threshold=0.9).threshold == 0.9 and presets.PRESETS["standard"].threshold == 0.7
    assert presets.warnings(presets.preset("basic", apply_templates=True, outputs=("vectors",)))
    with pytest.raises(ValueError):
        presets.preset("none")


@pytest.mark.parametrize("level", ["basic", "standard", "complete"])
def test_pipeline(spark, tmp_path, level):
    sf = "/root/testdata/sf0.001"
    docs, blocks = coded_docs(spark, sf).filter("doc_id < 20"), typed_blocks(spark, sf).filter("doc_id < 20")
    out = document_pipeline.run(docs, blocks, level)
    assert ("vectors" in out) == (level == "complete") and ("template" in out) == (level != "basic")
    document_pipeline.write(out, str(tmp_path))
    back = J.load(spark, f"{tmp_path}/docjson", out["docjson"].schema)
    assert back.count() == 20 and out["quality"].filter("quality is null").count() == 0


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c", False), (1, "", True), (3, "d", None)], "k int, v string, deleted boolean")
    assert {(r["k"], r["v"]) for r in sinks.upsert(a, b, "k").collect()} == {(2, "c"), (3, "d")}


def test_streams(spark, tmp_path):
    s = runs.read_events(spark, "/root/testdata/sf0.001")
    got = runs.run_to_end(runs.tumbling_counts(s), "tumbling", "complete", str(tmp_path / "a"))
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
    assert runs.run_to_end(runs.sessions(s), "sess", "append", str(tmp_path / "b")).count() > 0
    assert runs.run_to_end(runs.running_averages(s), "avgs", "complete", str(tmp_path / "c")).count() == batch.select("user_id").distinct().count()
