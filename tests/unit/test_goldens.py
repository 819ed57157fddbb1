"""Values that are published or can be worked out by hand."""

import pytest
from pyspark.sql import functions as F

from docengine.functions import fields as V
from docengine.functions import text as T
from docengine.operators import blocks as B
from docengine.operators import matching as M


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_recognition_score(spark):
    got = one(spark, V.recognition_score(F.lit("TP-030-030-050"), F.lit("t"), F.lit("25.07.28"), F.lit("a"), F.lit("10"), F.lit(3), F.lit(2), F.lit(7), F.lit(5)))
    assert got == pytest.approx(90.9090909090909)


def test_element_score(spark):
    docs = spark.createDataFrame([(1, "4.1 something\nelse")], "doc_id long, text string")
    assert M.element_scores(docs).first()["score"] == pytest.approx(0.12962962962962962)


def test_stage_quality(spark):
    none = F.lit(None).cast("double")
    assert one(spark, V.stage_quality(F.lit(0.95), none, none, none, F.lit(True))) == pytest.approx(24.375)
    assert one(spark, V.stage_quality(F.lit(0.95), none, none, none, F.lit(False))) == pytest.approx(23.75)


def test_assessment(spark):
    parts = [(F.lit(99.917585), 0.25), (F.lit(96.66666666666667), 0.35), (F.lit(88.33333333333333), 0.30), (F.lit(100.0), 0.10)]
    assert one(spark, V.assessment(parts)) == pytest.approx(95.31272958333335, abs=1e-4)


def test_numbered_sections(spark):
    rows = [(1, k, t) for k, t in enumerate(["4.1 노황변동의 의미", "4.2 노황복구 수순", "4.2.1 노열확보", "1. 적용범위"])]
    got = B.numbered_sections(spark.createDataFrame(rows, "doc_id long, block_ord int, text string")).orderBy("block_ord").collect()
    assert [r["level"] for r in got] == [2, 2, 3]


def test_token_keywords(spark):
    assert one(spark, T.token_keywords(F.lit("4.1 노황변동의 의미"))) == ["노황변동의", "의미"]


@pytest.mark.parametrize(("text", "kind", "want"), [("a" * 512, "content", "a" * 512), ("b" * 600 + ". tail", "content", ""), ("One two. " * 100, "content", None), ("x" * 300, "metadata", "x" * 200)])
def test_fit_length(spark, text, kind, want):
    got = one(spark, T.fit_length(F.lit(text), F.lit(kind)))
    assert got == want if want is not None else len(got) <= 513 and got.endswith(".")


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \t")], "doc_id long, text string")
    assert B.flatten_blocks(docs).count() == 2
    assert B.sentence_units(B.flatten_blocks(docs)).count() == 0
    assert {r["k"] for r in docs.select(F.size(T.identifiers(F.coalesce("text", F.lit("")))).alias("k")).collect()} == {0}


def test_section_path_and_level(spark):
    assert one(spark, T.section_path(F.lit("4.2.1 x"), F.lit(0))) == ["4", "2", "1"]
    assert one(spark, T.section_path(F.lit("나. x"), F.lit(0))) == ["1177"]
    assert one(spark, T.section_path(F.lit("x"), F.lit(3))) == ["4"]
    assert [one(spark, T.heading_level(F.lit(t), F.lit("heading"))) for t in ("1. a", "1.1 a", "1.1.1 a", "가. a", "(가) a", "a")] == [1, 2, 3, 2, 3, 2]


def test_similarity(spark):
    sim = lambda a, b: one(spark, V.similarity(F.lit(a), F.lit(b)))
    assert (sim("Ab ", "ab"), sim("", "x"), sim("ab", "abcd"), sim("a b c", "a x y z")) == (1.0, 0.0, 0.5, 0.25)
    assert sim("0123456789zz", "  0123456789yy") == 0.7


def test_sizes_and_types(spark):
    rows = spark.createDataFrame([("100MB",), ("1.5kb",), ("7",), ("x",)], "s string").select(V.size_bytes(F.col("s")).alias("n")).collect()
    assert [r["n"] for r in rows] == [104857600, 1536, 7, None]
    assert one(spark, V.file_type(F.lit("/a.b/C.DOCX"))) == "docx"
