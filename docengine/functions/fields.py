"""Field functions: types, importance, names, rules, header values, similarity, geometry and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import first_case, has_any, strip


def is_significant(c: Column) -> Column:
    """PRJ-12."""
    n = F.length(strip(c))
    return (n >= 3) & (n <= 200) & c.rlike(r"[\p{L}\p{N}]")


def field_type(c: Column, section: Column) -> Column:
    """PRJ-13."""
    digits = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(""))
    return first_case([("date", c.rlike(fixed.DATE_LIKE)), ("code", c.rlike(fixed.CODE_LIKE)), ("number", digits.rlike(r"^\d+$")), ("title", (section == "title") | F.lower(c).contains("제목"))], "text")


def field_importance(c: Column, kind: Column) -> Column:
    """PRJ-14."""
    return first_case([("critical", has_any(F.lower(c), fixed.CRITICAL_WORDS)), *[(v, kind == k) for k, v in fixed.TYPE_IMPORTANCE.items()]], "medium")


def field_name(c: Column) -> Column:
    """PRJ-15."""
    bare = F.regexp_replace(F.substring(strip(c), 1, 30), r"[^\p{L}\p{N}_\s]", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"\s+", "_"), F.lit("")), F.lit("auto_field"))


def validation_rules(kind: Column) -> Column:
    """PRJ-16, as a map of texts."""
    rules = {"date": {"pattern": fixed.DATE_LIKE, "required": "false"}, "code": {"pattern": "[A-Z0-9-]+", "min_length": "5", "required": "true"}, "number": {"type": "numeric", "required": "false"}, "text": {"max_length": "500", "required": "false"}}
    made = lambda r: F.create_map(*[F.lit(x) for kv in r.items() for x in kv])
    out = made({"required": "false"})
    for k, r in rules.items():
        out = F.when(kind == k, made(r)).otherwise(out)
    return out


def value_type(c: Column) -> Column:
    """PRJ-17."""
    v = strip(c)
    return first_case([("code", v.rlike(r"^[A-Z]{2,4}-\d{3}-\d{3}-\d{3}$")), ("date", v.rlike(r"^\d{2}\.\d{2}\.\d{2}$")), ("version", v.rlike(r"^Rev\.?\s*\d+$")), ("title", (F.length(v) < 50) & has_any(v, ["기준", "표준"]))], "text")


def name_importance(c: Column) -> Column:
    """PRJ-18."""
    return first_case([(k, has_any(F.lower(c), w)) for k, w in fixed.NAME_IMPORTANCE], "medium")


def block_location(x1: Column, y1: Column) -> Column:
    """PRJ-21."""
    return first_case([("header", y1 < 150), ("footer", y1 > 600), ("left", x1 < 200), ("right", x1 > 400)], "center")


def suggested_field(c: Column) -> Column:
    """PRJ-26: the name of the field that a block suggests, else null."""
    t = strip(c)
    out = F.when(t.contains("TP-") & (F.length(t) < 50), F.lit("문서번호")).when((F.length(t) < 50) & ~t.rlike(r"^\d") & has_any(t, ["기준", "표준", "조치", "관리"]), F.lit("제목"))
    for k in range(1, 6):
        out = out.when(t.startswith(f"{k}."), F.lit(f"항목_{k}"))
    return out


def document_number(c: Column) -> Column:
    """EX-1; null if there is none, as below."""
    return F.nullif(F.regexp_extract(c, r"TP-\d{3}-\d{3}-\d{3}", 0), F.lit(""))


def revision(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"Rev[\.\s]*:\s*(\d+)", 1), F.lit(""))


def effective_date(c: Column) -> Column:
    near, far = r"""시행일[:\s]*['"]?\s*(\d{2,4})[.\-/](\d{1,2})[.\-/](\d{1,2})""", r"""(?s)시행일.*?['"]?\s*(\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})"""
    made = lambda p: F.when(F.regexp_extract(c, p, 1) != "", F.concat_ws(".", F.regexp_extract(c, p, 1), F.lpad(F.regexp_extract(c, p, 2), 2, "0"), F.lpad(F.regexp_extract(c, p, 3), 2, "0")))
    return F.coalesce(made(near), made(far))


def similarity(a: Column, b: Column) -> Column:
    """SC-5."""
    return F.coalesce(similarity_of(prepared(a), prepared(b)), F.lit(0.0))


def prepared(c: Column) -> Column:
    """What ``similarity_of`` needs of a text: null if it is null or empty."""
    low = F.btrim(F.lower(c), F.lit(" \t\n\x0b\f\r"))
    words = F.array_distinct(F.split(low, r"\s+"))  # no end is white space; blank texts are decided before words count
    return F.when(c != "", F.struct(low.alias("low"), words.alias("words")))


def similarity_of(a: Column, b: Column, least: float = 0.0) -> Column:
    """SC-5 of two prepared texts; null if one is null, or if their numbers of words show that it is below ``least``."""
    x, y, p, q = a["low"], b["low"], a["words"], b["words"]
    most = F.greatest(F.size(p), F.size(q), F.lit(1))
    common = F.size(F.array_intersect(p, q)) / most
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(x == y, F.lit(1.0)).when(F.contains(y, x), F.length(x) / F.length(y)).when(F.contains(x, y), F.length(y) / F.length(x)).when((F.length(x) >= 10) & F.contains(y, F.substring(x, 1, 10)), F.lit(0.7)).when(F.least(F.size(p), F.size(q)) / most >= least, common)


def position_score(y1: Column, y2: Column, lo: Column, hi: Column, typical: Column) -> Column:
    """JN-6: seven tenths for the place, three for the height."""
    middle = (y1 + y2) / 2
    return F.when((middle >= lo) & (middle <= hi), F.lit(0.7)).otherwise(F.lit(0.0)) + F.lit(0.3) * F.greatest(F.lit(0.0), F.lit(1.0) - F.abs((y2 - y1) - typical) / typical)


def box_quality(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """SC-4's quality of one box."""
    return F.when((x2 > x1) & (y2 > y1), F.when((x2 - x1).between(5, 800) & (y2 - y1).between(5, 100), F.lit(1.0)).otherwise(F.lit(0.5))).otherwise(F.lit(0.2))


def recognition_score(number: Column, title: Column, date: Column, author: Column, rev: Column, sections: Column, tables: Column, diagrams: Column, metadata: Column) -> Column:
    """SC-1."""
    points = lambda c, n: F.when(c, F.lit(float(n))).otherwise(F.lit(0.0))
    given = lambda c: c.isNotNull() & (c != "")
    total = points(given(number), 20) + points(given(title), 20) + points(given(date), 20) + points(given(author), 10) + points(given(rev), 10) + points(sections >= 4, 10) + points(tables >= 1, 10) + points(diagrams > 0, 5) + points(metadata > 3, 5)
    return total / 110.0 * 100.0


def flow_confidence(first: Column, last: Column, n: Column) -> Column:
    """SC-9."""
    base = F.when(last - first + 1 == n, F.lit(0.7)).otherwise(F.lit(0.5))
    return F.when(n == 0, F.lit(0.0)).when(n < 2, F.lit(0.5)).otherwise(F.least(F.lit(1.0), base + F.least(F.lit(0.2), n * F.lit(0.05))))


def stage_quality(parsing: Column, template: Column, annotation: Column, vector: Column, output: Column) -> Column:
    """SC-10: the mean of the weighted parts that a run has; the annotation counts where no template does. ``output`` is a flag."""
    parts = F.filter(F.array(parsing * 25.0, F.coalesce(template * 35.0, annotation * 30.0), vector * 10.0, F.when(output, F.lit(25.0))), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))


def workflow_score(confidence: Column, essential: Column, files: Column, seconds: Column) -> Column:
    """SC-15: ``files`` is the share of outputs written."""
    return confidence * 40.0 + essential / 3.0 * 30.0 + files * 20.0 + F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.lit(10.0) - seconds))


def assessment(parts: list[tuple[Column, float]]) -> Column:
    """SC-17: weighted mean over the parts that are there."""
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def template_similarity(n: Column, m: Column) -> Column:
    """SC-16."""
    return F.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(F.least(n, m) / F.greatest(n, m))


def importance_threshold(c: Column) -> Column:
    """SNK-15."""
    return first_case([(0.95, c == "critical"), (0.8, c == "high"), (0.7, c == "medium")], 0.6)


def size_bytes(c: Column) -> Column:
    """SRC-5: "10MB" and the like in bytes."""
    number = F.regexp_extract(F.upper(strip(c)), r"^([0-9.]+)\s*(KB|MB|GB)?$", 1).try_cast("double")
    unit = F.regexp_extract(F.upper(strip(c)), r"(KB|MB|GB)$", 1)
    return (number * first_case([(1024.0, unit == "KB"), (1048576.0, unit == "MB"), (1073741824.0, unit == "GB")], 1.0)).cast("long")


def file_type(path: Column) -> Column:
    """SRC-1."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return first_case([("docx", suffix == ".docx"), ("pptx", suffix == ".pptx"), ("pdf", suffix == ".pdf"), ("image", suffix.isin(".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp"))], "unknown")


def page_estimate(paragraphs: Column, tables: Column) -> Column:
    """SRC-25."""
    return F.greatest(F.lit(1), (F.floor(paragraphs / 40) + F.floor(tables / 2) + 1).cast("int"))
