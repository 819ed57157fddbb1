"""Text functions: cleaning, splitting, keyword and identifier extraction, classification of sentences and headings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def has_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def first_case(pairs: Iterable[tuple[object, Column]], other: object) -> Column:
    """The value of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(other))
    for value, cond in pairs:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(other))


def all_matches(c: Column, patterns: Iterable[str], flags: str = "") -> Column:
    """All whole matches, pattern by pattern, repeats kept."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(flags + p), 0) for p in patterns])


def strip_html(c: Column) -> Column:
    """TX-1: tags become spaces, white space is single."""
    return strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def domain_keywords(c: Column) -> Column:
    """KW-1, sorted."""
    words = F.filter(F.array(*[F.lit(w) for w in fixed.DOMAIN_KEYWORDS]), lambda k: F.contains(F.lower(c), k))
    found = F.array_sort(F.array_distinct(F.concat(words, all_matches(c, fixed.UNITS))))
    return F.when(F.length(strip(c)) < 3, F.array().cast("array<string>")).otherwise(found)


def entities(c: Column) -> Column:
    """KW-2."""
    return all_matches(c, fixed.ENTITIES)


def cross_references(c: Column) -> Column:
    """KW-3."""
    return all_matches(c, fixed.CROSS_REFERENCES, "(?iu)")


def token_keywords(c: Column) -> Column:
    """KW-4, sorted."""
    return F.array_sort(F.array_distinct(all_matches(c, fixed.TOKENS)))


def identifiers(c: Column) -> Column:
    """KW-5: six patterns in turn, repeats kept."""
    return all_matches(c, fixed.IDENTIFIERS, "(?i)")


def document_keywords(c: Column) -> Column:
    """KW-6."""
    return F.filter(F.array(*[F.lit(w) for w in fixed.DOCUMENT_KEYWORDS]), lambda k: F.contains(F.lower(c), k))


def document_entities(c: Column) -> Column:
    """KW-7, sorted."""
    return F.array_sort(F.array_distinct(all_matches(c, fixed.DOCUMENT_ENTITIES)))


def sentences(c: Column) -> Column:
    """TX-9: pieces between sentence ends of ten characters or more, stripped."""
    return F.transform(F.filter(F.split(c, r"[.!?]\s+", -1), lambda s: F.length(strip(s)) >= 10), strip)


def sentence_class(c: Column) -> Column:
    """PRJ-9."""
    low = F.lower(c)
    pairs = [(k, has_any(low, w)) for k, w in fixed.SENTENCE_CLASSES]
    return first_case([*pairs, ("technical_reference", c.rlike(fixed.DOCUMENT_NUMBER)), ("numbered_item", c.rlike(r"\d+\.\s"))], "general_statement")


def class_weight(kind: Column) -> Column:
    """SC-13."""
    return first_case([(w, kind == k) for k, w in fixed.SENTENCE_WEIGHTS.items()], 1.0)


def density(c: Column) -> Column:
    """SC-14: identifiers per word times ten, two at most."""
    words = F.size(tokens(c))
    return F.when(words == 0, F.lit(0.0)).otherwise(F.least(F.size(identifiers(c)) / words * 10, F.lit(2.0)))


def section_type(heading: Column) -> Column:
    """PRJ-7."""
    return first_case([(k, has_any(F.lower(heading), w)) for k, w in fixed.SECTION_TYPES], "general")


def section_importance(heading: Column, text: Column) -> Column:
    """SC-11."""
    factor = first_case([(f, has_any(F.lower(heading), w)) for f, w in fixed.SECTION_FACTORS], 1.0)
    dense = F.when(F.size(identifiers(text)) > 5, F.lit(1.1)).otherwise(F.lit(1.0))
    return F.least(F.lit(2.5) * factor * dense, F.lit(3.0))


def content_type(block_type: Column, text: Column) -> Column:
    """PRJ-8."""
    return first_case([("table", block_type == "table"), ("diagram", block_type == "image"), ("reference", has_any(F.lower(text), fixed.REFERENCE_WORDS))], "text")


def block_text(block_type: Column, text: Column) -> Column:
    """TX-10."""
    return F.when(block_type == "table", strip_html(text)).when(block_type == "diagram", F.concat(F.lit("다이어그램 설명: "), text)).otherwise(strip(text))


def block_importance(block_type: Column, text: Column) -> Column:
    """SC-12, with the semantic lists of KW-1 and KW-2."""
    base = first_case([(1.6, block_type == "table"), (1.7, block_type == "diagram")], 1.0)
    return base * F.when(F.size(entities(text)) > 0, F.lit(1.1)).otherwise(F.lit(1.0)) * F.when(F.size(domain_keywords(text)) > 0, F.lit(1.05)).otherwise(F.lit(1.0))


def is_structural(c: Column) -> Column:
    """PRJ-10."""
    return c.rlike("|".join(f"(?:{p})" for p in fixed.STRUCTURAL))


def is_heading(c: Column) -> Column:
    """PRJ-11."""
    return (F.length(c) > 0) & (F.length(c) <= 100) & c.rlike("|".join(f"(?:{p})" for p in fixed.HEADINGS))


def heading_level(c: Column, block_type: Column) -> Column:
    """WN-7."""
    return first_case([(1, block_type == "title"), *[(n, c.rlike(p)) for p, n in fixed.HEADING_LEVELS]], 2)


def dotted_level(c: Column) -> Column:
    """WN-8: 3, 2, 1 by a dotted number in front, else 0."""
    return first_case([(3, c.rlike(r"^\d+\.\d+\.\d+\s+")), (2, c.rlike(r"^\d+\.\d+\s+")), (1, c.rlike(r"^\d+\.\s+"))], 0)


def style_level(style: Column) -> Column:
    """PRJ-27: heading levels of named styles."""
    low = F.lower(F.coalesce(style, F.lit("")))
    return first_case([(n, low.contains(f"heading {n}") | low.contains(f"제목 {n}")) for n in range(1, 7)], 1)


def section_path(heading: Column, index: Column) -> Column:
    """WN-6: the dotted number in front, else the distance of a Korean mark from its first syllable, else the section's place."""
    number = F.regexp_extract(heading, r"^(\d+(?:\.\d+)*)", 1)
    mark = F.regexp_extract(heading, r"^([가-힣])[.)]", 1)
    return F.when(number != "", F.split(number, r"\.")).when(mark != "", F.array((F.ascii(mark) - ord("가") + 1).cast("string"))).otherwise(F.array((index + 1).cast("string")))


def document_type(explicit: Column, title: Column, file_name: Column) -> Column:
    """PRJ-3."""
    low, name = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(file_name, F.lit("")))
    return F.coalesce(explicit, first_case([*[(k, has_any(low, w)) for k, w in fixed.TITLE_TYPES], *[(k, has_any(name, w)) for k, w in fixed.FILE_TYPES]], fixed.OTHER_TYPE))


def type_by_identifiers(c: Column) -> Column:
    """PRJ-5."""
    return first_case([(k, has_any(F.lower(c), w)) for k, w in fixed.IDENTIFIER_TYPES], fixed.OTHER_TYPE)


def content_structure(c: Column) -> Column:
    """TX-11."""
    return F.struct(
        c.rlike(r"\d+\.").alias("has_numbering"),
        c.rlike(r"[•\-\*]\s").alias("has_bullet_points"),
        (F.size(identifiers(c)) > 0).alias("has_technical_refs"),
        F.size(F.split(c, r"[.!?]", -1)).cast("long").alias("sentence_count"),
        F.size(F.split(c, "\n\n", -1)).cast("long").alias("paragraph_count"),
    )


def shorten(c: Column, most: int = 100) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def fit_length(c: Column, kind: Column) -> Column:
    """TX-7: contents by whole sentences as long as they fit, others by length."""
    limit = first_case([(n, kind == k) for k, n in fixed.CHUNK_LIMITS.items()], 512)
    pieces = F.split(c, r"[.!?]\s+", -1)
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    step = lambda acc, s: F.when(acc["full"] | (F.length(acc["out"]) + F.length(s) > limit), F.struct(acc["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(acc["out"], s, F.lit(". ")).alias("out"), F.lit(False).alias("full")))
    packed = strip(F.aggregate(pieces, start, step, lambda acc: acc["out"]))
    return F.when(F.length(c) <= limit, c).when(kind == "content", packed).otherwise(F.substring(c, F.lit(1), limit))


def text_after(text: Column, keyword: Column) -> Column:
    """EX-7: what follows the keyword, up to the first sentence end or line end, 150 characters at most."""
    at = F.instr(F.lower(text), F.lower(keyword))
    rest = strip(F.substr(text, at + F.length(keyword)))
    cut = F.replace(F.replace(rest, F.lit("."), F.lit(".\n")), F.lit("다."), F.lit("다.\n"))
    return F.when(at > 0, F.substring(strip(F.element_at(F.split(cut, "\n", -1), 1)), 1, 150)).otherwise(F.lit(""))


def prompt(doc_type: Column, section: Column, kind: Column, content: Column, importance: Column) -> Column:
    """TX-12; null parts are left out."""
    tag = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"[{label}: "), c, F.lit("]")))
    return F.concat_ws(" ", tag("문서유형", doc_type), tag("섹션", section), F.concat(F.lit("["), F.upper(kind), F.lit("]")), content, F.when(importance > 1.5, F.lit("[중요]")))
