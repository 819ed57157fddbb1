"""Small builders of oracle SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Iterable

from ...functions import fixed
from ..derived import CODED, ROWS, duck

CODED_SQL, ROWS_SQL = duck(CODED), duck(ROWS)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(c: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def case(pairs: Iterable[tuple[str, str]], other: str) -> str:
    """pairs of (condition, value)."""
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"


def matches(c: str, patterns: Iterable[str], flags: str = "") -> str:
    return "list_concat(" + ", list_concat(".join(f"regexp_extract_all({c}, {q(flags + p)})" for p in patterns) + ", []::VARCHAR[])" + ")" * (len(list(patterns)) - 1)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def rx(c: str, p: str) -> str:
    return f"regexp_matches({c}, {q(p)})"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def ids(c: str) -> str:
    return matches(c, fixed.IDENTIFIERS, "(?i)")


def joined(c: str) -> str:
    return f"array_to_string({c}, '|')"


CODED_BLOCKS = f"(SELECT doc_id, i - 1 AS block_ord, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM ({CODED_SQL}))))"
PROSE_BLOCKS = "(SELECT doc_id, i - 1 AS block_ord, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"
BLOCK_TYPE = "CASE WHEN block_ord = 1 THEN 'title' WHEN regexp_matches(text, '^\\d+\\.\\s+') OR regexp_matches(text, '^\\d+(\\.\\d+)+\\s+') OR regexp_matches(text, '^[가-힣]\\.\\s+') THEN 'heading' ELSE 'paragraph' END"
