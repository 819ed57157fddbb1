"""Secret scans over a trigram inverted index; DataFrame and SQL functions only.

Each rule's regular expression gives a Boolean trigram query: every match contains one string of each of a few sets, so
its text (lower-cased) has all trigrams of one string of each set. The index holds, for the trigrams that the rules ask
for, postings of the texts that contain them. A rule's postings are intersected and united as its query says; only the
texts that remain are searched by that rule. A rule without a mandatory trigram searches all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_wanted

try:  # the parser of the standard library's regular expressions
    from re import _constants as sre_constants
    from re import _parser as sre_parser
except ImportError:  # Python before 3.11
    import sre_constants
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` of it has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base rules, then common formats of published keys.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # maximal runs; shorter ones are dropped anyway
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

SPANS = "array<struct<start:long,ord:int,end:long,kind:string>>"
#: Lengths summed up at a time.
BLOCK = 256
#: A set of alternatives larger than this is no longer followed.
MOST_STRINGS = 64


def _strings(items: list, groups: list[list[str]]) -> list[str] | None:
    """All (lower-cased) strings that a parsed sequence can match if they are few, else None; sets on the way go to ``groups``."""
    now: list[str] | None = [""]

    def flush() -> None:
        if now and min(map(len, now)) >= 3:
            groups.append(list(now))

    exact = True
    for op, arg in items:
        part = _one(op, arg, groups)
        if part is not None and now is not None and len(now) * len(part) <= MOST_STRINGS:
            now = sorted({a + b for a in now for b in part})
            continue
        flush()
        exact = False
        now = part if part is not None else [""]
    if exact:
        return now
    flush()
    return None


def _one(op: object, arg: object, groups: list[list[str]]) -> list[str] | None:
    c = sre_constants
    if op is c.LITERAL:
        return [chr(arg).lower()]
    if op is c.IN:
        out = set()
        for kind, v in arg:
            if kind is c.LITERAL:
                out.add(chr(v).lower())
            elif kind is c.RANGE and v[1] - v[0] < 8:
                out |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
            else:
                return None
        return sorted(out)
    if op is c.SUBPATTERN:
        return _strings(list(arg[3]), groups)
    if op is c.BRANCH:
        inner: list[list[list[str]]] = [[] for _ in arg[1]]
        parts = [_strings(list(x), g) for x, g in zip(arg[1], inner, strict=True)]
        if all(p is not None for p in parts):
            out = sorted({s for p in parts for s in p})
            return out if len(out) <= MOST_STRINGS else None
        return None
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, sub = arg
        if high == 1 and low == 0:
            one = _strings(list(sub), [])
            return None if one is None else sorted({"", *one})
        if low >= 1:
            one = _strings(list(sub), groups)
            if low == high and one is not None and len(one) ** low <= MOST_STRINGS:
                out = [""]
                for _ in range(low):
                    out = [a + b for a in out for b in one]
                return sorted(set(out))
        return None
    return [""] if op in (c.AT, c.ASSERT, c.ASSERT_NOT) else None


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND over clauses of OR over strings of all their trigrams. Empty: no trigram is mandatory."""
    groups: list[list[str]] = []
    whole = _strings(list(sre_parser.parse(pattern)), groups)
    if whole is not None and whole and min(map(len, whole)) >= 3:
        groups.append(whole)
    return [[frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in g] for g in groups]


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """(trigram, doc_id) postings of the asked trigrams: one row for each text and each of them that it contains."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(t[1:])
    found = "(?=(" + "|".join(re.escape(a) + "(?:" + "|".join(map(re.escape, sorted(b))) + ")" for a, b in sorted(by_first.items())) + "))"
    grams = F.array_distinct(F.regexp_extract_all(F.lower(docs[text_col]), F.lit(found), 1))
    return docs.filter(docs[text_col].isNotNull()).select(docs[id_col].alias("doc_id"), F.explode(grams).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the places of the rules whose query the document's postings satisfy; documents without any are left out."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    names = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    words = [names[i : i + 62] for i in range(0, len(names), 62)]
    place = {t: (w, 1 << b) for w, group in enumerate(words) for b, t in enumerate(group)}
    masks = []
    for w, group in enumerate(words):
        bit = F.element_at(F.create_map(*[x for t in group for x in (F.lit(t), F.lit(place[t][1]).cast("long"))]), F.col("trigram"))
        masks.append(F.bit_or(F.coalesce(bit, F.lit(0).cast("long"))).alias(f"m{w}"))
    merged = index.groupBy("doc_id").agg(*masks)

    def has(trigrams: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(len(words)):
            need = sum(place[t][1] for t in trigrams if place[t][0] == w)
            if need:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(need).cast("long")) == need)
        return out

    fit = []
    for k, query in queries.items():
        ok = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for s in clause:
                some = some | has(s)
            ok = ok & some
        fit.append(F.when(ok, F.lit(k)))
    return merged.select("doc_id", F.array_compact(F.array(*fit)).alias("rules")).filter(F.size("rules") > 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(lengths: Column) -> Column:
    """array<array<long>>: for each block of lengths, the sum of all before it, then the running sums in it.

    Appending to an array copies it, so sums run over short blocks, and over the blocks' totals.
    """

    def append(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    return _let(
        blocks,
        lambda of: _let(
            F.aggregate(F.transform(of, lambda s: F.aggregate(s, zero, lambda n, x: n + x)), F.array(zero), append),
            lambda before: F.transform(of, lambda s, b: F.aggregate(s, F.array(F.get(before, b)), append)),
        ),
    )


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of the rule's leftmost matches in code points: lengths of matches and of what is between them."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else hits
    sizes = lambda of: F.transform(of, lambda x: F.length(x).cast("long"))

    def spans(hit: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hit))
        steps = F.zip_with(sizes(gaps), hit, lambda gap, n: gap + n)
        ends = _let(steps, lambda all_steps: F.flatten(F.transform(_sums(all_steps), lambda s: F.slice(s, F.lit(2), F.size(s) - 1))))
        parts = F.arrays_zip(hit.alias("n"), (sizes(counted) if rule.group else hit).alias("counted"), ends.alias("end"))
        parts = F.filter(parts, lambda x: x["counted"] >= rule.least) if rule.least else parts
        return F.transform(parts, lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return F.when(text.rlike(rule.pattern), _let(sizes(hits), spans)).otherwise(F.array().cast(SPANS))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): all matches as array<struct<start, ord, end, kind>>, by start, then by the order of the rules.

    A row for each row of ``docs``; a null text is an empty one, without matches. Rows of one id, null ids too, share their
    candidates, which are verified on each row's own text. An empty table gives an empty one; other columns aren't read.
    The work grows with the text and its matches, however many one text has. Only texts that a Bloom filter of fixed size
    lets through are shuffled to their candidates' rows, at every size of the table.
    """
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    indexed = {k for k, r in enumerate(rules) if trigram_query(r.pattern)}
    trigrams = sorted({t for k in indexed for clause in trigram_query(rules[k].pattern) for s in clause for t in s})
    text = F.coalesce("text", F.lit(""))

    def found(wanted: Column | None) -> Column:
        """The spans of the rules that are not indexed, and of those wanted."""
        each = []
        for k, r in enumerate(rules):
            if k not in indexed:
                each.append(rule_spans(text, r, k))
            elif wanted is not None:
                each.append(F.when(F.array_contains(wanted, k), rule_spans(text, r, k)).otherwise(F.array().cast(SPANS)))
        return (F.array_sort(F.concat(*each)) if each else F.array().cast(SPANS)).alias("spans")

    if not trigrams:
        return own.select("doc_id", found(None))
    asked = materialize(candidates(trigram_index(own, trigrams, "doc_id", "text"), rules).select(F.col("doc_id").alias("key"), "rules"), "candidates")
    marked = maybe_wanted(own, "doc_id", asked, "key", "may")
    searched = marked.filter("may").join(asked, marked["doc_id"].eqNullSafe(asked["key"]), "left")
    none = F.array().cast("array<int>")
    return searched.select("doc_id", found(F.coalesce("rules", none))).union(marked.filter("NOT may").select("doc_id", found(None)))


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
