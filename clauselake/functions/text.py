"""Text expressions: cleaning, search, tokens, numbering, dates. All are built-in Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as blanks besides the line end.
BLANKS = "\t\u000b\u000c    -   　﻿"


def normalize_spaces(c: Column) -> Column:
    """Every blank becomes a space, runs collapse, lines and the whole are trimmed."""
    one = F.regexp_replace(c, f"[{BLANKS}]+", " ")
    return F.btrim(F.regexp_replace(one, r"(?md)^[ \r]+|[ \r]+$", ""), F.lit(" \n\r"))


# Forms of page furniture, as whole lines.
_UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
PAGE_LINES = [
    rf"[^\n]*\bEnvelope\s+ID\s*:\s*{_UUID}[^\n]*", _UUID, r"\d{1,3}", r"[Pp]age\s+\d+(?:\s+of\s+\d+)?", r"\d{1,3}\s+of\s+\d{1,3}", r"-\s*\d{1,3}\s*-",
    r"[\[(]\d{1,3}[\])]", r"\d{1,3}\s*\|\s*[Pp]age", r"[Pp]age\s*\|\s*\d{1,3}",
]


def drop_page_lines(c: Column) -> Column:
    """Without lines that are only a page number, an envelope id or a UUID; at most one empty line in a row."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^[ \t\r]*(?:" + "|".join(PAGE_LINES) + r")[ \t\r]*$"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def natural_key(c: Column) -> Column:
    """Sort key in which numbers of any length count by value: 'Section 10' after 'Section 9'. A number is led by its length."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 5, "0"), digits(x))).otherwise(x)), "")


def _terms(query: str) -> list[tuple[str, bool]]:
    """(term, was it quoted)"""
    return [(m[1], True) if m[1] is not None else (m[2], False) for m in re.finditer(r'"([^"]*)"|(\S+)', query)]


def _groups(query: str) -> list[list[tuple[str, bool]]]:
    """Alternatives of (term, negated), from a query with AND, OR, NOT, -term and quotes."""
    groups: list[list[tuple[str, bool]]] = [[]]
    filled = [False]
    negate = False
    for term, quoted in _terms(query):
        word = "" if quoted else term.upper()
        if negate:  # what follows NOT is a term, whatever it is
            groups[-1].append((term, True))
            negate = False
        elif word == "OR":
            groups.append([])
            filled.append(False)
            continue
        elif word == "NOT":
            negate = True
        elif word != "AND":
            minus = not quoted and term.startswith("-") and len(term) > 1
            groups[-1].append((term[1:] if minus else term, minus))
        filled[-1] = True
    return [g if f else None for g, f in zip(groups, filled)]


def boolean_match(c: Column, query: str) -> Column:
    """Case-insensitive substring search; OR of groups, terms of a group all hold; a blank query matches all, an empty group nothing."""
    if not query.strip():
        return F.lit(True)
    low = F.lower(F.coalesce(c, F.lit("")))

    def group(g) -> Column:
        if g is None:
            return F.lit(False)
        tests = [~low.contains(t.lower()) if n else low.contains(t.lower()) for t, n in g if t]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    return reduce(lambda a, b: a | b, [group(g) for g in _groups(query)])


def positive_terms(query: str) -> list[str]:
    return [t.strip() for g in _groups(query) if g for t, n in g if not n and t.strip()]


def mark_terms(c: Column, terms: list[str], left: str = "<mark>", right: str = "</mark>") -> Column:
    """Terms put between marks, longest first, in any case."""
    if not terms:
        return c
    some = "|".join(re.sub(r"([.\\+*?\[^\]$(){}=!<>|:\-#/])", r"\\\1", t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(c, f"(?i)({some})", f"{left}$1{right}")


def tokens(c: Column, longer_than: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Set of lower-case letter runs longer than a bound, without stop words, in order of first use."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda x: F.length(x) > longer_than)
    return F.array_except(parts, F.array(*[F.lit(s) for s in stop])) if stop else F.array_distinct(parts)


def excerpt(c: Column, pattern: str, before: int = 40, after: int = 80) -> Column:
    """The text around the first match: from ``before`` characters ahead of it to ``after`` behind its start."""
    head = F.regexp_extract(c, rf"(?s)^(.*?)(?:{pattern})", 1)
    start = F.greatest(F.length(head) - before, F.lit(0))
    return F.when(c.rlike(pattern), F.substring(c, start + 1, F.length(head) + after - start))


def occurrences(c: Column, term: str) -> Column:
    """Offsets (from 0) of the non-overlapping occurrences of a term, in any case."""
    lengths = F.transform(F.split(F.lower(c), r"\Q" + term.lower() + r"\E", -1), F.length)
    n = len(term)
    ends = F.aggregate(F.slice(lengths, 1, F.size(lengths) - 1), F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(F.nullif(acc, F.array().cast("array<int>")), -1) + n, F.lit(0)) + x)))
    return F.coalesce(ends, F.array().cast("array<int>"))


def fixed_slices(c: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / size).cast("int") - 1, F.lit(0))), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def first_word(c: Column) -> Column:
    return F.nullif(F.split_part(c, F.lit(" "), F.lit(1)), F.lit(""))


def other_words(c: Column) -> Column:
    """What follows the first space; the whole if there is none."""
    return F.nullif(F.substring(c, F.locate(" ", c) + 1, F.length(c)), F.lit(""))


#: Roman numerals from I to XXXIX.
ROMAN = r"(?=[IVX])X{0,3}(?:IX|IV|V?I{0,3})"

# Numbering schemes told apart by their headings, in order of preference.
SCHEMES = {
    "roman-upper": rf"\n\s*(?:{ROMAN})\.\s+[A-Z][A-Z\s]",
    "section": r"(?i)\n\s*Section\s+\d+\.",
    "article": r"(?i)\n\s*Article\s+\d+",
    "article-roman": r"\n\s*ARTICLE\s+[IVX]+",
    "decimal-triple-period": r"\n\s*\d+\.\d+\.\d+\.\s+",
    "decimal-period": r"\n\s*\d+\.\d+\.\s+",
    "numeric": r"\n\s*\d+\.\s+[A-Z][A-Z\s]{3,}",
    "numeric-title": r"\n\s*\d+\.(?!\d)\s+[A-Z][a-z]",
    "numeric-bare": r"\n\s*\d+\s+[A-Z]{2}[A-Z\s]{1,}",
}


def numbering_scheme(c: Column) -> Column:
    """The scheme with most headings, the first of equals, roman-upper if none; top-level numbers win over decimals when there are three."""
    votes = {k: F.regexp_count(c, F.lit(p)) for k, p in SCHEMES.items()}
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("k")) for i, (k, n) in enumerate(votes.items())]))
    top = F.greatest(votes["numeric"], votes["numeric-title"])
    plain = F.when(best["n"] > 0, best["k"]).otherwise("roman-upper")
    return F.when((plain == "decimal-period") & (top >= 3), F.when(votes["numeric-title"] >= votes["numeric"], "numeric-title").otherwise("numeric")).otherwise(plain)


STEER_VERBS = ("ignore", "disregard", "forget", "override", "bypass", "skip")
STEER_OBJECTS = ("instructions?", "prompts?", "rules?", "guidelines?", "directions?")
STEER_ROLES = ("system", "assistant", "developer")


def steering(verbs: Sequence[str] = STEER_VERBS, objects: Sequence[str] = STEER_OBJECTS, roles: Sequence[str] = STEER_ROLES, between: int = 4) -> str:
    """Pattern of text that addresses a language model: a verb and its object with few words between, or a role in brackets or before a colon."""
    order = rf"\b(?:{'|'.join(verbs)})\b(?:\s+\w+){{0,{between}}}?\s+(?:{'|'.join(objects)})\b"
    who = "|".join(roles)
    return rf"(?i)({order}|[<\[]\s*/?\s*(?:{who})\s*[>\]]|\b(?:{who})\s+(?:prompt|message)\s*:)"


def neutralize(c: Column, longest: int | None = None, pattern: str | None = None) -> Column:
    """Control characters dropped, steering phrases bracketed, cut at ``longest`` with a note if a length is given; null gives ''."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, pattern or steering(), "[BLOCKED: $1]")
    if longest is None:
        return t
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("\n[Content truncated]"))).otherwise(t)


def first_matching(c: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The label of the first rule (label, regular expression) that occurs in the text."""
    out = F.lit(None).cast("string") if default is None else default
    for label, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def all_matching(c: Column, rules: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in rules]))
