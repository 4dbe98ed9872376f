"""Expressions for a library of clauses and documents: filters, headings, types, parties, flags.

All are built-in Column expressions; vocabularies, rules and patterns are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions import text as X
from clauselake.functions.dates import parse_date

# --- filters ---


def any_contains(columns: Sequence[Column], query: str) -> Column:
    """Some column holds the query, in any case; a blank query holds everywhere."""
    q = query.strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False)) for c in columns]) if q else F.lit(True)


def composite(equal: Mapping[str, object] | None = None, among: Mapping[str, Sequence[object]] | None = None, search: tuple[Sequence[str], str] | None = None, boolean: tuple[str, str] | None = None, bypass: Column | None = None) -> Column:
    """One predicate from what is set: equal columns, columns among values, a substring in any column, a boolean query.

    None and empty lists ask for nothing. Rows for which ``bypass`` holds need only the searches."""
    tests = [F.col(k) == F.lit(v) for k, v in (equal or {}).items() if v is not None] + [F.col(k).isin(list(v)) for k, v in (among or {}).items() if v]
    hard = reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))
    soft = (any_contains([F.col(c) for c in search[0]], search[1]) if search else F.lit(True)) & (X.boolean_match(F.col(boolean[0]), boolean[1]) if boolean else F.lit(True))
    return soft & (hard if bypass is None else hard | F.coalesce(bypass, F.lit(False)))


def candidate(c: Column, wanted: Sequence[str], unwanted: Sequence[str]) -> Column:
    """Some wanted pattern occurs and no unwanted one; null is no candidate."""
    return F.coalesce(c.rlike("(?i)" + "|".join(wanted)) & ~c.rlike("(?i)" + "|".join(unwanted)), F.lit(False))


def acceptable_file(name: Column, kinds: Sequence[str] = ("pdf", "docx", "doc", "txt")) -> Column:
    return F.coalesce(name.rlike(rf"(?i)\.(?:{'|'.join(kinds)})$"), F.lit(False))


def badge(effects: Column, held: Column, labels: Mapping[str, str], several: str) -> Column:
    """Null if there is nothing or the category is held already; one known effect by its label; else ``several``."""
    e = F.array_distinct(effects)
    one = reduce(lambda acc, kv: F.when(F.get(e, F.lit(0)) == kv[0], kv[1]).otherwise(acc), labels.items(), F.lit(several))
    return F.when(held | (F.size(e) <= 0), F.lit(None).cast("string")).when(F.size(e) == 1, one).otherwise(several)


# --- types ---


def type_key(c: Column) -> Column:
    """Letters and digits with one blank between the runs, lower case."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def normalized_type(c: Column, names: Sequence[str], aliases: Mapping[str, str], default: str | None = None, least: int = 6) -> Column:
    """The name of a vocabulary for free text, by tiers: the name itself, a known alias, then the first name that holds the text or is held by it (both of at least ``least`` letters)."""
    k = type_key(c)
    pairs = [(n.lower(), n) for n in names] + [(a.lower(), n) for a, n in aliases.items()]
    known = F.create_map(*[F.lit(x) for kv in dict(reversed(pairs)).items() for x in kv])
    table = F.array(*[F.struct(F.lit(n.lower()).alias("k"), F.lit(n).alias("n")) for n in names])
    part = F.filter(table, lambda x: (F.length(x["k"]) >= least) & (F.length(k) >= least) & (x["k"].contains(k) | k.contains(x["k"])))
    return F.coalesce(F.try_element_at(known, k), F.get(part, F.lit(0))["n"], F.lit(default))


def typed_heading(title: Column, table: Sequence[tuple[str, str]], longest: int = 80) -> Column:
    """Type of the first key word of the table that a title holds; long titles are sentences and have none."""
    low = F.lower(title)
    out = F.lit(None).cast("string")
    for word, kind in reversed(table):
        out = F.when(low.contains(word), kind).otherwise(out)
    return F.when(F.length(title) <= longest, out)


def typed_content(c: Column, rules: Sequence[tuple[str, str, int]], head: int = 200, default: str | None = None) -> Column:
    """Type of the first rule (type, pattern, least hits) that the head of a text satisfies."""
    top = F.substring(c, 1, head)
    out = F.lit(default).cast("string")
    for kind, pattern, least in reversed(rules):
        out = F.when(F.regexp_count(top, F.lit("(?i)" + pattern)) >= least, kind).otherwise(out)
    return out


def single_hit(c: Column, rules: Sequence[tuple[str, str]], head: int) -> Column:
    """The label of the only rule (label, pattern) that the head of a text satisfies; null for none or several."""
    hits = X.all_matching(F.substring(c, 1, head), [(k, "(?i)" + p) for k, p in rules])
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


# --- headings ---

_KIND = r"(?:(?i:section|article|clause)\s+)"
_NUMBER = r"(?:\d+(?:\.\d+)*|[IVXLC]+(?=[.)])|[A-Z](?=[.)]))"
HEADING = rf"^\s*(?:({_KIND}?{_NUMBER})[.)]?[ \t]+)?([^\n.:]{{1,100}}?)(?:[.:](?=\s)|\n|$)\s*"


def heading(block: Column) -> Column:
    """struct(number, title, body) of a block: its number if it has one, the words up to a full stop, colon or line end, and the rest. Without a title of up to 100 characters all is body."""
    part = lambda g: F.nullif(F.regexp_extract(block, HEADING, g), F.lit(""))
    return F.struct(part(1).alias("number"), F.nullif(F.trim(part(2)), F.lit("")).alias("title"), F.regexp_replace(block, HEADING, "").alias("body"))


def display_number(number: Column, ident: Column) -> Column:
    """Leading numeric token of a clause number, else the ordinal at the end of its id without leading zeros."""
    return F.coalesce(F.nullif(F.regexp_extract(number, r"^\s*(\d+(?:\.\d+)*)", 1), F.lit("")), F.nullif(F.regexp_extract(ident, r"0*(\d+)$", 1), F.lit("")))


def subclauses(c: Column, least: int = 30) -> Column:
    """Parts of a catch-all clause: at lettered or numbered items, else at blank lines, else at sentences; parts shorter than ``least`` are left out."""
    ways = [r"\s+(?=\([a-z0-9]{1,3}\)\s)", r"\n\s*\n", r"(?<=[.;])\s+(?=\p{Lu})"]
    long = lambda w: F.filter(F.transform(F.split(c, w), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    a, b, s = (long(w) for w in ways)
    return F.when(F.size(a) > 1, a).when(F.size(b) > 1, b).otherwise(s)


def cleaned(c: Column) -> Column:
    """Text for reading: line ends unified, page lines and page marks inside lines out, words cut at line ends joined, blanks collapsed."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = X.drop_page_lines(t)
    t = F.regexp_replace(t, r"[ \t]*[\[(]?\b[Pp]age \d{1,4} of \d{1,4}\b[\])]?", "")
    t = F.regexp_replace(t, r"(\p{Ll})-\n(\p{Ll})", "$1$2")
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


# --- people, places, dates in text ---

LEGAL_FORMS = ("Inc", "LLC", "Ltd", "Corp", "Group", "LLP", "PLC", "GmbH", "Company", "Corporation", "Limited")


def legal_names(c: Column, forms: Sequence[str] = LEGAL_FORMS, words: int = 4) -> Column:
    """Names that end in a legal form: up to ``words`` capitalised words before it. Each once, in order."""
    p = rf"\b(?:\p{{Lu}}[\p{{L}}&'’-]*,?\s){{1,{words}}}(?:{'|'.join(forms)})\b\.?"
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), lambda x: F.regexp_replace(x, r"^(?:The|This|That|By|Between|And|With|Each|For|At|On)\s", "")))


def defined_terms(c: Column) -> Column:
    """array<struct<label, name>> of names followed by their label: 'Acme Ltd. (the "Vendor")'."""
    word = r"\p{Lu}[\p{L}\p{N}&.'’-]*"
    p = rf"({word}(?:,?\s+(?:(?:of|and|the|&)\s+)?{word}){{0,7}})\s*\((?:hereinafter\s+)?(?:the\s+)?[\"“]([^\"”]{{1,40}})[\"”]\)"
    names, labels = (F.regexp_extract_all(c, F.lit(p), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(labels.alias("label"), names.alias("name")), lambda x: F.struct(x["label"].alias("label"), F.trim(x["name"]).alias("name")))


def without_alias(c: Column) -> Column:
    """'Acme Ltd. (the "Vendor")' or 'Acme Ltd., a Delaware company' without what follows the name."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""), r",\s+(?:an?|the)\s.*$", ""))


def governing_law(c: Column, places: Sequence[str]) -> Column:
    """The place whose law governs, if it is one of the list: after 'governed by' or 'laws of'; the first pattern that gives one counts."""
    some = "|".join(sorted(places, key=len, reverse=True))
    of = rf"(?i:\blaws?\s+of\s+(?:the\s+)?(?:state\s+of\s+)?)({some})\b"
    ways = [rf"(?i:governed\s+by)\b[^.]{{0,80}}?{of}", of, rf"\b({some})\s+law\s+(?:governs|applies|shall)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(c, w, 1), F.lit("")) for w in ways])


def labelled_date(c: Column, labels: Sequence[str]) -> Column:
    """The first readable date behind one of the labels, in their order."""
    date = r"(\d{1,2}/\d{1,2}/\d{4}|[A-Z][a-z]+\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}|\d{1,2}(?:st|nd|rd|th)?\s+day\s+of\s+[A-Z][a-z]+,?\s+\d{4})"
    return F.coalesce(*[parse_date(F.nullif(F.regexp_extract(c, rf"(?i:{w})[\s:,]*(?:(?i:on|of|as of|is)\s+)?{date}", 1), F.lit(""))) for w in labels])


# --- flags, summaries, names ---


def flags(conditions: Sequence[tuple[str, Column]]) -> Column:
    """struct(flags, needs_review, reason): names of the conditions that hold, in order; unknown holds not."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions]))
    return F.struct(hit.alias("flags"), (F.size(hit) > 0).alias("needs_review"), F.nullif(F.array_join(hit, "; "), F.lit("")).alias("reason"))


def keywords(c: Column, terms: Sequence[str]) -> Column:
    """The terms that a text holds, in any case, in their order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: low.contains(F.lower(t)))


def joined_summary(action: Column, condition: Column, mark: str = " — ") -> Column:
    return F.nullif(F.concat_ws(mark, F.nullif(F.trim(action), F.lit("")), F.nullif(F.trim(condition), F.lit(""))), F.lit(""))


def slug(c: Column) -> Column:
    """'Data & Privacy' -> 'data-privacy'."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def label_of(namespaced: Column) -> Column:
    """'vendor.cloud_hosting' -> 'Cloud Hosting'."""
    return F.initcap(F.regexp_replace(F.element_at(F.split(namespaced, r"\."), -1), "_", " "))


def as_values(c: Column) -> Column:
    """A JSON array, a delimited string or a single value as an array of trimmed strings; null and blank give []."""
    plain = F.transform(F.split(c, r"\s*[;,]\s*"), lambda x: F.trim(x))
    values = F.when(c.rlike(r"^\s*\["), F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))).otherwise(plain)
    return F.coalesce(F.filter(values, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def unite(a: Column, b: Column) -> Column:
    """a, then what b adds, compared without case; the first spelling stays."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    low = F.transform(both, lambda x: F.lower(F.trim(x)))
    return F.filter(both, lambda x, i: (F.trim(x) != "") & (F.array_position(low, F.lower(F.trim(x))) == i + 1))


def band(score: Column, levels: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first level (from the highest) that the score reaches."""
    out = F.lit(rest)
    for low, name in sorted(levels):
        out = F.when(score >= low, name).otherwise(out)
    return F.when(score.isNotNull(), out)
