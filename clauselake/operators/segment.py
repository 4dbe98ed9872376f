"""Contract text cut into numbered sections, with array functions; one pass, no shuffle.

Steps: heading repair, page lines dropped, numbering scheme voted (or given), split before headings,
preamble dropped, blocks without a heading joined to the section before, short and repeated blocks left
out, heading and body told apart, body located in the original text.

Edge cases: null and blank text give no sections; text without headings is cut at blank lines; a body
that is not found verbatim in the original has null offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import ROMAN, drop_page_lines, normalize_spaces, numbering_scheme

# Number kinds of headings, and what they stand between; a scheme is a kind, its marks and what follows.
_KINDS = {"n": r"\d+", "n.n": r"\d+\.\d+", "n.0": r"\d+\.0", "n.n.n": r"\d+\.\d+\.\d+", "A": "[A-Z]", "a": "[a-z]", "I": ROMAN, "i": ROMAN.lower()}
_WORD = r"(?:Article|ARTICLE)\s+"


def _form(kind: str, before: str = "", after: str = "", then: str = r"\s", word: str = "") -> str:
    return rf"{word}{before}(?:{_KINDS[kind]}){after}{then}"


_CAPITAL, _DOT, _LAST_DOT = r"\s+[A-Z]", r"\.", r"\.(?!\d)"
HEADING = {
    "numeric": _form("n", after=_LAST_DOT, then=_CAPITAL), "numeric-title": _form("n", after=_LAST_DOT, then=_CAPITAL), "numeric-bare": _form("n", then=_CAPITAL),
    "section": _form("n", after=_DOT, then="", word=r"(?i:Section)\s+"), "section-decimal": _form("n", after=_LAST_DOT, then="", word=r"(?i:Section)\s+"),
    "section-bare": rf"(?:Section|Article|ARTICLE)\s+(?:{ROMAN}|\d+)(?!\.)", "article": rf"{_WORD}(?:{ROMAN}|\d+)", "article-roman": _form("I", then="", word=_WORD),
    "decimal": _form("n.n", then=_CAPITAL), "decimal-zero": _form("n.0", then=_CAPITAL), "decimal-period": _form("n.n", after=_DOT), "decimal-triple": _form("n.n.n"), "decimal-triple-period": _form("n.n.n", after=_DOT),
    "alpha-upper": _form("A", after=_DOT, then=_CAPITAL), "alpha-lower": _form("a", after=_DOT, then=_CAPITAL), "roman-upper": _form("I", after=_DOT, then=_CAPITAL), "roman-lower": _form("i", after=_DOT),
} | {f"{name}-paren": _form(k, after=r"\)", then=then) for name, k, then in (("numeric", "n", _CAPITAL), ("alpha-lower", "a", r"\s"), ("roman-upper", "I", r"\s"), ("roman-lower", "i", r"\s"))} | {
    f"paren-{name}": _form(k, r"\(", r"\)") for name, k in (("numeric", "n"), ("alpha", "a"), ("roman-upper", "I"), ("roman-lower", "i"))}


def repair_headings(c: Column) -> Column:
    """Runs of spaces collapse, 'PAYMENTS4. Due' becomes '4. PAYMENTS' on its own line, headings inside a paragraph get a line."""
    t = F.regexp_replace(c, r"(?<=\S) {2,}(?=\S)", " ")
    t = F.regexp_replace(t, r"([A-Z]{4,})(\d{1,2})\.\s+", "\n$2. $1\n")
    return F.regexp_replace(t, rf"([.:;!?])\s+((?:(?:{ROMAN})|\d+)\.(?!\d)\s+[A-Z][A-Za-z]{{2,}})", "$1\n$2")


def split_heading(block: Column) -> Column:
    """array of clause number and body: number with a title of up to 100 characters on its line or up to a full stop, else the number alone, else a line of capitals, else '' and the block. One pass over the block."""
    number = rf"(?:\d+(?:\.\d+)*\.?|(?:{ROMAN})\.|[A-Z]\.|(?i:Section|Article|Clause)\s+(?:\d+|[IVX]+)\.?)"
    ways = rf"({number}[ \t]*[^\n.]{{1,100}}?)(?:\.\s+|\.?\n\s*)(?=\S)|({number})\s*(?=\S)|([A-Z][A-Z ]{{3,50}})(?:\.\s*|\n\s*)(?=\S)|"
    return F.split(F.regexp_replace(block, rf"(?s)\A(?:{ways})(.*)\z", "$1$2$3\x01$4"), "\x01", 2)


def _starts(x: Column, heading: Column) -> Column:
    return F.regexp_like(x, F.concat(F.lit("^(?:"), heading, F.lit(")")))


def sections(df: DataFrame, key_col: str, text_col: str, scheme: str = "auto", combined: bool = True) -> DataFrame:
    """(key, seq, scheme, clause_no, clause_text, char_start, char_end)."""
    d = df.where(F.col(text_col).isNotNull()).select(F.col(key_col), F.col(text_col).alias("__t")).withColumn("__clean", drop_page_lines(repair_headings(F.col("__t"))))
    d = d.withColumn("scheme", numbering_scheme(F.concat(F.lit("\n"), "__clean")) if scheme == "auto" else F.lit(scheme))
    heading = F.create_map(*[F.lit(x) for kv in HEADING.items() for x in kv])[F.col("scheme")]
    trimmed = F.transform(F.split(F.concat(F.lit("\n"), "__clean"), F.concat(F.lit(r"\n\s*(?="), F.col("__h"), F.lit(")"))), lambda x: F.btrim(x, F.lit(" \n\r\t")))
    d = d.withColumn("__h", heading).withColumn("__p", F.filter(trimmed, lambda x: F.length(x) >= 10)).withColumn("__o", F.transform("__p", lambda x: _starts(x, F.col("__h"))))
    preamble = (F.size("__p") > 1) & ~F.get("__o", F.lit(0))
    d = d.withColumn("__from", F.when(preamble, 2).otherwise(1))
    d = d.withColumn("__p", F.slice("__p", F.col("__from"), F.size("__p"))).withColumn("__o", F.slice("__o", F.col("__from"), F.size("__o")))
    if combined:  # parts without a heading belong to the one before: from each that opens a section to the next
        d = d.withColumn("__i", F.filter(F.sequence(F.lit(1), F.greatest(F.size("__p"), F.lit(1))), lambda i: (i == 1) | F.get("__o", i - 1)))
        d = d.withColumn("__b", F.transform("__i", lambda i, j: F.array_join(F.slice("__p", i, F.coalesce(F.get("__i", j + 1), F.size("__p") + 1) - i), "\n\n")))
    else:
        d = d.withColumn("__b", F.col("__p"))
    d = d.withColumn("__b", F.when(F.size("__b") >= 2, F.col("__b")).otherwise(F.filter(F.split("__clean", r"\n\s*\n"), lambda x: F.length(F.trim(x)) >= 10)))
    kept = F.filter(F.array_distinct("__b"), lambda x: F.length(x) >= 30)
    e = d.select(key_col, "scheme", "__t", F.posexplode(kept).alias("p", "block")).withColumn("h", split_heading(F.col("block")))
    e = e.select(key_col, "scheme", "__t", "p", F.trim(F.get("h", F.lit(0))).alias("clause_no"), F.get("h", F.lit(1)).alias("body"))
    e = e.withColumn("at", F.expr("position(substring(body, 1, 40), __t)")).withColumn("clause_text", normalize_spaces(F.col("body")))
    at = F.col("at")
    return e.select(
        key_col, (F.col("p") + 1).alias("seq"), "scheme", "clause_no", "clause_text",
        F.when(at > 0, at - 1).alias("char_start"), F.when(at > 0, at - 1 + F.length("clause_text")).alias("char_end"),
    )
