"""Lines of scanned text: page furniture, words cut at line ends, body lines.

A text is taken as scanned if it has three lines with text or more and at most ``_FEW`` of its characters stand in
lines longer than ``WRAPPED``; as clean if at least ``_MOST`` of them do, or if it is one line. What lies between, and two
short lines, are neither: they stay as they are, but are no source of words. All rules look at one text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WRAPPED = 130
_FEW, _MOST = 0.4, 0.8
MARKS = "-­‐‑¬"
_NUMBER = re.compile(
    r"(?:[-–—]\s*\d+\s*[-–—]|[\[(]\s*\d+\s*[\])]|(?:page|pg\.?|p\.)\s*\d+(?:\s*(?:of|/)\s*\d+)?|\d+\s*(?:of|/)\s*\d+|\d+\s*\|\s*page|[ivxl]+|(\d+))", re.I)
_STOP = re.compile(r"[.:;?!][\"')”’]*$")
_FIRM = re.compile(r"\b(?:Ltd|Inc|Corp|Co|LLC|Group|LLP|GmbH|plc)\.?$")
_PAGED = re.compile(r"(?:,\s*p\.?|\s{2,}|\|\s*|\bpage|\bpg\.?)\s*\d+$|^\d+\s*\|", re.I)
_CUT = re.compile(rf"[^\W_][\w@!|$'(]*(?:-[\w@!|$'(]+)*[{MARKS}]$")
_SHAPE = re.compile(r"\d+")


def kind_of(text: str | None) -> str:
    """scanned, clean or unsure."""
    if not text:
        return "clean"
    rows = long = filled = 0
    for line in text.split("\n"):
        n = len(line)
        if line.strip():
            rows += 1
            filled += n
            long += n if n > WRAPPED else 0
    if rows >= 3 and long <= _FEW * filled:
        return "scanned"
    return "clean" if rows < 2 or long >= _MOST * filled else "unsure"


def is_scanned(text: str | None) -> bool:
    return kind_of(text) == "scanned"


@dataclass
class Layout:
    lines: list[str]
    kinds: list[str]  # blank, feed, heading, page_number, header, body
    body: list[int] = field(default_factory=list)  # indexes of body lines
    cuts: list[tuple[int, int, str, str, str]] = field(default_factory=list)  # line, next body line, head, mark, tail


def _shape(s: str) -> str:
    return _SHAPE.sub("#", " ".join(s.lower().split()))


def _alike(line: list[str], title: list[str]) -> bool:
    """Does the line hold the words of the title in a row, but for at most one (misread) word?"""
    for i in range(len(line) - len(title) + 1):
        if sum(a != b for a, b in zip(line[i : i + len(title)], title)) <= len(title) // 3:
            return True
    return False


def layout(text: str) -> Layout:
    lines = text.split("\n")
    stripped = [x.strip(" \t\r\f ") for x in lines]
    n = len(lines)
    kinds = ["body"] * n
    for i, s in enumerate(stripped):
        if not s:
            kinds[i] = "feed" if "\f" in lines[i] else "blank"
    filled = [i for i in range(n) if kinds[i] == "body"]
    if not filled:
        return Layout(lines, kinds)
    if filled[0] == 0 and stripped[0].upper() == stripped[0] and not _NUMBER.fullmatch(stripped[0]):
        kinds[0] = "heading"
    bare = set()
    for i in filled:
        if kinds[i] == "body" and (m := _NUMBER.fullmatch(stripped[i])):
            kinds[i] = "page_number"
            if m[1]:
                bare.add(i)
    for i in bare:  # a column of numbers is no page furniture
        if i - 1 in bare or i + 1 in bare:
            kinds[i] = "body"
    widths = sorted((len(lines[i].rstrip()) for i in filled if kinds[i] == "body" and len(lines[i]) <= WRAPPED), reverse=True)
    width = widths[len(widths) * 3 // 100] if widths else 0  # the few longest may be furniture
    title = " ".join(stripped[0].lower().split()) if kinds[0] == "heading" else ""
    words = title.split()
    maybe = []
    for i in filled:
        s = stripped[i]
        if kinds[i] == "body" and (len(s) <= 0.8 * width and (s[0].isupper() or s[0].isdigit() or s[0] in "[(" or _FIRM.search(s)) or "|" in s or s[-1].isdigit()):
            maybe.append(i)
    shapes: dict[str, int] = {}
    for i in maybe:
        k = _shape(stripped[i])
        shapes[k] = shapes.get(k, 0) + 1
    at = {i: k for k, i in enumerate(filled)}
    furniture = ("page_number", "header")
    for _ in range(2):  # furniture beside furniture is found in the second round
        for i in maybe:
            if kinds[i] != "body":
                continue
            s, k = stripped[i], at[i]
            ends = bool(_STOP.search(s))
            few = len(s.split()) <= 6
            firm = bool(_FIRM.search(s)) and all(not w[:1].islower() for w in s.split()[1:])
            if len(words) > 1 and (s[-1].isdigit() or "|" in s) and _alike(s.lower().split(), words) or (" | " in s and not ends):
                kinds[i] = "header"
                continue
            if not (firm or not ends) or not few or s[-1] in MARKS + ",":
                continue
            paged = bool(_PAGED.search(s))
            beside = (
                i > 0 and kinds[i - 1] in ("page_number", "header", "feed") or i + 1 < n and kinds[i + 1] in ("page_number", "header", "feed")
                or k + 1 == len(filled) or kinds[filled[k - 1]] in furniture or kinds[filled[k + 1]] in furniture
            )
            j = k + 1
            while j < len(filled) and kinds[filled[j]] in furniture:
                j += 1
            word = stripped[filled[j]].split(" ", 1)[0] if j < len(filled) else ""
            full = len(lines[i].rstrip()) + 1 + len(word) > width
            again = shapes[_shape(s)] > 1
            before = stripped[filled[k - 1]] if k and kinds[filled[k - 1]] == "body" else "."
            amid = not _STOP.search(before) and len(s) <= 0.6 * width and not full  # it breaks a sentence in two
            named = firm or paged and bool(_FIRM.search(s.split(",")[0]))
            if again and (beside or not full) or beside and (firm or paged or not full) or amid or named and paged:
                kinds[i] = "header"
    out = Layout(lines, kinds, [i for i in filled if kinds[i] == "body"])
    for i, j in zip(out.body, out.body[1:]):
        m = _CUT.search(stripped[i])
        if m:
            tail = stripped[j].split(" ", 1)[0]
            if tail[:1].islower() or tail[:1] in "0123456789@!|$(":
                out.cuts.append((i, j, m[0][:-1], m[0][-1], tail))
    return out
