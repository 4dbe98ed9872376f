"""Repair of text from scanned pages.

1. Words of all texts are counted (clean and scanned apart). The vocabulary is what clean texts use at
   least twice; other words of scanned texts are unknown.
2. For each unknown word all vocabulary words within distance 2 (1 for words of up to three letters), or
   within three listed confusions (two for four letters, one for fewer), are retrieved on a trie, and
   ranked by the cost of the confusions needed. Words of six letters or more that no listed confusion
   explains keep the words that differ by one edit between their first and last letter. The vocabulary is cut
   into shards of bounded size, the unknown words into at most ``_TASKS`` parts, and each pair is one group.
3. Contested meanings (several of one cost, or an unlisted edit) are judged by their neighbours: how often
   clean texts have the meaning beside the words that stand beside the unknown one in this text. An
   unlisted edit is believed only in words of small letters and with such support, so that names stay.
4. Each scanned text is read line by line: page numbers and running headers and footers are told by
   shape, position and repetition; words cut at line ends are joined if the joined form is a word and
   the hyphenated one is not the commoner; misread words get the best candidate: of equal cost the one
   with more support by its neighbours, then one that occurs elsewhere in the text, then the commoner.
   Paragraphs are reflowed.

The word and pair tables reach the workers as a broadcast while they have at most ``max_words`` rows each
(counted), else through joins by the words of each text; the result is the same.

Edge cases: null and empty texts give no lines; clean texts come out as they are; repeated rows of one
key count once (the larger text if they disagree), blank keys are ignored; without clean texts nothing
is a misreading; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions.keys import key
from clauselake.llm import bits
from clauselake.llm.layout import Layout, is_scanned, kind_of, layout
from clauselake.llm.lexicon import EQUAL, candidates, reading_cost, trie
from clauselake.session import written, written_rows

PLAIN = 1.0  # cost of an edit that is no listed confusion
_SUPPORT = 2  # clean occurrences beside its neighbours that an unlisted edit needs
_TASKS = 256  # parts of the unknown words
_LEAD, _TRAIL = "\"'“‘[{", ".,;:?\"'”’)]}"
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)$")
_CODE = re.compile(r"[A-Za-z]{0,3}\d+(?:[-/.]\d+)+[a-z]?$|\d+[A-Za-z]$|[$€]?[\d,.]+(?:\([a-z]\)?)?$|[A-Za-z]\d+$")
_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[0-9@!|$(<€]")


def core(chunk: str) -> str:
    """The word of a chunk between blanks, lower case; '' if it is no word (a number, a code, one letter)."""
    w = chunk.lstrip(_LEAD).rstrip(_TRAIL)
    if w[:1] == "(" and not (len(w) > 2 and w[1:2].islower() and ")" not in chunk and len(chunk) > 4):
        w = w[1:].lstrip(_LEAD)
    if w.endswith(("'s", "’s")):
        w = w[:-2]
    letters = len(_LETTER.findall(w))
    if letters < 2 or letters * 2 < len(w) or _ORDINAL.match(w) or _CODE.match(w):
        return ""
    return w.lower()


class _Cores(dict):
    """``core`` of chunks seen before; bounded."""

    def __missing__(self, chunk: str) -> str:
        if len(self) > 500_000:
            self.clear()
        v = self[chunk] = core(chunk)
        return v


_cores = _Cores()


def _joints(cut) -> tuple[str, str, str]:
    """(joined, compound, rest of the tail's chunk) of a word cut at a line end."""
    _, _, head, mark, tail = cut
    t = tail.rstrip(_TRAIL + "!")
    return (head + t).lower(), f"{head}-{t}".lower(), t


def _parts(w: str) -> list[str]:
    return [w] if "-" not in w else [w, *(p for p in w.split("-") if len(p) > 1)]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of clean and of scanned texts, counted a batch at a time; body lines and joined cuts only."""
    for pdf in batches:
        chunks, clean, scan = Counter(), Counter(), Counter()
        for t in pdf.text:
            kind = kind_of(t)
            if kind == "scanned":
                lay = layout(t)
                skip_end, skip_start = {c[0] for c in lay.cuts}, {c[1] for c in lay.cuts}
                for i in lay.body:
                    w = lay.lines[i].split()
                    chunks_ = w[(i in skip_start) : len(w) - (i in skip_end)]
                    scan.update(chunks_)
                for c in lay.cuts:
                    joined, compound, _ = _joints(c)
                    scan[joined] += 1
                    scan[compound] += 1
            elif t and kind == "clean":
                chunks.update(t.split())
        rows: dict[str, list[int]] = {}
        for source, col in ((chunks, 0), (scan, 1)):
            for chunk, n in source.items():
                w = core(chunk)
                for p in _parts(w) if w else ():
                    rows.setdefault(p, [0, 0])[col] += n
        yield pd.DataFrame([(w, a, b) for w, (a, b) in rows.items()], columns=["word", "n_clean", "n_scan"])


def word_table(texts: DataFrame) -> DataFrame:
    counted = texts.select("text").mapInPandas(_count_words, "word string, n_clean long, n_scan long")
    return written(counted.groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_scan").alias("n_scan")), "words")


def _most(word: str) -> float:
    """Cost up to which a reading is believed by itself: two listed confusions, three in a word of over four letters; another edit might rewrite a name."""
    return 0.5 if len(word) <= 4 else 0.75


def _readings(root: dict, w: str) -> list[tuple[str, float]]:
    """All likeliest meanings of a word: by listed confusions, else by one edit inside a long word."""
    found = candidates(root, w)
    sure = [(m, c) for m, c in found if c <= _most(w)]
    if sure or len(w) < 6 or not w.isalpha():
        return sure
    return [(m, c) for m, c in found if c <= PLAIN + EQUAL and (m[0], m[-1]) == (w[0], w[-1]) and m.isalpha()]


def meanings(words: DataFrame, shard: int = 100_000, part: int = 1_000) -> DataFrame:
    """(word, m): all meanings of the lowest cost of each unknown word of scanned texts, each with its cost and its clean occurrences."""
    known = words.where("n_clean >= 2").select("word", "n_clean")
    unknown = words.where("n_clean < 2 AND n_scan > 0").select("word")
    nv = max(1, -(-known.count() // shard))
    nu = min(_TASKS, max(1, -(-unknown.count() // part)))
    block = lambda n: F.pmod(F.xxhash64("word"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = known.select(block(nv).alias("v"), every(nu).alias("u"), "word", "n_clean", F.lit(True).alias("known"))
    u = unknown.select(every(nv).alias("v"), block(nu).alias("u"), "word", F.lit(0).cast("long").alias("n_clean"), F.lit(False).alias("known"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        root = trie(pdf.word[pdf.known])
        n = dict(zip(pdf.word[pdf.known], pdf.n_clean[pdf.known]))
        rows = [(w, m, c, n[m]) for w in pdf.word[~pdf.known] for m, c in _readings(root, w)]
        return pd.DataFrame(rows, columns=["word", "meant", "cost", "n_clean"])

    found = v.unionAll(u).repartition(nv * nu, "v", "u").groupBy("v", "u").applyInPandas(search, "word string, meant string, cost double, n_clean long")
    ranked = found.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("cost", "meant", "n_clean"))).alias("m"))
    return ranked.select("word", F.filter("m", lambda x: x["cost"] <= F.get("m", F.lit(0))["cost"] + EQUAL).alias("m"))


def pair_table(texts: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """(a, b, n) and its rows: words side by side in clean texts, at least one of them a contested meaning, seen twice or more."""
    contested = found.where((F.size("m") > 1) | (F.get("m", F.lit(0))["cost"] > 0.75)).select(F.explode("m.meant").alias("word")).distinct()
    contested, n = written_rows(contested, "contested")
    n_bits = bits.bits_for(n)
    hot = texts.sparkSession.sparkContext.broadcast(bits.bitmap(contested.select(bits.bucket(F.xxhash64("word"), n_bits).alias("b")).distinct(), n_bits))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not hot.value[0].any():
            return
        seen: dict[str, bool] = {}
        for pdf in batches:
            got = Counter()
            for t in pdf.text:
                if t and kind_of(t) == "clean":
                    w = [_cores[c] for c in t.split()]
                    new = {x for x in w if x not in seen}
                    if new:
                        if len(seen) > 500_000:
                            seen.clear()
                            new = set(w)
                        order = list(new)
                        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in order], dtype=np.uint64)
                        seen.update(zip(order, bits.has(hot.value, h).tolist()))
                    got.update((a, b) for a, b in zip(w, w[1:]) if (seen[a] or seen[b]) and a and b)
            yield pd.DataFrame([(a, b, n) for (a, b), n in got.items()], columns=["a", "b", "n"])

    counted = texts.select("text").mapInPandas(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n >= 2")
    return written_rows(counted, "pairs")


class Lexicon:
    """count: clean occurrences of words; meant: likely meanings of unknown words, with cost and clean occurrences; pairs: clean occurrences of two words in a row."""

    def __init__(self, count: dict[str, int], meant: dict[str, list[tuple[str, float, int]]], pairs: dict[tuple[str, str], int] | None = None):
        self.count, self.pairs = count, pairs or {}
        self.meant = {w: m for w, m in meant.items() if m[0][1] < PLAIN}
        self.plain = {w: m for w, m in meant.items() if m[0][1] >= PLAIN}
        self.seen: dict[str, str] = {}

    def known(self, w: str) -> bool:
        return self.count.get(w, 0) >= 2 or ("-" in w and all(len(p) < 2 or self.count.get(p, 0) >= 2 for p in w.split("-")))

    def misread(self, chunk: str) -> str:
        """The unknown word of a chunk that has a likely meaning, else ''."""
        w = self.seen.get(chunk)
        if w is None:
            w = _cores[chunk]
            if w and not self.known(w):
                w = w if w in self.meant or w in self.plain and chunk.lstrip(_LEAD + "(")[:1].islower() else next((p for p in w.split("-") if p in self.meant and not self.known(p)), "")
            else:
                w = ""
            if len(self.seen) < 500_000:
                self.seen[chunk] = w
        return w

    def options(self, word: str) -> list[tuple[str, float, int]]:
        m = self.meant.get(word) or self.plain.get(word) or []
        return [o for o in m if o[1] <= m[0][1] + EQUAL]

    def contested(self, word: str) -> bool:
        return word in self.plain or len(self.options(word)) > 1

    def best(self, word: str, context: set[str], beside: list[tuple[str, str]] = ()) -> str:
        """The likeliest meaning, '' if an unlisted edit lacks the support of its neighbours. beside: the words before and after each occurrence."""
        support = lambda m: sum(self.pairs.get((a, m), 0) + self.pairs.get((m, b), 0) for a, b in beside)
        some = [(-support(o[0]), o[0] not in context, -o[2], o[0]) for o in self.options(word)]
        top = min(some)
        return "" if word in self.plain and -top[0] < _SUPPORT else top[-1]


def neighbours(lay: Layout, words: dict[int, list[str]], lex: Lexicon) -> dict[str, list[tuple[str, str]]]:
    """The words before and after each contested word of the body; words cut at a line end are no neighbours."""
    at, row = [], []
    cut = {(c[0], "end") for c in lay.cuts} | {(c[1], "start") for c in lay.cuts}
    for i in lay.body:
        w = words[i]
        for k, chunk in enumerate(w):
            row.append("" if k == 0 and (i, "start") in cut or k + 1 == len(w) and (i, "end") in cut else _cores[chunk])
            if row[-1] and (bad := lex.misread(chunk)) and lex.contested(bad):
                at.append((len(row) - 1, bad))
    out: dict[str, list[tuple[str, str]]] = {}
    for k, bad in at:
        out.setdefault(bad, []).append((row[k - 1] if k else "", row[k + 1] if k + 1 < len(row) else ""))
    return out


def _is_cut(joined: str, compound: str, mark: str, lex: Lexicon) -> bool:
    if compound.rpartition("-")[2].rstrip(".,;:)").isdigit():
        return False  # a number broken at its own hyphen
    j, c = lex.count.get(joined, 0), lex.count.get(compound, 0)
    if j < 2 and c < 2:
        if joined in lex.meant or compound in lex.meant:
            cost = lambda w: lex.meant[w][0][1] if w in lex.meant else 9.0
            return cost(joined) <= cost(compound)
        head, _, tail = compound.rpartition("-")
        return mark != "-" or not (lex.known(head.split("-")[-1]) and lex.known(tail))
    return j > c


def _like(meant: str, old: str) -> str:
    """meant in the letter case of old."""
    if old.isupper() and len(old) > 1:
        return meant.upper()
    return meant[:1].upper() + meant[1:] if old[:1].isupper() else meant


def _fixed(chunk: str, word: str, meant: str) -> str:
    at = chunk.lower().find(word)
    return chunk if at < 0 else chunk[:at] + _like(meant, chunk[at : at + len(word)]) + chunk[at + len(word) :]


def read_scan(text: str, lex: Lexicon) -> tuple[list[tuple[int, str]], str]:
    """Issues (line number from 1, issue) and the repaired text of a scanned text."""
    lay: Layout = layout(text)
    issues = [(i + 1, k) for i, k in enumerate(lay.kinds) if k in ("header", "page_number")]
    words = {i: lay.lines[i].split() for i in lay.body}
    context = {_cores[c] for w in words.values() for c in w} - {""}
    beside = neighbours(lay, words, lex) if lex.pairs else {}
    misread, join = set(), {}
    in_cut = set()
    for c in lay.cuts:
        i, j, head, mark, tail = c
        joined, compound, t = _joints(c)
        cut = _is_cut(joined, compound, mark, lex)
        if cut:
            issues.append((i + 1, "hyphen"))
        in_cut |= {(i, "end"), (j, "start")}
        whole = joined if cut else compound
        glue = "" if cut else "-"
        fixed = head + glue + tail
        if not lex.known(whole):
            parts = [whole] if cut or whole in lex.meant else [p for p in compound.split("-") if not lex.known(p)]
            for p in parts:
                if p in lex.meant:
                    meant = lex.best(p, context)
                    fixed = _fixed(fixed, p, meant)
                    if cut or p == whole:
                        edge = len(head)
                        first = reading_cost(head.lower(), meant[: max(0, len(meant) - len(t))].rstrip("-"))
                        if meant.startswith(head.lower()):
                            misread.add(j)
                        elif meant.endswith(t.lower()):
                            misread.add(i)
                        else:
                            misread |= {i, j} if first and not meant[edge:].startswith(t.lower()[:2]) else {i}
                    else:
                        misread.add(i if p in head.lower() else j)
        join[i] = fixed
    paragraphs: list[list[str]] = []
    last = None
    carried = False
    for i in lay.body:
        w = words[i]
        gap = last is None or (any(lay.kinds[x] == "blank" for x in range(last + 1, i)) and not any(lay.kinds[x] in ("header", "page_number", "feed") for x in range(last + 1, i)))
        indented = lay.lines[i][:1] in " \t" and not carried and (last is None or not lay.lines[last][:1] in " \t")
        if not carried and (gap or indented):
            paragraphs.append([])
        out = []
        for k, chunk in enumerate(w):
            if k == 0 and (i, "start") in in_cut or k == len(w) - 1 and (i, "end") in in_cut:
                continue
            bad = lex.misread(chunk)
            meant = lex.best(bad, context, beside.get(bad, ())) if bad else ""
            if meant:
                misread.add(i)
                chunk = _fixed(chunk, bad, meant)
            out.append(chunk)
        if i in join:
            out.append(w[-1][: len(w[-1]) - len(next(c[2] for c in lay.cuts if c[0] == i)) - 1] + join[i])
        paragraphs[-1].extend(out)
        carried = i in join
        last = i
    issues += [(i + 1, "misread") for i in misread]
    heading = [lay.lines[0].strip()] if lay.kinds and lay.kinds[0] == "heading" else []
    return sorted(issues), "\n\n".join(heading + [" ".join(p) for p in paragraphs if p])


def _own(r) -> Lexicon:
    """Lexicon of one text from its joined columns."""
    own = [(w["word"], w["n_clean"], w["m"]) for w in r.words]
    meant = {w: [(x["meant"], x["cost"], x["n_clean"]) for x in m] for w, _, m in own if m is not None and len(m)}
    return Lexicon({w: n for w, n, _ in own if n}, meant, {(p["a"], p["b"]): p["n"] for p in getattr(r, "pairs", ())})


def _reader(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if not is_scanned(r.text):
                    rows.append((r.tab_name, r.row_key, [], r.text))
                    continue
                issues, text = read_scan(r.text, _own(r) if shared is None else shared.value)
                rows.append((r.tab_name, r.row_key, [{"line_no": n, "issue": x} for n, x in issues], text))
            yield pd.DataFrame(rows, columns=["tab_name", "row_key", "issues", "text"])

    return run


_OUT = "tab_name string, row_key string, issues array<struct<line_no int, issue string>>, text string"


def texts_of(df: DataFrame, tab_name: str, key_col: str, text_col: str) -> DataFrame:
    """(tab_name, row_key, text), each key once."""
    k = key(F.col(key_col))
    rows = df.where(F.col(text_col).isNotNull() & (F.col(text_col) != "") & k.isNotNull())
    g = rows.groupBy(k.alias("k")).agg(F.min(key_col).alias("row_key"), F.max(text_col).alias("text"))
    return g.select(F.lit(tab_name).alias("tab_name"), F.col("row_key").cast("string").alias("row_key"), "text")


def repair_scans(texts: DataFrame, max_words: int = 300_000) -> DataFrame:
    """texts: (tab_name, row_key, text). Returns (tab_name, row_key, issues, text), the text repaired."""
    texts = written(texts, "texts")  # read three times: folded once
    words = word_table(texts)
    found = written(meanings(words), "meanings")
    pairs, n_pairs = pair_table(texts, found)
    entries, n = written_rows(words.where("n_clean > 0").select("word", "n_clean").join(found, "word", "full").select("word", F.coalesce("n_clean", F.lit(0)).alias("n_clean"), "m"), "lexicon")
    if max(n, n_pairs) <= max_words:
        rows = entries.collect()  # at most max_words words, and as many pairs
        lex = Lexicon({r.word: r.n_clean for r in rows if r.n_clean}, {r.word: [(m.meant, m.cost, m.n_clean) for m in r.m] for r in rows if r.m}, {(r.a, r.b): r.n for r in pairs.collect()})
        return texts.mapInPandas(_reader(texts.sparkSession.sparkContext.broadcast(lex)), _OUT)

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if is_scanned(r.text):
                    lay = layout(r.text)
                    w = {p for i in lay.body for c in lay.lines[i].split() for p in _parts(core(c))}
                    for c in lay.cuts:
                        w.update(p for x in _joints(c)[:2] for p in _parts(x))
                    rows += [(r.tab_name, r.row_key, x) for x in w if x]
            yield pd.DataFrame(rows, columns=["tab_name", "row_key", "word"])

    need = texts.mapInPandas(needed, "tab_name string, row_key string, word string")
    own = need.join(entries, "word").groupBy("tab_name", "row_key").agg(F.collect_list(F.struct("word", "n_clean", "m")).alias("words"))  # the words of one text
    empty = lambda t: F.array().cast(t)
    joined = texts.join(own, ["tab_name", "row_key"], "left").withColumn("words", F.coalesce("words", empty("array<struct<word:string,n_clean:bigint,m:array<struct<cost:double,meant:string,n_clean:bigint>>>>")))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of a contested word's meanings with its neighbours."""
        for pdf in batches:
            rows = set()
            for r in pdf.itertuples():
                if is_scanned(r.text):
                    lex, lay = _own(r), layout(r.text)
                    for bad, beside in neighbours(lay, {i: lay.lines[i].split() for i in lay.body}, lex).items():
                        for m in lex.options(bad):
                            rows |= {(r.tab_name, r.row_key, x, y) for a, b in beside for x, y in ((a, m[0]), (m[0], b)) if x and y}
            yield pd.DataFrame(list(rows), columns=["tab_name", "row_key", "a", "b"])

    ask = joined.mapInPandas(asked, "tab_name string, row_key string, a string, b string").join(pairs, ["a", "b"])
    near = ask.groupBy("tab_name", "row_key").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))  # of one text
    joined = joined.join(near, ["tab_name", "row_key"], "left").withColumn("pairs", F.coalesce("pairs", empty("array<struct<a:string,b:string,n:bigint>>")))
    return joined.mapInPandas(_reader(None), _OUT)
