"""Scores for abusive, hateful and sexual content by a classifier chain of linear models.

Texts are normalised (letters set apart by blanks or dots are joined, digits and signs used as letters
are read as letters, starred-out words become marks), split into sentences, and each sentence is
described by hashed words and word pairs. The label of a document says that some sentence earns it, so
training alternates between choosing those sentences and fitting: logistic models in the order abusive,
hateful, sexual, each fed the probabilities of the earlier ones, which in training are out-of-fold
predictions (folds by document). A document's score is that of its highest sentence.

Training runs in one task on a bounded sample: at most ``max_docs`` labelled documents, the first in the
order of a seeded hash, and about ``max_plain`` of their sentences without a telling word as counter-examples. Scoring covers every document and its whole text, without a shuffle; the models
are arrays of fixed size.

Edge cases: null and empty texts score 0; ratings of one document by several raters count by majority
(half is enough for a category); unknown verdicts and null raters are ignored as ``none``; without any
labelled document of a category all its scores are 0; an empty table gives no rows; repeated ids are
scored row by row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.words import WORD, Chunks, mix

CATEGORIES = ("abusive", "hateful", "sexual")
_BITS = 19
_STARS = re.compile(r"^([^\W\d_])\*+([^\W\d_]*)$")
_EDGE = "\"'.,;:!?()[]{}<>-\u2013\u2014\u201c\u201d\u2018\u2019\u00bf\u00a1"
_LETTER, _SIGN, _DOTTED = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|]"), re.compile(r"^[^\W\d_](?:[.\-_*][^\W\d_]){2,}$")
_SIGNS = str.maketrans("013457@$!|", "oieastasil")
_LONG = re.compile(r"(.)\1{2,}")
_SPLIT = re.compile(r"(?<=[.!?])(?=[^\W\d_])")
_SPACED = re.compile(r"(?<!\S)\W?[^\W\d_](?: [^\W\d_]){2,}(?=[\W]|$)")
_END = 0
_SURE = 12.0


def plain_word(chunk: str) -> list[str]:
    """Words of a chunk between blanks, disguises undone: p.i.g -> pig, v3rm1n -> vermin, m***n -> a mark."""
    core = chunk.strip(_EDGE)
    stars = _STARS.match(core)
    if stars and stars[2]:
        return ["qmask", f"qmask{stars[1]}{stars[2][-1]}"]
    if _DOTTED.match(core):
        core = re.sub(r"[.\-_*]", "", core)
    elif _SIGN.search(core) and _LETTER.search(core) and not re.match(r"[$]?\d", core):
        core = core.translate(_SIGNS)
    elif re.match(r"[$]?\d+[^\W\d_]{2,}\w*$", core) and not re.match(r"\d+(?:st|nd|rd|th|am|pm)$", core):
        core = core.translate(_SIGNS)
    return [_LONG.sub(r"\1", w) for w in WORD.findall(core)]


class _Sentences(Chunks):
    """Hashes of the words of a chunk; _END after a sentence."""

    def hashes(self, chunk: str) -> tuple[int, ...]:
        if chunk == "\n":
            return (_END,)
        if _DOTTED.match(chunk.strip(_EDGE)):
            parts = [chunk]
        else:
            parts = _SPLIT.split(chunk)
        out: list[int] = []
        for i, p in enumerate(parts):
            out += [xxhash.xxh3_64_intdigest(w) for w in plain_word(p)]
            if i + 1 < len(parts) or p.rstrip("\"')\u201d\u2019")[-1:] in (".", "!", "?"):
                out.append(_END)
        return tuple(out)


_sentences = _Sentences()
_single = re.compile(r"(?<!\S)\W?[^\W\d_] [^\W\d_] [^\W\d_]")


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence of each; document of each sentence); sentences are numbered through."""
    out, sizes, before = [], [], 0
    for t in texts:
        if t:
            t = t.lower().replace("\r", "\n")
            if _single.search(t):
                t = _SPACED.sub(lambda m: m[0].replace(" ", ""), t)
            out.extend(chain.from_iterable(map(_sentences.__getitem__, t.replace("\n", " \n ").replace("\f", " \n ").split(" "))))
        out.append(_END)
        sizes.append(len(out) - before)
        before = len(out)
    h = np.array(out, dtype=np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = h == 0
    sent = np.cumsum(end) - end
    sent_doc = doc[end]
    word = ~end
    with np.errstate(over="ignore"):
        both = word[1:] & word[:-1]
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[both]
        f = np.r_[mix(h[word]), pairs]
    s = np.r_[sent[word], sent[:-1][both]]
    return (f & np.uint64((1 << _BITS) - 1)).astype(np.int64), s, sent_doc, np.array(sizes)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Sums of stretches of values, each to its place; the other places are 0."""
    out = np.zeros(n)
    if len(starts):
        out[at] = np.add.reduceat(values, starts)
    return out


def _starts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct x, where each begins) of sorted x."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, dtype=np.int64)
    return x[starts], starts


class _Fit:
    """Weighted logistic regression on sparse sentences (row, column) with dense columns beside them."""

    def __init__(self, rows, cols, n_rows: int, n_cols: int, dense: np.ndarray):
        a, b = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
        self._set((rows[a], cols[a].astype(np.int32)), (cols[b], rows[b].astype(np.int32)), n_rows, n_cols, dense)

    def _set(self, by_row, by_col, n_rows: int, n_cols: int, dense: np.ndarray) -> _Fit:
        """by_row: rows in order and their columns; by_col: columns in order and their rows."""
        self.rows, self.cols, self.n, self.m, self.dense = by_row, by_col, n_rows, n_cols, dense
        self.by_row, self.by_col = (by_row[1], *_starts(by_row[0])), (by_col[1], *_starts(by_col[0]))
        return self

    def part(self, keep: np.ndarray) -> _Fit:
        """The fit on some of the rows."""
        number = (np.cumsum(keep) - 1).astype(np.int32)
        a, b = keep[self.rows[0]], keep[self.cols[1]]
        return _Fit.__new__(_Fit)._set((number[self.rows[0][a]], self.rows[1][a]), (self.cols[0][b], number[self.cols[1][b]]), int(keep.sum()), self.m, self.dense[keep])

    def score(self, w: np.ndarray) -> np.ndarray:
        k = self.dense.shape[1]
        cols, at, starts = self.by_row
        return _sums(w[cols], at, starts, self.n) + self.dense @ w[self.m : self.m + k] + w[-1]

    def fit(self, y: np.ndarray, weight: np.ndarray, l2: float = 0.02, steps: int = 50) -> np.ndarray:
        if not weight.all():  # rows without weight take no part
            keep = weight > 0
            return self.part(keep).fit(y[keep], weight[keep], l2, steps)
        k = self.dense.shape[1]
        w = np.zeros(self.m + k + 1)
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        w[-1] = -2
        rows, at, starts = self.by_col
        for t in range(1, steps + 1):
            e = weight * (_sigmoid(self.score(w)) - y)
            g = np.r_[_sums(e[rows], at, starts, self.m), self.dense.T @ e, e.sum()]
            g[: self.m] += l2 * w[: self.m]
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            w = w - 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
        return w


def _telling(ff: np.ndarray, dd: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each feature (ff, with the documents dd that hold it) that is commoner in positive documents than in clean ones, 0 below _SURE."""
    n, a, b = 1 << _BITS, pos.sum(), max(1, neg.sum())
    p, q = np.bincount(ff[pos[dd]], minlength=n), np.bincount(ff[neg[dd]], minlength=n)
    rate = np.maximum(p + q, 1) / (a + b)
    g = 2 * (p * np.log(np.maximum(p, 1) / (a * rate)) + q * np.log(np.maximum(q, 1) / (b * rate)))
    return np.where((p / a > rate) & (p >= 2) & (g > _SURE), g, 0.0)


def train(texts: list[str], verdicts: list[list[str]], folds: int = 3, seed: int = 5, max_plain: int = 15_000) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{category: (weights of hashed features, weights of earlier probabilities and bias)}."""
    f, s, sent_doc, _ = features(texts)
    n_sent, n_doc = len(sent_doc), len(texts)
    share = {c: np.array([sum(x == c for x in v) / max(1, len(v)) for v in verdicts]) for c in CATEGORIES}
    clean = sum(share.values()) == 0
    rng = np.random.default_rng(seed)
    fold = rng.integers(0, folds, n_doc)
    seen = np.sort(f * n_doc + sent_doc[s])
    seen = seen[np.r_[True, seen[1:] != seen[:-1]]] if len(seen) else seen  # each feature of a document once
    ff, dd = np.divmod(seen, max(1, n_doc))
    tells = {c: _telling(ff, dd, share[c] >= 0.5, clean) for c in CATEGORIES if (share[c] >= 0.5).any()}
    telling = np.any([t > 0 for t in tells.values()], axis=0) if tells else np.zeros(1 << _BITS, dtype=bool)
    # sentences with some telling feature, and of the others as many as a fit in one task can hold
    near = (np.bincount(s, telling[f], n_sent) > 0) | (rng.random(n_sent) < max_plain / max(1, n_sent))
    kept = near[s]
    used = np.bincount(f[kept], minlength=1 << _BITS) >= 3
    column = np.cumsum(used) - 1
    row = np.cumsum(near) - 1
    keep = kept & used[f]
    rows, cols, n_rows, n_cols = row[s[keep]], column[f[keep]], int(near.sum()), int(used.sum())
    docs = sent_doc[near]
    at = np.flatnonzero(used)
    empty = np.zeros((n_rows, 0))

    guess: dict[str, np.ndarray] = {}
    for c, t in tells.items():
        pos = (share[c] >= 0.5)[docs]
        g = np.bincount(rows, t[at][cols], n_rows)
        top = np.zeros(n_doc)
        np.maximum.at(top, docs[pos], g[pos])
        mine = pos & (g > 0) & (g >= top[docs])  # at first the most telling sentence of each document
        fit = _Fit(rows, cols, n_rows, n_cols, empty)
        for _ in range(2):  # what only its own document supports is no evidence: scores from the other folds
            y, weight, g = mine.astype(float), (mine | clean[docs]).astype(float), np.empty(n_rows)
            for k in range(folds):
                inside = fold[docs] != k
                g[~inside] = fit.score(fit.fit(y, weight * inside, steps=30))[~inside]
            mine = pos & (g > 0)
        guess[c] = np.where(mine, g, -np.inf)
    strongest = np.max(list(guess.values()), axis=0) if guess else None
    chosen = {c: np.isfinite(g) & (g >= strongest) for c, g in guess.items()}
    models: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    dense = empty
    for c in CATEGORIES:
        full = np.zeros(1 << _BITS, dtype=np.float32)
        if c not in chosen or not n_rows or not chosen[c].any():
            models[c] = (full, np.r_[np.zeros(dense.shape[1]), -30.0])
            dense = np.c_[dense, np.zeros(n_rows)]
            continue
        mine = chosen[c]
        weight = (mine | clean[docs] | (sum(chosen.values()) > 0)).astype(float)  # other labels' sentences are counter-examples
        fit = _Fit(rows, cols, n_rows, n_cols, dense)
        best = fit.fit(mine.astype(float), weight)
        oof = np.zeros(n_rows)
        for k in range(folds):
            inside = fold[docs] != k
            oof[~inside] = _sigmoid(fit.score(fit.fit(mine.astype(float), weight * inside)))[~inside]
        full[at] = best[:n_cols]
        models[c] = (full, best[n_cols:])
        dense = np.c_[dense, oof]
    return models


def score(texts, models) -> np.ndarray:
    """(documents, categories): the highest probability of a sentence in each."""
    f, s, sent_doc, sizes = features(texts)
    n = len(sent_doc)
    earlier = np.zeros((n, 0))
    out = np.zeros((len(sizes), len(CATEGORIES)))
    for i, c in enumerate(CATEGORIES):
        w, rest = models[c]
        z = np.bincount(s, w[f], n)
        p = np.where(np.bincount(s, w[f] != 0, n) > 0, _sigmoid(z + earlier @ rest[:-1] + rest[-1]), 0.0)
        np.maximum.at(out[:, i], sent_doc, p)
        earlier = np.c_[earlier, p]
    return out


def fit_models(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, verdict_col: str, *, max_docs: int = 20_000, max_plain: int = 15_000, seed: int = 5):
    """Models of ``train`` from at most max_docs labelled documents, fitted in one task."""
    rated = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.sort_array(F.collect_list(F.lower(verdict_col))).alias("verdicts"))
    some = rated.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_docs)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(some), "id").repartition(1).sortWithinPartitions("id")  # max_docs rows of ids and verdicts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [(t, list(v)) for b in batches for t, v in zip(b.text, b.verdicts)]
        m = train([t for t, _ in all_], [v for _, v in all_], seed=seed, max_plain=max_plain) if all_ else {}
        yield pd.DataFrame([(c, w.astype("<f4").tobytes(), r.astype("<f8").tobytes()) for c, (w, r) in m.items()], columns=["category", "w", "r"])

    rows = sample.select("text", "verdicts").mapInPandas(run, "category string, w binary, r binary").collect()  # 3 rows of 2 MB
    got = {r.category: (np.frombuffer(r.w, "<f4"), np.frombuffer(r.r, "<f8")) for r in rows}
    none = (np.zeros(1 << _BITS, dtype=np.float32), np.array([0.0, 0.0, -30.0]))
    return {c: got.get(c, (none[0], none[1][len(CATEGORIES) - 1 - i :])) for i, c in enumerate(CATEGORIES)}


def with_scores(docs: DataFrame, text_col: str, keep: list[str], models) -> DataFrame:
    """keep and a score for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("abusive double, hateful double, sexual double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame(score(t, shared.value), columns=list(CATEGORIES))

    return docs.select(*keep, scored(F.col(text_col)).alias("scores")).select(*keep, *[F.col(f"scores.{c}").alias(c) for c in CATEGORIES])
