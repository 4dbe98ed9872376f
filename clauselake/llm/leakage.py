"""Evaluation texts inside training texts, by size-partitioned MinHash containment search.

A short test passage inside a long document has a tiny Jaccard similarity to the whole document, so
both sides are cut into passages of one size, and passages are compared only within their size
partition: items of at least ``min_run`` words are searched by passages of ``min_run`` words, shorter
ones (at least ``k`` words) by passages of their own length, one partition for each length present.
A passage is represented by a band of ``_ROWS`` MinHash values of its k-word shingles; overlapping
passages mostly share their minima, so a text keeps a few bands for every passage length. A passage
contained in a document equals one of the document's passages and has its band: no contained passage
can be missed, and phrases that many texts share seldom supply all minima of a band. Exact shingle containment then verifies each candidate: of the
item's passages (its shingles of passage length) the document must contain at least one. The share it contains, and
the longest stretch of successive words that both have, are reported.

Edge cases: null and empty texts, and items shorter than ``k`` words, give no rows; repeated rows of
one id count once; of different texts under one id each is searched, the longest run counts; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm import bits
from clauselake.llm.words import hashed, mix, rolled, signed
from clauselake.session import BROADCAST_ROWS, written, written_rows


_ROWS = 3


def minima(h: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, MinHash band) of every passage of ``length`` words, successive repeats once."""
    s = rolled(h, k)
    w = length - k + 1
    n = len(s) - w + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    band = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for row in range(_ROWS):
            low = mix(s + np.uint64(row + 1)) if row else s
            step = 1
            while step * 2 <= w:  # minima of 1, 2, 4 .. shingles, then of w
                low = np.minimum(low[: len(low) - step], low[step:])
                step *= 2
            low = np.minimum(low[:n], low[w - step : w - step + n])
            band = mix(band * np.uint64(31) + low)
    own = np.repeat(np.arange(len(sizes)), sizes)
    own, last = own[:n], own[length - 1 : length - 1 + n]
    inside = own == last
    own, band = own[inside], band[inside]
    new = np.ones(len(band), dtype=bool)
    new[1:] = (band[1:] != band[:-1]) | (own[1:] != own[:-1])
    return own[new], band[new]


def _search(lengths: list[int], k: int, known):
    """known: bitmap of the items' minima, so that documents send on only what may match."""
    salt = {n: np.uint64(n * 0x9E3779B97F4A7C15 % 2**64) for n in lengths}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, sizes = hashed(pdf.text)
            out = []
            for n in lengths:
                own, low = minima(h, sizes, n, k)
                low = low ^ salt[n]
                if known is not None:
                    hit = bits.has(known.value, low)
                    own, low = own[hit], low[hit]
                out.append(pd.DataFrame({"id": pdf.id.to_numpy()[own], "size": n, "h": signed(low)}))
            yield pd.concat(out).drop_duplicates() if out else pd.DataFrame({"id": [], "size": [], "h": []})

    return run


def longest_run(doc: np.ndarray, item: np.ndarray, least: int) -> int:
    """Words in the longest common stretch, 0 if below least."""
    if len(item) < least or len(doc) < least:
        return 0
    a, b = rolled(doc, least), rolled(item, least)
    starts = np.flatnonzero(np.isin(b, a))
    best, where = 0, {}
    if len(starts):
        for i in np.flatnonzero(np.isin(a, b)):
            where.setdefault(int(a[i]), []).append(int(i))
    for j in starts:
        for i in where.get(int(b[j]), ()):
            if i and j and doc[i - 1] == item[j - 1] and best >= least:
                continue  # inside a stretch already measured
            m = min(len(doc) - i, len(item) - j)
            differ = np.flatnonzero(doc[i : i + m] != item[j : j + m])
            best = max(best, int(differ[0]) if len(differ) else m)
    return best if best >= least else 0


def _verify(min_run: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, rows in pdf.groupby("text", sort=False):
                doc = hashed([text])[0]
                for r in rows.itertuples():
                    item = hashed([r.item_text])[0]
                    size = min(min_run, len(item))
                    passages = float(np.isin(np.unique(rolled(item, size)), rolled(doc, size)).mean())
                    n = longest_run(doc, item, size) if passages > 0 else 0
                    if n:
                        s, t = np.unique(rolled(item, min(k, size))), rolled(doc, min(k, size))
                        out.append((r.id, r.item_id, n, float(np.isin(s, t).mean()), passages))
            yield pd.DataFrame(out, columns=["id", "item_id", "run_words", "containment", "passage_containment"])

    return run


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, *, min_run: int = 20, k: int = 5) -> DataFrame:
    """(id, item_id, run_words, containment, passage_containment): every document that shares min_run successive words with an item
    (or holds all of a shorter item), the longest such run, and the shares of the item's k-word shingles and of its passages that it holds."""
    sc = docs.sparkSession.sparkContext
    d = docs.where(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    i = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    out = "id {}, size int, h long"
    kinds = dict(docs.select(F.col(doc_id).alias("d")).dtypes) | dict(items.select(F.col(item_id).alias("i")).dtypes)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"size": np.unique(np.minimum(hashed(pdf.text)[1], min_run)).astype(np.int32)})

    lengths = sorted(r.size_ for r in i.mapInPandas(sizes, "size int").distinct().withColumnRenamed("size", "size_").collect() if r.size_ >= k)  # at most min_run rows
    wanted, n = written_rows(i.mapInPandas(_search(lengths, k, None), out.format(kinds["i"])).select(F.col("id").alias("item_id"), "size", "h").distinct(), "items")
    n_bits = bits.bits_for(n)
    known = sc.broadcast(bits.bitmap(wanted.select(bits.bucket(F.col("h"), n_bits).alias("b")).distinct(), n_bits))
    # the partition's length is part of the hash, and a size partition meets only its own
    seen = d.mapInPandas(_search(lengths, k, known), out.format(kinds["d"]))
    side = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    found = written(seen.join(side, ["size", "h"]).select("id", "item_id").distinct(), "leaks")
    texts = d.join(found, "id").select("id", "item_id", "text")
    both = texts.join(i.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
    res = both.mapInPandas(_verify(min_run, k), f"id {kinds['d']}, item_id {kinds['i']}, run_words int, containment double, passage_containment double")
    best = [F.max(c).alias(c) for c in ("run_words", "containment", "passage_containment")]
    return res.groupBy("id", "item_id").agg(*best)
