"""Near-duplicate texts by bottom-k sketches from one hash function.

1. Copies are folded: texts with equal 128-bit hashes are one class. Each class keeps the ``sketch``
   smallest hashes of its word shingles.
2. Inverted lists: the retained values of a class are ordered from the rarest to the commonest (hashed
   counts, one order for all), and all but the last m - 1 are posted, m being the least overlap of two
   sketches that the threshold lets expect (``least_overlap``). Two sketches with m values in common
   share a posted value, whatever the order and however common the values are: recall depends on m
   alone, not on the size of the collection. Values that occur once are not posted.
3. An entry carries one-byte marks of its value and those after it (of ``sketch`` retained values in all, up to 8/3
   times as many for large sets): what comes before is not shared in the first list of a pair. In its list it meets
   every other entry; lists longer than ``block`` are compared block by block, each pair of blocks on its own, so
   no task holds an unbounded list and nothing is capped. The overlap of two sketches, against what it is expected
   to be for sets of these sizes at the threshold, is the estimate on the union of the sketches.
4. Exact Jaccard similarity of the shingle sets verifies each candidate pair of distinct texts.

The chance to miss a pair just at the threshold is about 2 % (2.44 standard deviations; measured in the README) and falls fast above it. The work on a list grows with the square
of its length, but lists of the commonest values are not posted as long as texts have rarer ones.

Edge cases: null texts and texts with fewer than ``min_words`` or ``k`` words take part in no pair, but are members
(exact copies of a short text are one class, a null text is a class of its own);
rows repeated under one id count once; an empty table gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions.keys import key
from clauselake.llm import bits
from clauselake.llm.words import mix, shingles
from clauselake.session import written, written_rows

_BLOCK = 8192  # entries of a list compared in one task
_TILE = 1 << 17  # pairs compared at once
_DEVIATIONS = 2.44  # how far below its expectation an overlap may lie
_ENTRIES = 200_000  # about the entries of a bucket of lists


def retained(size: np.ndarray, sketch: int) -> np.ndarray:
    """Values a sketch keeps: grows with the set, so that large sets keep as dense a part of the hashes as small ones, up to a bound."""
    return np.minimum(size, np.clip(size * sketch // 64, sketch, sketch * 8 // 3)).astype(np.int64)


def _moments(a: np.ndarray, b: np.ndarray, threshold: float, sketch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common values of sets of sizes a and b at the threshold, mean and variance of those in both sketches."""
    common = np.ceil(threshold * (a + b) / (1 + threshold) - 1e-9)
    rate = np.minimum(retained(a, sketch) / a, retained(b, sketch) / b)
    mean = common * rate
    return common, mean, np.where(rate < 1, mean * (1 - np.minimum(1, common / np.maximum(a, b))), 0)


def least_overlap(size: np.ndarray, threshold: float, sketch: int) -> np.ndarray:
    """Values that the sketch of a set of this size must share with that of any set as similar as the threshold."""
    sizes, at = np.unique(np.asarray(size, dtype=np.float64), return_inverse=True)
    a = np.maximum(1, sizes)[:, None]
    _, mean, var = _moments(a, np.maximum(1, np.round(a * np.geomspace(threshold, 1 / threshold, 33)[None, :])), threshold, sketch)
    return np.maximum(1, np.floor(mean - _DEVIATIONS * np.sqrt(var) + 1e-9).min(1)).astype(np.int64)[at]


def plausible(n: np.ndarray, a: np.ndarray, b: np.ndarray, marks_a: np.ndarray, marks_b: np.ndarray, threshold: float, sketch: int) -> np.ndarray:
    """Can sets of sizes a and b whose sketches share n of their marks be as similar as the threshold? Marks equal by chance are allowed for."""
    common, mean, var = _moments(a.astype(float), b.astype(float), threshold, sketch)
    chance = np.maximum(marks_a - n, 0) * np.maximum(marks_b - n, 0) / 256
    return (common <= np.minimum(a, b)) & (n - chance >= mean - _DEVIATIONS * np.sqrt(var + chance))


def _unique_rows(s: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by text, then value, each pair once."""
    o = np.lexsort((s, own))
    s, own = s[o], own[o]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return s[first], own[first]


def _ranks(own: np.ndarray) -> np.ndarray:
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
    return np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))


def _sketcher(k: int, min_words: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s, own, n = shingles(pdf.text, k)
            s, own = _unique_rows(s >> np.uint64(32), own)  # 32 bits: verified exactly later
            ends = np.searchsorted(own, np.arange(len(pdf)), side="right")
            at = np.r_[0, ends[:-1]] if len(pdf) else ends
            ok = (ends > at) & (n >= min_words)
            s = s.astype("<u4")
            last = at + retained(ends - at, size)
            sk = [s[a:b].tobytes() if o else None for a, b, o in zip(at, last, ok)]
            yield pd.DataFrame({"h1": pdf.h1, "h2": pdf.h2, "n": (ends - at).astype(np.int32), "sk": sk})

    return run


def _values(sk: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(sk), dtype="<u4").astype(np.uint64)
    return v, np.repeat(np.arange(len(sk)), [len(x) // 4 for x in sk]).astype(np.int64)


def _bucket_counts(n_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b, n = np.unique(_values(pdf.sk)[0] & np.uint64((1 << n_bits) - 1), return_counts=True)
            yield pd.DataFrame({"b": b.astype(np.int32), "n": n})

    return run


def _packed(v: np.ndarray, part: np.ndarray, d: np.ndarray, size: np.ndarray, length: np.ndarray, marks: np.ndarray) -> bytes:
    return b"".join([len(v).to_bytes(4, "little"), v.astype("<u4").tobytes(), part.astype("<u4").tobytes(), d.astype("<i8").tobytes(), size.astype("<u2").tobytes(), length.astype("u1").tobytes(), marks.tobytes()])


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    """v, part, d, size, length and marks of all entries."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for blob in blobs:
        n, at = int.from_bytes(blob[:4], "little"), 4
        for field, kind, width in zip(out, ("<u4", "<u4", "<i8", "<u2", "u1"), (4, 4, 8, 2, 1)):
            field.append(np.frombuffer(blob, kind, n, at))
            at += n * width
        out[5].append(np.frombuffer(blob, "u1", -1, at))
    return [np.concatenate(x) for x in out]


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from start on, length of them, one stretch after another."""
    before = np.cumsum(length) - length
    return np.arange(length.sum()) + np.repeat(start - before, length)


def _poster(shared, n_bits: int, threshold: float, sketch: int, block: int, buckets: int):
    """(bucket, entries): the entries of a batch for each bucket of lists, packed. An entry is its list (value and pair
    of blocks), class, set size and the marks from its value on: values before it are shared in no list it can be the first of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for pdf in batches:
            v, own = _values(pdf.sk)
            step = often[(v & np.uint64((1 << n_bits) - 1)).astype(np.int64)]
            o = np.lexsort((v, step, own))
            v, step = v[o], step[o]
            marks = (mix(v + np.uint64(1)) >> np.uint64(56)).astype(np.uint8)
            size = pdf.n.to_numpy()
            ends = np.cumsum(np.bincount(own, minlength=len(pdf)))
            length = ends[own] - np.arange(len(v))
            at = np.flatnonzero((length >= least_overlap(size, threshold, sketch)[own]) & (step > 1))
            parts = np.maximum(1, -(-bits.most_in(step[at]) // block))  # from an upper bound of the list's length
            d = pdf.d.to_numpy()
            mine = (mix(d.astype(np.uint64) + np.uint64(3))[own[at]] % parts.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(at)), parts)
            other = _ranks(again)
            at, mine, parts = at[again], mine[again], parts[again]
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            part = (low * parts + high) * 4 + np.where(low == high, 2, mine == high)
            bucket = (mix(v[at] * np.uint64(0x9E3779B1) + (part >> 2).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            at, part, bucket = at[o], part[o], bucket[o]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(at) else np.zeros(1, dtype=np.int64)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                x = at[a:b]
                rows.append((bucket[a], _packed(v[x], part[a:b], d[own[x]], np.minimum(size[own[x]], 65535), length[x], marks[_stretches(x, length[x])])))
            yield pd.DataFrame(rows, columns=["bucket", "entries"]).astype({"bucket": "int32"})

    return run


def _pairer(threshold: float, sketch: int):
    """Candidate pairs of the lists of one bucket, which is a partition."""

    def bitmaps(marks: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 32), dtype=np.uint8)
        for i in range(length.max(initial=0)):
            ok = np.flatnonzero(length > i)
            m = marks[at[ok] + i]
            out[ok, m >> 3] |= np.uint8(1) << (m & 7)
        return out.view(np.uint64)

    def survivors(wide: list[np.ndarray], least: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of i (lists, m) and j (lists, n) whose sketches share enough."""
        shape = (i.shape[0], i.shape[1], j.shape[1])
        both, ones, n = np.empty(shape, dtype=np.uint64), np.empty(shape, dtype=np.uint8), np.zeros(shape, dtype=np.uint8)
        for c in wide:
            np.bitwise_and(c[i][:, :, None], c[j][:, None, :], out=both)
            n += np.bitwise_count(both, out=ones)
        hit = np.flatnonzero(((n >= least[i][:, :, None]) & (n >= least[j][:, None, :])).ravel())
        r, q = np.divmod(hit, i.shape[1] * j.shape[1])
        p, q = np.divmod(q, j.shape[1])
        return i[r, p], j[r, q]

    def groups(start: np.ndarray, size: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows i, rows j, is it a list with itself) with at most about _TILE pairs each."""
        one = side[start] == 2
        short = one & (size > 1) & (size <= int(math.sqrt(_TILE)))
        blank = len(side)  # a row that meets no other fills lists up to the next of few lengths
        step = np.ceil(np.log(np.maximum(size, 8) / 8) / math.log(1.12) - 1e-9)
        filled = np.where(size <= 8, size, np.ceil(8 * 1.12**step).astype(np.int64))
        for m in np.unique(filled[short]):
            s, n = start[short & (filled == m)], size[short & (filled == m)]
            quarters = np.array_split(np.arange(m), 4 if m >= 64 else 1)  # each against itself and those behind: little is compared twice
            many = max(1, _TILE // len(quarters[0]) ** 2)
            for a in range(0, len(s), many):
                i = [np.where(at < n[a : a + many, None], s[a : a + many, None] + at, blank) for at in quarters]
                for x in range(len(i)):
                    for y in range(x, len(i)):
                        yield i[x], i[y], x == y
        for x, m in zip(start[one & ~short & (size > 1)], size[one & ~short & (size > 1)]):
            yield from tiles(np.arange(x, x + m), np.arange(x, x + m), True)
        for x, m in zip(start[~one], size[~one]):
            at = np.arange(x, x + m)
            yield from tiles(at[side[at] == 0], at[side[at] == 1], False)

    def tiles(i: np.ndarray, j: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        step = int(math.sqrt(_TILE))
        for a in range(0, len(i), step):
            for b in range(a if same else 0, len(j), step):
                yield i[None, a : a + step], j[None, b : b + step], same and a == b

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs = [x for pdf in batches for x in pdf.entries]
        if not blobs:
            return
        v, part, d, size, length, marks = _unpacked(blobs)
        del blobs
        o = np.lexsort((part, v))
        begin = (np.cumsum(length, dtype=np.int64) - length)[o]
        v, part, d, size, length = v[o], part[o], d[o], size[o].astype(np.int64), length[o].astype(np.int64)
        w = np.vstack([bitmaps(marks, begin, length), np.zeros((1, 4), dtype=np.uint64)])
        wide = [np.ascontiguousarray(w[:, x]) for x in range(4)]
        least = np.r_[least_overlap(size, threshold, sketch), 255].astype(np.uint8)
        start = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (part[1:] >> 2 != part[:-1] >> 2)])
        out, kept = [], 0
        for i, j, same in groups(start, np.diff(np.r_[start, len(v)]), part & 3):
            a, b = survivors(wide, least, i, j)
            if same:
                a, b = a[a < b], b[a < b]
            n = np.bitwise_count(w[a] & w[b]).sum(1).astype(np.int64)
            ok = plausible(n, size[a], size[b], length[a], length[b], threshold, sketch)
            a, b = d[a[ok]], d[b[ok]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            kept += len(a)
            if kept > _TILE:
                yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])
                out, kept = [], 0
        if out:
            yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    return run


def _verifier(k: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = dict(zip(pdf.a, pdf.text_a)) | dict(zip(pdf.b, pdf.text_b))
            s, own, _ = shingles(texts.values(), k)
            ends = np.searchsorted(own, np.arange(len(texts)), side="right")
            sets = {d: frozenset(s[a:b].tolist()) for d, a, b in zip(texts, np.r_[0, ends[:-1]], ends)}
            common = np.array([len(sets[a] & sets[b]) for a, b in zip(pdf.a, pdf.b)], dtype=float)
            union = np.array([len(sets[a]) + len(sets[b]) for a, b in zip(pdf.a, pdf.b)], dtype=float) - common
            sim = common / np.maximum(union, 1)
            ok = sim >= threshold
            yield pd.DataFrame({"a": pdf.a[ok], "b": pdf.b[ok], "similarity": sim[ok]})

    return run


class NearDuplicates:
    """members: (id, d, paired), the class d of copies of each id and whether it is long enough for pairs. links: (a, b, similarity), a < b, between classes."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: links and copies written out for every id."""
        m = self.members.where("paired")
        cross = self.links.join(m.select(F.col("id").alias("x"), F.col("d").alias("a")), "a").join(m.select(F.col("id").alias("y"), F.col("d").alias("b")), "b").select("x", "y")
        copies = m.select(F.col("id").alias("x"), "d").join(m.select(F.col("id").alias("y"), "d"), "d").where("x < y").select("x", "y")
        return cross.unionAll(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, n_links): connected group of each id, short and null texts included, named by its smallest id, and links of its class to other texts."""
        low = self.members.groupBy("d").agg(F.min("id").alias("low"))
        edges = written(self.links.select("a", "b").unionAll(self.links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
        label = written(edges.select("a").distinct().join(low, F.col("a") == F.col("d")).select("a", F.col("low").alias("l")), "label")
        while True:  # smallest label of the neighbours, then the label of that label's holder: few rounds on long chains too
            near = edges.join(label.select(F.col("a").alias("b"), F.col("l").alias("nl")), "b").groupBy("a").agg(F.min("nl").alias("nl"))
            step = label.join(near, "a", "left").select("a", "l", F.least("l", "nl").alias("m"))
            hop = low.select(F.col("low").alias("m"), F.col("d").alias("hd")).join(step.select(F.col("a").alias("hd"), F.col("m").alias("hm")), "hd").select("m", "hm")
            new, moved = written_rows(step.join(hop, "m", "left").select("a", F.least("m", "hm").alias("l"), (F.least("m", "hm") < F.col("l")).alias("moved")), "label")
            label = new.drop("moved")
            if not moved or new.where("moved").isEmpty():
                break
        g = self.members.join(low, "d").join(label.withColumnRenamed("a", "d"), "d", "left").join(degree.withColumnRenamed("a", "d"), "d", "left")
        return g.select("id", F.coalesce("l", "low").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, *, k: int = 5, threshold: float = 0.8, min_words: int = 1, sketch: int = 24, block: int = _BLOCK,
) -> NearDuplicates:
    sc = df.sparkSession.sparkContext
    text = F.col(text_col)
    h1 = F.when(text.isNull(), F.xxhash64(F.lit("null"), key(F.col(id_col)))).otherwise(F.xxhash64(text))
    h2 = F.when(text.isNull(), F.xxhash64(F.lit("none"), key(F.col(id_col)))).otherwise(F.xxhash64(F.lit("again"), text))
    rows = df.where(key(F.col(id_col)).isNotNull()).select(F.col(id_col).cast("string").alias("id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"))
    once = rows.select("h1", "h2", "text").mapInPandas(_sketcher(k, min_words, sketch), "h1 long, h2 long, n int, sk binary").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("sk").alias("sk"))
    classes, n_classes = written_rows(once.withColumn("d", F.monotonically_increasing_id()), "classes")
    long = classes.where("sk IS NOT NULL").select("d", "n", "sk")
    n_bits = bits.bits_for(n_classes * sketch // 16, bits.COUNTS)
    often = sc.broadcast(bits.counts(long.select("sk").mapInPandas(_bucket_counts(n_bits), "b int, n long").groupBy("b").agg(F.sum("n").alias("n")), n_bits))
    buckets = max(sc.defaultParallelism, n_classes * sketch // _ENTRIES)
    posts = long.mapInPandas(_poster(often, n_bits, threshold, sketch, block, buckets), "bucket int, entries binary")
    found, n_found = written_rows(posts.repartitionById(buckets, "bucket").mapInPandas(_pairer(threshold, sketch), "a long, b long").distinct(), "candidates")
    ends = found.select(F.col("a").alias("d")).unionAll(found.select(F.col("b").alias("d"))).distinct()
    wanted_rows = written(classes.join(ends, "d").select("d", "h1", "h2"), "ends")
    h_bits = bits.bits_for(2 * n_found)
    wanted = sc.broadcast(bits.bitmap(wanted_rows.select(bits.bucket(F.col("h1"), h_bits).alias("b")).distinct(), h_bits))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        return pd.Series(bits.has(wanted.value, h.to_numpy()))

    texts = rows.select("h1", "h2", "text").where(listed("h1")).dropDuplicates(["h1", "h2"])
    hashes = lambda x: wanted_rows.select(F.col("d").alias(x), F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"))
    side = lambda x: texts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("text").alias(f"text_{x}"))
    joined = found.join(hashes("a"), "a").join(hashes("b"), "b").join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    links = written(joined.select("a", "b", "text_a", "text_b").mapInPandas(_verifier(k, threshold), "a long, b long, similarity double"), "links")
    own = rows.select("id", "h1", "h2").join(classes.select("h1", "h2", "d", F.col("sk").isNotNull().alias("paired")), ["h1", "h2"])
    own = own.groupBy(key(F.col("id")).alias("k"))
    first = F.min(F.struct(~F.col("paired"), "d"))["d"].alias("d")  # of rows that disagree, one that is long enough
    members = own.agg(F.coalesce(F.min(F.when(F.col("paired"), F.col("id"))), F.min("id")).alias("id"), first, F.max("paired").alias("paired"))
    return NearDuplicates(written(members.select("id", "d", "paired"), "members"), links)
