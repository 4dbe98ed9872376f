"""Hashed arrays of bounded size for broadcasts: bitmaps of values, and about how often values occur.

The number of buckets follows the counted values up to ``MOST`` (a bitmap of 16 MB, counts of 16 MB).
Both are filters or orders only; what passes is always decided exactly afterwards, so a full array costs
time and never a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 27  # bits of a bucket number
COUNTS = 24  # the same for counts, which need a byte each
_CHUNK = 12
_SCALE = 8.0  # steps of a doubling


def bits_for(n: int, most: int = MOST) -> int:
    """Bits of bucket numbers for n values: sixteen buckets or more a value."""
    return min(most, max(16, int(n).bit_length() + 4))


def bucket(c: Column, bits: int) -> Column:
    """Bucket number of a long."""
    return c.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def bitmap(buckets: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """(words, bits) with the bits of column b set; at most 2^15 rows of 512 bytes reach the driver."""
    rows = buckets.groupBy(F.expr(f"b >> {_CHUNK}").alias("chunk"), F.expr(f"(b & {(1 << _CHUNK) - 1}) >> 5").alias("w")).agg(F.expr("bit_or(shiftleft(1L, b & 31))").alias("bits"))
    rows = rows.groupBy("chunk").agg(F.collect_list(F.struct("w", "bits")).alias("ws"))
    out = np.zeros((1 << bits) // 32, dtype=np.uint32)
    for r in rows.collect():
        for w in r.ws:
            out[(r.chunk << (_CHUNK - 5)) + w.w] = w.bits
    return out, bits


def has(map_: tuple[np.ndarray, int], values: np.ndarray) -> np.ndarray:
    words, bits = map_
    b = values.astype(np.uint64) & np.uint64((1 << bits) - 1)
    return (words[(b >> np.uint64(5)).astype(np.int64)] >> (b & np.uint64(31)).astype(np.uint32)) & 1 == 1


def counts(rows: DataFrame, bits: int) -> np.ndarray:
    """uint8 array of 2^bits steps of the logarithm of column n by bucket b (each bucket once); 0 for none, 1 for one."""
    chunk = F.expr(f"b >> {_CHUNK}").alias("chunk")
    step = F.least(F.lit(255), F.lit(1) + F.floor(F.log2(F.col("n").cast("double")) * _SCALE)).cast("int")
    packed = rows.groupBy(chunk).agg(F.collect_list(F.struct(F.expr(f"b & {(1 << _CHUNK) - 1}").alias("w"), step.alias("s"))).alias("ws"))

    def pack(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for ws in pdf.ws:
                a = np.zeros(1 << _CHUNK, dtype=np.uint8)
                a[[w["w"] for w in ws]] = [w["s"] for w in ws]
                out.append(a.tobytes())
            yield pd.DataFrame({"chunk": pdf.chunk, "a": out})

    out = np.zeros(max(1 << bits, 1 << _CHUNK), dtype=np.uint8)
    for r in packed.mapInPandas(pack, "chunk int, a binary").collect():  # at most 4 096 rows of 4 kB
        out[r.chunk << _CHUNK : (r.chunk + 1) << _CHUNK] = np.frombuffer(r.a, dtype=np.uint8)
    return out


def most_in(steps: np.ndarray) -> np.ndarray:
    """Upper bound of the counts that have these steps."""
    return np.where(steps > 0, np.exp2(steps / _SCALE), 0).astype(np.int64)
