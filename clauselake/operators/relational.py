"""Joins, aggregates and window patterns that the domain queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauselake.session import written


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (total, for a defined result). Each task keeps one row a key before the shuffle (window group limit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df range partitioned by keys and order and written, with __p, the number of the partition: a hot key spans several."""
    return written(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "seq") -> DataFrame:
    """Number of each row within its key, from 1; a hot key is counted in ranges that are added up, not in one task."""
    parts = ranged(df, keys, order)
    counts = parts.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, "__p", (F.sum("__n").over(W.partitionBy(*keys).orderBy("__p")) - F.col("__n")).alias("__b")).where("__b > 0")  # only keys that span partitions
    same = F.col("p.__p") == F.col("b.__p")
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"b.{k}"))
    seq = parts.withColumn("__s", F.row_number().over(W.partitionBy(*keys, "__p").orderBy(*order))).alias("p")
    return seq.join(before.alias("b"), same, "left").select(*[F.col(f"p.{c}") for c in df.columns if c != name], (F.col("__s") + F.coalesce("__b", F.lit(0))).cast("int").alias(name))


def chunked(df: DataFrame, key: str, order: Sequence[Column], size: int, fields: Sequence[str]) -> DataFrame:
    """(key, chunk, rows): the rows of a key in arrays of at most ``size``, in order, as batches for calls outside."""
    n = numbered(df.select(key, *[f for f in fields if f != key]), [key], order, "__i")
    g = n.groupBy(key, F.floor((F.col("__i") - 1) / size).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("__i", *fields))).alias("rows"))
    return g.withColumn("rows", F.transform("rows", lambda x: F.struct(*[x[f].alias(f) for f in fields])))


def next_ids(df: DataFrame, existing: DataFrame, id_col: str, prefix: str, order: Sequence[Column], width: int = 3) -> DataFrame:
    """df with ids after the highest number of ``existing``. Numbers come from per-partition counts: no single-task window over df."""
    top = existing.select(F.max(F.regexp_extract(id_col, rf"^{prefix}(\d+)$", 1).try_cast("long")).alias("top")).select(F.coalesce("top", F.lit(0)).alias("top"))
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    counts = parts.groupBy("__p").count()
    before = counts.select("__p", (F.sum("count").over(W.orderBy("__p")) - F.col("count")).alias("__b"))  # a row a partition
    seq = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return (
        parts.join(F.broadcast(before), "__p").crossJoin(F.broadcast(top))
        .withColumn("__n", seq + F.col("__b") + F.col("top"))
        .withColumn(id_col, F.concat(F.lit(prefix), F.when(F.length(F.col("__n").cast("string")) < width, F.lpad(F.col("__n").cast("string"), width, "0")).otherwise(F.col("__n").cast("string"))))
        .drop("__p", "__b", "__n", "top")
    )


def nested(parent: DataFrame, child: DataFrame, on: str, name: str, order: str, fields: Sequence[str]) -> DataFrame:
    """parent with an array of its children's structs, ordered; [] without any."""
    g = child.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    return parent.join(g, on, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(g.dtypes)[name])))


def containing_interval(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, seq: str) -> DataFrame:
    """Each point with the first span (by seq) of its key that holds it: start <= at < end; points outside all spans keep nulls."""
    s = spans.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(seq).alias("span_seq"))
    hit = points.join(s, (F.col(key) == F.col("__k")) & (F.col(at) >= F.col("__s")) & (F.col(at) < F.col("__e")), "left")
    return hit.groupBy(*points.columns).agg(F.min("span_seq").alias("span_seq"))


def elementary_segments(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, seg_start, seg_end, n_spans): the key's axis cut at every boundary, with the number of spans over each part; empty spans and uncovered parts are left out."""
    ok = spans.where(F.col(start) < F.col(end))
    edges = ok.select(key, F.col(start).alias("at"), F.lit(1).alias("d")).unionAll(ok.select(key, F.col(end).alias("at"), F.lit(-1).alias("d")))
    steps = edges.groupBy(key, "at").agg(F.sum("d").alias("d"))
    parts = ranged(steps, [key], [F.col("at")])  # a hot key's axis in ranges: sums before each range, and where the next begins
    w = W.partitionBy(key).orderBy("__p")
    border = parts.groupBy(key, "__p").agg(F.sum("d").alias("n"), F.min("at").alias("from"))  # a row a key and partition
    border = border.select(F.col(key).alias("__k"), F.col("__p").alias("__q"), (F.sum("n").over(w) - F.col("n")).alias("base"), F.lead("from").over(w).alias("after")).where("base <> 0 OR after IS NOT NULL")
    inside = W.partitionBy(key, "__p").orderBy("at")
    cut = parts.select(key, "__p", F.col("at").alias("seg_start"), F.lead("at").over(inside).alias("nxt"), F.sum("d").over(inside).alias("n"))
    cut = cut.join(border, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q")), "left")
    cut = cut.select(key, "seg_start", F.coalesce("nxt", "after").alias("seg_end"), (F.col("n") + F.coalesce("base", F.lit(0))).alias("n_spans"))
    return cut.where("seg_end IS NOT NULL AND n_spans > 0")


def inherited(df: DataFrame, key: str, order: str, is_item: Column, stem: Column, name: str) -> DataFrame:
    """Items of a list get the stem of the last row before them that is no item."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.when(is_item, F.last(F.when(~is_item, stem), ignorenulls=True).over(w)))


def best_match(left: DataFrame, right: DataFrame, left_key: str, tiers: Sequence[Column], right_order: Sequence[str], block: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """left joined with the right row of the lowest tier (1-based) whose condition holds, ties by right_order.

    ``block``: pairs of columns that must be equal, so that the join is a hash join and not a scan of all pairs."""
    tier = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tiers, 1))):
        tier = F.when(t, i).otherwise(tier)
    cond = F.lit(True)
    for a, b in block:
        cond = cond & (F.col(a) == F.col(b))
    hits = left.join(right, cond).withColumn("match_tier", tier).where("match_tier IS NOT NULL")
    w = W.partitionBy(left_key).orderBy("match_tier", *right_order)
    return hits.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
