"""Reachability over edges, level by level; every level keeps each node once, so cycles end by themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.session import broadcast_if_small, written_rows


def reachable(start: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(start_id, node_id, hop_depth): nodes within max_depth hops of each start, with the fewest hops.

    start: (start_id). edges: (source_id, target_id); null ends lead nowhere, repeated edges count once.
    """
    e = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id").distinct().persist()
    frontier, n = written_rows(start.where("start_id IS NOT NULL").distinct().select("start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("hop_depth")), "hops")
    levels = [frontier]
    for depth in range(1, max_depth + 1):
        if not n:
            break
        near = broadcast_if_small(frontier.select("start_id", F.col("node_id").alias("source_id")), n)
        step = e.join(near, "source_id").select("start_id", F.col("target_id").alias("node_id")).distinct()
        seen = reduce(DataFrame.unionAll, [x.select("start_id", "node_id") for x in levels])
        frontier, n = written_rows(step.join(seen, ["start_id", "node_id"], "left_anti").withColumn("hop_depth", F.lit(depth)), "hops")
        levels.append(frontier)
    e.unpersist()
    return reduce(DataFrame.unionAll, levels)


def chain_up(df: DataFrame, id_col: str, parent_col: str, max_hops: int = 20) -> DataFrame:
    """(node_id, ancestor_id, hops): each row's parents up to max_hops; a missing parent ends the chain, a cycle goes round until the bound."""
    up = df.select(F.col(id_col).alias("i"), F.col(parent_col).alias("p")).where("i IS NOT NULL")
    known = up.select("i").distinct()
    link = up.join(known.select(F.col("i").alias("p")), "p", "left_semi").select("i", "p").distinct().persist()
    frontier, n = written_rows(link.select(F.col("i").alias("node_id"), F.col("p").alias("ancestor_id"), F.lit(1).alias("hops")), "chain")
    levels = [frontier]
    for hops in range(2, max_hops + 1):
        if not n:
            break
        near = broadcast_if_small(frontier.select("node_id", F.col("ancestor_id").alias("i")), n)
        frontier, n = written_rows(link.join(near, "i").select("node_id", F.col("p").alias("ancestor_id"), F.lit(hops).alias("hops")), "chain")
        levels.append(frontier)
    link.unpersist()
    return reduce(DataFrame.unionAll, levels)
