"""Parent-child rows to full hierarchies.

``hierarchy`` extends a frontier level by level from the roots: each level joins the frontier with the rows
not reached yet, and is written to the shared scratch folder, so a lost executor costs one level. The rows
not reached are written anew whenever half of them were reached, so the work follows the rows below each
level and not rows times depth. Once at most ``finish`` rows are left (a counted bound, some tens of MB),
one task takes the remaining levels, long thin chains above all; the result is the same.

Nodes that no level reaches lie on a cycle or below one: pointer doubling over those alone finds the nodes
that repeat (the cycles) and the smallest id of each, and a second frontier from the cycles gives the
nodes below. Paths travel only if they are asked for.

Edge cases: the latest row of a key gives its parent (ties: the larger parent id); blank and unknown
parents make a root; a node that is its own parent is a cycle; rows with a blank id are ignored; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions.keys import key
from clauselake.session import scratch_folder, written, written_rows, written_to

FINISH = 100_000  # rows of which one task takes all remaining levels
_BROADCAST = 8 << 20  # bytes of a frontier that are broadcast
_ROW = 100  # bytes of a frontier row, and of each id of a path
_COLUMNS = "k string, node_id string, root_id string, depth int, node_state string"
_PATH = ", path array<string>"


def latest_parents(df: DataFrame, id_col: str, parent_col: str, created: str) -> DataFrame:
    """(k, node_id, parent_k): one row for each key, parent of its latest row."""
    k = key(F.col(id_col))
    rows = df.where(k.isNotNull()).select(k.alias("k"), F.col(id_col).alias("node_id"), key(F.col(parent_col)).alias("parent_k"), F.col(created).alias("at"))
    g = rows.groupBy("k").agg(F.min("node_id").alias("node_id"), F.max(F.struct("at", "parent_k"))["parent_k"].alias("parent_k"))
    return g


def _small(df: DataFrame, rows: int, ids: int = 1) -> DataFrame:
    """Broadcast if the counted rows of so many ids are small."""
    return F.broadcast(df) if rows * _ROW * (1 + ids) <= _BROADCAST else df


def _below(up: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Children sorted by parent, and where each parent's begin (n + 1 places)."""
    order = np.argsort(up, kind="stable")
    return order, np.searchsorted(up[order], np.arange(n + 1))


def _finish(paths: bool):
    """All levels below the frontier within one task, then the cycles and what hangs on them.

    Rows with a root_id are the frontier, the others are left; only the latter come out, each once."""
    names = [c.split()[0] for c in (_COLUMNS + (_PATH if paths else "")).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=names + ["parent_k"])], ignore_index=True)
        n = len(pdf)
        if not n:
            return
        left = pdf.root_id.isna().to_numpy()
        up = np.where(left, pd.Index(pdf.k).get_indexer(pdf.parent_k.where(left, None)), -1)
        children, begin = _below(up, n)
        node, root, depth, state = (pdf[c].to_numpy(dtype=object) for c in ("node_id", "root_id", "depth", "node_state"))
        path: dict[int, list[str]] = {i: list(pdf.path[i]) for i in np.flatnonzero(~left)} if paths else {}
        seen = ~left

        def out(rows: np.ndarray) -> pd.DataFrame:
            made = {"k": pdf.k.to_numpy(dtype=object)[rows], "node_id": node[rows], "root_id": root[rows], "depth": depth[rows].astype(np.int32), "node_state": state[rows]}
            return pd.DataFrame(made | ({"path": [path[i] for i in rows]} if paths else {}))

        def descend(frontier: np.ndarray) -> Iterator[pd.DataFrame]:
            while len(frontier):
                count = begin[frontier + 1] - begin[frontier]
                at = np.arange(count.sum()) + np.repeat(begin[frontier] - (np.cumsum(count) - count), count)
                step, parent = children[at], np.repeat(frontier, count)
                new = ~seen[step]
                step, parent = step[new], parent[new]
                root[step], depth[step] = root[parent], depth[parent] + 1
                state[step] = np.where(state[parent] == "cycle", "below_cycle", state[parent])
                seen[step] = True
                if paths:
                    for i, p in zip(step.tolist(), parent.tolist()):
                        path[i] = path[p] + [node[i]]
                    for p in frontier.tolist():
                        del path[p]
                if len(step):
                    yield out(step)
                frontier = step

        yield from descend(np.flatnonzero(seen))
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return
        to = up.copy()
        for _ in range(len(rest).bit_length() + 1):
            to[rest] = to[to[rest]]
        on = np.unique(to[rest])
        rank = np.argsort(np.argsort(node[on]))
        low = np.full(n, n)
        low[on], jump = rank, up.copy()
        for _ in range(len(on).bit_length() + 1):
            low[on] = np.minimum(low[on], low[jump[on]])
            jump[on] = jump[jump[on]]
        root[on], depth[on], state[on], seen[on] = np.sort(node[on])[low[on]], 0, "cycle", True
        if paths:
            path.update({i: [node[i]] for i in on.tolist()})
        yield out(on)
        yield from descend(on)

    return run


def _descend(frontier: DataFrame, n_frontier: int, left: DataFrame, n_left: int, folder: str, paths: bool, finish: int, level: int) -> tuple[DataFrame | None, int]:
    """Write all levels below the frontier into folder. Returns what no level reached, and its rows."""
    cols = _COLUMNS + (_PATH if paths else "")
    tops, reached = [], 0
    while n_left and n_frontier:
        level += 1
        if n_left <= finish and n_frontier <= finish:
            fresh = left if not tops else left.join(reduce(DataFrame.unionAll, tops), left.parent_k == F.col("top_k"), "left_anti")
            none = lambda c: F.lit(None).cast(dict(frontier.dtypes)[c]).alias(c)
            rest = fresh.select("k", "node_id", *[none(c) for c in frontier.columns[2:]], "parent_k")
            both = frontier.withColumn("parent_k", F.lit(None).cast("string")).unionByName(rest)
            written_to(both.coalesce(1).mapInPandas(_finish(paths), cols), folder, level)  # at most 2 * finish rows
            return None, 0
        top = frontier.select(F.col("k").alias("top_k"), "root_id", "depth", "node_state", *(["path"] if paths else []))
        step = left.join(_small(top, n_frontier, level if paths else 1), left.parent_k == F.col("top_k")).select(
            "k", "node_id", "root_id", (F.col("depth") + 1).alias("depth"),
            F.when(F.col("node_state") == "cycle", "below_cycle").otherwise(F.col("node_state")).alias("node_state"),
            *([F.concat("path", F.array("node_id")).alias("path")] if paths else []))
        tops.append(frontier.select(F.col("k").alias("top_k")))
        frontier, n_frontier = written_to(step, folder, level)
        reached += n_frontier
        if 2 * reached >= n_left and n_frontier:
            left, n_left = written_rows(left.join(reduce(DataFrame.unionAll, tops), left.parent_k == F.col("top_k"), "left_anti"), "left")
            tops, reached = [], 0
    if tops and n_left:
        left, n_left = written_rows(left.join(reduce(DataFrame.unionAll, tops), left.parent_k == F.col("top_k"), "left_anti"), "left")
    return left, n_left


def _cycles(rest: DataFrame) -> DataFrame:
    """(k, node_id, root_id) of the nodes on cycles. rest: (k, node_id, parent_k), each parent in rest."""
    jump = written(rest.select("k", F.col("parent_k").alias("to")), "jump")
    size = -1
    while True:
        reached = jump.select("to").distinct().count()
        if reached == size:
            break
        size = reached
        a, b = jump.alias("a"), jump.alias("b")
        jump = written(a.join(b, F.col("a.to") == F.col("b.k")).select(F.col("a.k").alias("k"), F.col("b.to").alias("to")), "jump")
    on = rest.join(jump.select(F.col("to").alias("k")).distinct(), "k", "left_semi")
    best = written(on.select("k", F.col("parent_k").alias("to"), F.col("node_id").alias("low")), "low")
    while True:
        a, b = best.alias("a"), best.alias("b")
        step = written(
            a.join(b, F.col("a.to") == F.col("b.k")).select(
                F.col("a.k").alias("k"), F.col("b.to").alias("to"), F.least("a.low", "b.low").alias("low"), (F.col("b.low") < F.col("a.low")).alias("moved")
            ), "low")
        best = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return rest.join(best.select("k", F.col("low").alias("root_id")), "k").select("k", "node_id", "root_id")


def hierarchy(df: DataFrame, id_col: str, parent_col: str, created: str = "created_at", *, paths: bool = True, finish: int = FINISH) -> DataFrame:
    """(node_id, root_id, depth, node_state[, path]): one row for each key.

    tree: path runs from the root to the node. cycle: root_id is the smallest id on it, path the node
    alone. below_cycle: path runs from the cycle's node to the node.
    """
    spark = df.sparkSession
    cols = _COLUMNS + (_PATH if paths else "")
    nodes = latest_parents(df, id_col, parent_col, created)
    known = nodes.select(F.col("k").alias("known_k"))
    linked, n = written_rows(nodes.join(known, nodes.parent_k == known.known_k, "left").select("k", "node_id", F.col("known_k").alias("parent_k")), "linked")
    folder = scratch_folder(spark, "levels")
    own = [F.array("node_id").alias("path")] if paths else []
    roots = linked.where("parent_k IS NULL").select("k", "node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), F.lit("tree").alias("node_state"), *own)
    frontier, n_roots = written_to(roots, folder, 0)
    left = linked.where("parent_k IS NOT NULL")
    if n_roots:
        left, n_left = _descend(frontier, n_roots, left, n - n_roots, folder, paths, finish, 0)
    else:
        n_left = n
    if n_left and n_left <= finish:
        none = [F.lit(None).cast(t).alias(c) for c, t in frontier.dtypes[2:]]
        written_to(left.select("k", "node_id", *none, "parent_k").coalesce(1).mapInPandas(_finish(paths), cols), folder, 1_000_000)
    elif n_left:
        start = _cycles(left).select("k", "node_id", "root_id", F.lit(0).alias("depth"), F.lit("cycle").alias("node_state"), *own)
        start, n_on = written_to(start, folder, 1_000_000)
        below, n_below = written_rows(left.join(start.select("k"), "k", "left_anti"), "below")
        _descend(start, n_on, below, n_below, folder, paths, finish, 1_000_000)
    return spark.read.schema(cols).parquet(f"{folder}/*").drop("k")


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance): every node below every node, from the paths; no shuffle."""
    above = tree.select(F.col("node_id").alias("descendant_id"), "path", F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("i", "ancestor_id"))
    return above.select("ancestor_id", "descendant_id", (F.size("path") - 1 - F.col("i")).alias("distance"))


def cycle_pairs(tree: DataFrame, df: DataFrame, id_col: str, parent_col: str, created: str = "created_at") -> DataFrame:
    """(ancestor_id, descendant_id, distance) for the nodes below cycles; every node of the cycle is an ancestor, at its least distance.

    tree: hierarchy of df. Pairs of two nodes of one cycle, which have no end, are left out. One join for
    each step around the longest cycle.
    """
    off = written(tree.where("node_state <> 'tree'"), "off")
    below = off.where("node_state = 'below_cycle'")
    parents = latest_parents(df, id_col, parent_col, created).select("k", "parent_k")
    on = off.where("node_state = 'cycle'").select(key(F.col("node_id")).alias("k"), "node_id").join(parents, "k")
    on, n_on = written_rows(on, "on")
    up = on.select("k", F.col("node_id").alias("to_id"), "parent_k")
    entered = below.select(F.get("path", F.lit(0)).alias("entry")).distinct()
    walk, rows = written_rows(entered.join(on, F.col("entry") == on.node_id).select("entry", F.lit(0).alias("steps"), F.col("node_id").alias("at_id"), "parent_k"), "walk")
    walks: list[DataFrame] = []
    while rows:
        step = walk.drop("at_id").withColumnRenamed("parent_k", "next_k").join(_small(up, n_on), F.col("next_k") == F.col("k"))
        step = step.where("to_id <> entry").select("entry", (F.col("steps") + 1).alias("steps"), F.col("to_id").alias("at_id"), "parent_k")
        walk, rows = written_rows(step, "walk")
        walks.append(walk)
    pairs = ancestor_pairs(below)
    if not walks:
        return pairs
    around = reduce(DataFrame.unionAll, walks).select("entry", "steps", "at_id")
    far = below.select(F.col("node_id").alias("descendant_id"), "depth", F.get("path", F.lit(0)).alias("entry")).join(around, "entry")
    return pairs.unionAll(far.select(F.col("at_id").alias("ancestor_id"), "descendant_id", (F.col("depth") + F.col("steps")).alias("distance")))
