"""Rule trees in three-valued logic: leaves are true, false or unknown (null), inner nodes AND or OR."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.session import written_rows


def compare(op: Column, value: Column, wanted: Column) -> Column:
    """Predicate by operator name on text values; numbers compare as numbers. null if the value is unknown; 'exists' never is."""
    x, y = value.try_cast("double"), wanted.try_cast("double")
    return (
        F.when(op == "exists", value.isNotNull())
        .when(value.isNull(), F.lit(None))
        .when(op == "equals", value == wanted).when(op == "not_equals", value != wanted)
        .when(op == "greater_than", x > y).when(op == "at_least", x >= y).when(op == "less_than", x < y).when(op == "at_most", x <= y)
        .when(op == "in", F.array_contains(F.transform(F.split(wanted, ","), lambda s: F.trim(s)), value))
        .when(op == "contains", F.lower(value).contains(F.lower(wanted)))
    )


def evaluate(nodes: DataFrame) -> DataFrame:
    """nodes: (tree_id, node_id, parent_id, op, truth[, negated]): op AND, OR or null for a leaf with truth; a negated node counts as its opposite.

    Returns (tree_id, node_id, truth, verdict) for every node; verdict is true, false, unknown, or open for nodes on or
    above a cycle, which have no value. Bottom-up: each round folds what the last one settled into counts of
    the nodes still open, so the rounds are the height of the highest tree and settled nodes are read once.
    An inner node without children is unknown.
    """
    negated = F.coalesce("negated", F.lit(False)) if "negated" in nodes.columns else F.lit(False)
    nodes = nodes.select("tree_id", "node_id", "parent_id", "op", "truth", negated.alias("negated"))
    own = lambda t: F.when(F.col("negated"), ~t).otherwise(t)
    kids = nodes.where("parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_kids"))
    todo = nodes.join(kids, ["tree_id", "node_id"], "left")
    leaf = F.col("op").isNull() | F.col("n_kids").isNull()
    new, n = written_rows(todo.where(leaf).select("tree_id", "node_id", "parent_id", own(F.when(F.col("op").isNull(), F.col("truth"))).alias("truth")), "rules")
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_done", "n_true", "n_false")]
    left, n_left = written_rows(todo.where(~leaf).select("tree_id", "node_id", "parent_id", "op", "negated", "n_kids", *zero), "rules")
    settled = [new]
    while n and n_left:
        got = new.where("parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
            F.count(F.lit(1)).alias("d"), F.count_if(F.col("truth")).alias("t"), F.count_if(~F.col("truth")).alias("f"))
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        left, _ = written_rows(left.join(got, ["tree_id", "node_id"], "left").select("tree_id", "node_id", "parent_id", "op", "negated", "n_kids", plus("n_done", "d"), plus("n_true", "t"), plus("n_false", "f")), "rules")
        unknown = F.col("n_true") + F.col("n_false") < F.col("n_kids")
        truth = F.when(F.col("op") == "AND", F.when(F.col("n_false") > 0, False).when(unknown, F.lit(None)).otherwise(True)).otherwise(F.when(F.col("n_true") > 0, True).when(unknown, F.lit(None)).otherwise(False))
        new, n = written_rows(left.where("n_done = n_kids").select("tree_id", "node_id", "parent_id", own(truth).alias("truth")), "rules")
        left, n_left = left.where("n_done < n_kids"), n_left - n
        settled.append(new)
    done = reduce(DataFrame.unionAll, settled).select("tree_id", "node_id", "truth", F.coalesce(F.col("truth").cast("string"), F.lit("unknown")).alias("verdict"))
    return done.unionAll(left.select("tree_id", "node_id", F.lit(None).cast("boolean").alias("truth"), F.lit("open").alias("verdict")))
