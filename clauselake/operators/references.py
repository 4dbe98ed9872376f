"""References to records that do not exist.

``reference_states`` takes referring rows with a (possibly composite) reference and a referenced
table. References are grouped by null mask; each mask is anti-joined on its non-null columns for what is
missing, and joined on them for the state of what is there:

* ``simple``  - a reference with any null column refers to nothing (state ``none``);
* ``full``    - all null refers to nothing, a partly null reference is ``invalid``;
* ``partial`` - a partly null reference must agree with some row on its non-null columns.

States, the first that applies: ``none`` (refers to nothing), ``invalid``, ``missing`` (no such row),
``deleted`` (the latest row of the target is deleted; under ``partial``: of every matching target),
``late`` (the earliest row of the target is younger than the referring row; under ``partial``: of every
matching target that is not deleted), ``ok``.

Edge cases: null, empty and blank key columns count as null; repeated target rows are folded by key;
of target rows with one timestamp a deleted one counts as the later; null timestamps sort first and
never make a reference ``late``; empty tables give ``missing`` for all or no rows; extra columns of
either side with any name are ignored or passed through (internal names start with ``__r_``).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.keys import key


def _targets(target: DataFrame, cols: Sequence[str], created: str, deleted: Column) -> DataFrame:
    """One row for each full key: is the latest row deleted, and when the first came."""
    keys = [key(F.col(c)).alias(f"__r_k{i}") for i, c in enumerate(cols)]
    rows = target.select(*keys, F.col(created).alias("__r_at"), F.coalesce(deleted, F.lit(False)).alias("__r_del"))
    return rows.groupBy(*[f"__r_k{i}" for i in range(len(cols))]).agg(
        F.max(F.struct("__r_at", "__r_del"))["__r_del"].alias("__r_del"), F.min("__r_at").alias("__r_first")
    )


def reference_states(
    refs: DataFrame, ref_cols: Sequence[str], target: DataFrame, target_cols: Sequence[str], *,
    ref_created: str, target_created: str, target_deleted: Column, match: str = "simple",
) -> DataFrame:
    """refs with a column ``ref_state``. An anti-join and a join, over the same exchange, for each null mask that the match semantics let through."""
    if match not in ("simple", "full", "partial"):
        raise ValueError(match)
    refs = refs.drop("ref_state")
    n = len(ref_cols)
    keyed = refs.withColumns({f"__r_q{i}": key(F.col(f"`{c}`")) for i, c in enumerate(ref_cols)})
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f"__r_q{i}").isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(n)])
    keyed = keyed.withColumn("__r_mask", mask)
    full = (1 << n) - 1
    parts = _targets(target, target_cols, target_created, target_deleted)
    out = []
    for m in range(1, full + 1) if match == "partial" else [full]:
        on = [i for i in range(n) if m >> i & 1]
        if m == full:
            t = parts
        else:  # deleted if every match is; the first among those that are not
            some = parts.where(reduce(lambda a, b: a & b, [F.col(f"__r_k{i}").isNotNull() for i in on]))
            t = some.groupBy(*[f"__r_k{i}" for i in on]).agg(F.min("__r_del").alias("__r_del"), F.min(F.when(~F.col("__r_del"), F.coalesce("__r_first", F.lit(datetime.min)))).alias("__r_first"))
        t = t.select(*[f"__r_k{i}" for i in on], "__r_del", "__r_first")
        cond = reduce(lambda a, b: a & b, [F.col(f"__r_q{i}") == F.col(f"__r_k{i}") for i in on])
        mine = keyed.where(F.col("__r_mask") == m)
        state = F.when(F.col("__r_del"), "deleted").when(F.col("__r_first") > F.col(f"`{ref_created}`"), "late").otherwise("ok")
        for rows, found in ((mine.join(t, cond, "left_anti"), F.lit("missing")), (mine.join(t, cond), state)):
            out.append(rows.withColumn("ref_state", found).select(*[f"`{c}`" for c in refs.columns], "ref_state"))
    idle = keyed.where(F.col("__r_mask") == 0 if match == "partial" else F.col("__r_mask") != full)
    out.append(idle.withColumn("ref_state", F.when((F.col("__r_mask") != 0) & F.lit(match == "full"), "invalid").otherwise("none")).select(*[f"`{c}`" for c in refs.columns], "ref_state"))
    return reduce(DataFrame.unionAll, out)


def referring_rows(df: DataFrame, tab_name: str, row_key: str, ref_cols: Sequence[str], created: str = "created_at") -> DataFrame:
    """One row for each key: (tab_name, row_key, ref_0.., created_at), of the earliest row; ties by the reference."""
    k = key(F.col(row_key))
    refs = [F.col(c).alias(f"ref_{i}") for i, c in enumerate(ref_cols)]
    first = F.min(F.struct(F.col(created).alias("at"), *refs, F.col(row_key).alias("id")))
    g = df.where(k.isNotNull()).groupBy(k.alias("__r_row")).agg(first.alias("f"))
    return g.select(F.lit(tab_name).alias("tab_name"), F.col("f.id").alias("row_key"), *[F.col(f"f.ref_{i}").alias(f"ref_{i}") for i in range(len(ref_cols))], F.col("f.at").alias("created_at"))


def orphan_report(states: DataFrame, created: str = "created_at") -> DataFrame:
    """Counts for each table, month and state of ``reference_states`` rows; pre-aggregated before the shuffle."""
    return states.groupBy("tab_name", F.date_format(created, "yyyy-MM").alias("ref_month"), "ref_state").agg(F.count("*").alias("n_rows"))
