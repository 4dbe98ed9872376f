"""Changes to tables as DataFrame results: what a table is after the change. Nothing is written here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema only, in its order and types; missing ones are null, unknown ones dropped, bad values null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def _match(a: str, b: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return cond


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks; new must have each key once."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def update(old: DataFrame, changes: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Non-null values of the allowed columns replace those of old; other columns of changes are ignored."""
    o, c = old.alias("o"), changes.select(*keys, *[F.col(x) for x in allowed if x in changes.columns]).alias("c")
    use = set(c.columns) - set(keys)
    return o.join(c, _match("o", "c", keys), "left").select(*[(F.coalesce(f"c.{x}", f"o.{x}") if x in use else F.col(f"o.{x}")).alias(x) for x in old.columns])


def backfill(old: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null and '' values of old are filled from source; what is there stays."""
    o, s = old.alias("o"), source.select(*keys, *columns).alias("s")
    fill = lambda x: F.coalesce(F.nullif(F.col(f"o.{x}"), F.lit("")), F.nullif(F.col(f"s.{x}"), F.lit(""))).alias(x)
    return o.join(s, _match("o", "s", keys), "left").select(*[fill(x) if x in columns else F.col(f"o.{x}").alias(x) for x in old.columns])


def delete(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def clear(old: DataFrame, where: Column, columns: Sequence[str]) -> DataFrame:
    """Soft delete: the columns become null in the rows where the condition holds."""
    return old.select(*[(F.when(where, F.lit(None)).otherwise(F.col(x)) if x in columns else F.col(x)).alias(x) for x in old.columns])


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups that new has are replaced by new's."""
    return old.join(new.select(group).distinct(), group, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def drop_unreferenced(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str) -> DataFrame:
    """Parents that some child still refers to."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_semi")


def changes(current: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and action: insert (only wanted), keep (both), resolve (only current)."""
    c, w = current.select(*keys, F.lit(1).alias("c")).distinct(), wanted.select(*keys, F.lit(1).alias("w")).distinct()
    j = c.join(w, list(keys), "full")
    return j.select(*keys, F.when(F.col("c").isNull(), "insert").when(F.col("w").isNull(), "resolve").otherwise("keep").alias("action"))


def overwrite_groups(df: DataFrame, path: str, group: str) -> None:
    """Write df partitioned by group; only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)
