"""Scans with defined behaviour: missing tables, single rows, bounded and keyed reads, overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clauselake.functions.arrays import merge_patch
from clauselake.operators.dml import conform


def scan(spark: SparkSession, path: str, schema: StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; columns prune the scan, a schema is conformed to."""
    df = spark.read.option("mergeSchema", "true").parquet(path) if schema is not None else spark.read.parquet(path)
    df = conform(df, schema) if schema is not None else df
    return df.select(*columns) if columns else df


def scan_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one where it does not exist."""
    try:
        return scan(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], schema)
        raise


def without(df: DataFrame, large: Sequence[str]) -> DataFrame:
    """List scan: all but the large columns, which the Parquet scan then never reads."""
    return df.drop(*large)


def maybe_single(df: DataFrame, where: Column) -> DataFrame:
    """No row or one; more raise when the result is read. The first two matches are all that is compared."""
    two = df.where(where).limit(2)
    n = two.agg(F.count(F.lit(1)).alias("n"))
    return two.crossJoin(F.broadcast(n)).where(F.when(F.col("n") <= 1, True).otherwise(F.raise_error(F.lit("more than one row")).cast("boolean"))).drop("n")  # n: one row


def bounded(df: DataFrame, order: Sequence[Column], limit: int | None = None, most: int = 5000, usual: int = 2000) -> DataFrame:
    """The first rows in order: the limit is kept between 1 and ``most``."""
    return df.orderBy(*order).limit(min(most, max(1, usual if limit is None else limit)))


def keyed(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is listed; repeated and null keys of the list make no difference."""
    return df.join(keys.select(*on), list(on), "left_semi")


def overlaid(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """base (key, fields map) with the patch of its key laid over: the last patch (by patched_at) wins, null values too."""
    p = patches.groupBy(F.col(key)).agg(F.max_by("patch", "patched_at").alias("patch"))
    return base.join(p, key, "left").withColumn("fields", merge_patch(F.col("fields"), F.col("patch"))).drop("patch")
