"""Session helpers: table access, shared scratch tables, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many (counted) rows.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_roots: dict[str, str] = {}
_folders: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's spark.checkpoint.dir, else (tests, local runs) a temporary one.

    Raises on a cluster without the setting: a machine-local folder would not be seen by other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_roots.setdefault(spark.sparkContext.applicationId, os.path.join(tempfile.gettempdir(), f"clauselake-{os.getuid()}"))
    return root.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below scratch_root, removed when the session ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    _folders.append(path)
    return path


def cleanup(spark: SparkSession) -> None:
    """Remove all scratch tables written so far: for long sessions, once the results made from them are stored."""
    jvm = spark.sparkContext._jvm
    while _folders:
        p = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more; what was made from it must be written itself."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].rpartition("-")[2] in {x.rpartition("-")[2] for x in _folders}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written_to(df: DataFrame, folder: str, part: int) -> tuple[DataFrame, int]:
    """df written as one numbered part of a folder, read back, and its rows; the whole folder is read by ``folder/*``."""
    seen = Observation()
    path = f"{folder}/{part:07d}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def written_rows(df: DataFrame, label: str = "t") -> tuple[DataFrame, int]:
    """written, and the number of rows, counted while writing."""
    seen = Observation()
    df = written(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return df, seen.get["n"]


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted size allows it; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df
