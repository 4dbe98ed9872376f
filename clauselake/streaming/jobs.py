"""Queue-like ingest and event windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def enqueue(jobs: DataFrame, folder: str, batch_id: str, most: int = 100) -> None:
    """Append a batch of queued jobs to the landing folder; more than ``most`` are refused."""
    n = jobs.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a batch has at most {most} jobs")
    jobs.withColumn("batch_id", F.lit(batch_id)).withColumn("extraction_status", F.lit("queued")).write.mode("append").parquet(folder)


def queue(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """The landing folder as a stream; each file is taken once, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drain(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run ``work`` on each micro-batch and write its rows under the batch's number, so that a repeated batch replaces itself.

    Without an interval all that is there is taken and the query ends. A failing batch is retried by the next start."""

    def each(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/part={number}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def isolated(df: DataFrame, work: Callable[[str | None], str], column: str) -> DataFrame:
    """df with result, error and extraction_status: ``work`` runs on each value of a column, and a failure is that row's own."""

    @F.pandas_udf("result string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            try:
                out.append((work(v), None))
            except Exception as e:
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["result", "error"])

    done = df.withColumn("__r", run(column)).withColumn("result", F.col("__r.result")).withColumn("error", F.col("__r.error")).drop("__r")
    return done.withColumn("extraction_status", F.when(F.col("error").isNull(), "done").otherwise("failed"))


def failed_again(results: DataFrame) -> DataFrame:
    """Failed jobs, to be queued once more, with retry_count raised."""
    return results.where("extraction_status = 'failed'").withColumn("extraction_status", F.lit("queued")).withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + 1)


def event_counts(events: DataFrame, time_col: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts and sums; batch and stream alike. Rows later than ``late`` are dropped by a stream."""
    e = events.withWatermark(time_col, late) if events.isStreaming else events
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    g = e.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n_events", "total_value")


def sessions(events: DataFrame, time_col: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark(time_col, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events"))
    return g.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def once(stream: DataFrame, ids: list[str], time_col: str, late: str = "1 hour") -> DataFrame:
    """Rows delivered again within the watermark are dropped."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(ids) if stream.isStreaming else stream.dropDuplicates(ids)


def active_states(alerts: DataFrame, keys: list[str], is_active: Column, time_col: str) -> DataFrame:
    """Life cycle of alerts in a stream or table of observations: latest observation of each key, active or resolved."""
    last = alerts.groupBy(*keys).agg(F.max_by(is_active, time_col).alias("a"), F.max(time_col).alias("observed_at"))
    return last.select(*keys, F.when(F.col("a"), "active").otherwise("resolved").alias("state"), "observed_at")
