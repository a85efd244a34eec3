"""Incremental forms: files arriving in a folder, deduplicated, counted and retried with checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def first_of_each(rows: DataFrame, keys: list[str], at: str = "created_at", late: str = "7 days") -> DataFrame:
    """The first row of each key; what comes later than ``late`` after the watermark is not looked at."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def daily_counts(rows: DataFrame, at: str = "created_at", late: str = "1 day") -> DataFrame:
    """Documents by day and status, each day once it is over."""
    day = F.window(at, "1 day")
    return rows.withWatermark(at, late).groupBy(day, "status").agg(F.count(F.lit(1)).alias("documents")).select(F.col("window.start").alias("day"), "status", "documents")


def learn_profiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts of documents and corrections by key, for a sink in update mode."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("corrected")).alias("corrected"))


def drain(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Handles all that is there, then stops; run again, it goes on where it was."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def retry_delay(attempts: Column | str) -> Column:
    """Seconds to wait after the n-th failed attempt; null when there is none left."""
    n = F.col(attempts) if isinstance(attempts, str) else attempts
    return F.when(n < 3, (F.lit(30) * F.pow(F.lit(2), n - 1)).cast("bigint"))


def claimable(jobs: DataFrame, as_of: str, most: int) -> DataFrame:
    """The oldest jobs that may run now."""
    return jobs.where((F.col("status") == "queued") & (F.col("run_after") <= F.lit(as_of).cast("timestamp_ntz"))).orderBy("created_at", "job_id").limit(most)


def stale(jobs: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Running jobs whose worker is lost, back in the queue."""
    lost = (F.col("status") == "running") & (F.col("locked_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes"))
    return jobs.withColumns({"requeued": F.coalesce(lost, F.lit(False)), "status": F.when(lost, "queued").otherwise(F.col("status"))})


def learn(rows: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keeps running counts by key: each batch writes the rows that it changed under its number; the last one counts."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    query = learn_profiles(rows, keys).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def learned(spark: SparkSession, keys: list[str], out: str) -> DataFrame:
    """The newest counts of each key."""
    rows = spark.read.parquet(f"{out}/batch=*")
    newest = F.max_by(F.struct("documents", "corrected"), "batch").alias("x")
    return rows.groupBy(*keys).agg(newest).select(*keys, "x.documents", "x.corrected")
