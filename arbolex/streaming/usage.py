"""Running usage counters and sessions with Structured Streaming."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.session import recovered, swapped


def by_tool(calls: DataFrame) -> DataFrame:
    """calls, errors, total and largest milliseconds of each tool; for batches and streams alike (update or complete
    mode)."""
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))


def by_day(calls: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """calls and errors of each day by event time; a stream drops a day's state once the watermark has passed it."""
    rows = calls.withWatermark(ts, late) if calls.isStreaming else calls
    return rows.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors")).select(F.to_date("w.start").alias("day"), "calls", "errors")


def sessions(calls: DataFrame, ts: str = "ts", gap: str = "60 minutes", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Gap sessions by event time, over the whole stream or by key."""
    rows = calls.withWatermark(ts, late) if calls.isStreaming else calls
    grouped = rows.groupBy(*(by or []), F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("calls")).select(*(by or []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def log_lines(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the JSON lines of a folder of log files, as ``logs.calls`` reads them."""
    reader = spark.readStream if per_trigger is None else spark.readStream.option("maxFilesPerTrigger", per_trigger)
    return reader.text(path).withColumn("ord", F.xxhash64("value"))


def keep_written(counters: DataFrame, path: str, checkpoint: str, every: str = "1 hour", once: bool = False):
    """Keeps a Parquet table of the counters up to date. The checkpoint restores the state after a restart, and a batch
    that is run again overwrites the same content. A batch is written beside the table and then put in its place."""

    def flush(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}.tmp")
        swapped(batch.sparkSession, f"{path}.tmp", path)

    out = counters.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(flush)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def read_written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The counters as last written; where they are missing, broken or of another layout, an empty table: a fresh start."""
    path = recovered(spark, path)
    fresh = spark.createDataFrame([], schema)
    try:
        got = spark.read.parquet(path)
        if set(fresh.columns) <= set(got.columns):
            got = got.select(*fresh.columns)
            got.count()
            return got
    except (PySparkException, Py4JJavaError):
        pass
    return fresh
