"""Operation logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A log that is read on as files arrive."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def live_keys(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op) resolved so far, for update or complete mode; replays change nothing."""
    return log.groupBy(*keys).agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))


def windowed_rates(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by type and event-time window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there into a table in memory."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
