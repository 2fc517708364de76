"""Trace and statistics queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked


def type_statistics(trace: DataFrame) -> DataFrame:
    """Count, value size sum and sum of squares by type."""
    v = F.col("value_size").cast("long")
    return trace.groupBy("type").agg(F.count("*").alias("n"), F.sum(v).alias("size_sum"), F.sum(v * v).alias("size_sq"), F.max(v).alias("size_max"))


def access_histogram(trace: DataFrame) -> DataFrame:
    """How many keys were accessed how often, by type."""
    return trace.groupBy("type", "key").count().groupBy("type", F.col("count").alias("accesses")).agg(F.count("*").alias("keys"))


def size_histogram(trace: DataFrame, width: int = 8) -> DataFrame:
    """Value sizes by intervals."""
    return trace.groupBy("type", F.floor(F.col("value_size") / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def rates(trace: DataFrame, seconds: int) -> DataFrame:
    """Peak and average rate by type over intervals with traffic."""
    per = trace.groupBy("type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1000000)).alias("t")).agg(F.count("*").alias("n"))
    return per.groupBy("type").agg(F.max("n").alias("peak"), F.avg("n").alias("mean"), F.count("*").alias("intervals"))


def correlation(trace: DataFrame) -> DataFrame:
    """How often an access of one type follows another on the same key."""
    w = Window.partitionBy("key").orderBy("event_id")
    return trace.select(F.lag("type").over(w).alias("first"), F.col("type").alias("second")).where("first is not null").groupBy("first", "second").agg(F.count("*").alias("n"))


def key_ids(trace: DataFrame) -> DataFrame:
    """Keys numbered in key order."""
    return ranked(trace.groupBy("key").agg(F.count("*").alias("n")), "key", "key_id")


def top_keys(trace: DataFrame, k: int) -> DataFrame:
    """The k keys accessed most, ties by key."""
    return trace.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "key").limit(k)


def reuse_intervals(trace: DataFrame) -> DataFrame:
    """Accesses between two of the same key, by logarithmic interval."""
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("key").orderBy("event_id"))
    return trace.select(gap.alias("gap")).where("gap is not null").groupBy(F.floor(F.log2(F.col("gap").cast("double"))).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def correlation_gap(trace: DataFrame) -> DataFrame:
    """``correlation`` with the average time in seconds between the two accesses."""
    w = Window.partitionBy("key").orderBy("event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    pairs = trace.select(F.lag("type").over(w).alias("first"), F.col("type").alias("second"), (at - F.lag(at).over(w)).alias("gap")).where("first is not null")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n"), (F.sum("gap") / F.count("*") / 1e6).alias("gap_s"))


def prefix_cut(trace: DataFrame, prefix: Column) -> DataFrame:
    """(prefix, keys, accesses): how traffic spreads over key prefixes."""
    per = trace.groupBy(prefix.alias("prefix"), "key").agg(F.count("*").alias("n"))
    return per.groupBy("prefix").agg(F.count("*").alias("keys"), F.sum("n").alias("accesses"), F.max("n").alias("hottest"))


def timeline(trace: DataFrame, seconds: int) -> DataFrame:
    """Accesses and distinct keys by time interval."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1000000))
    return trace.groupBy(at.alias("t")).agg(F.count("*").alias("accesses"), F.countDistinct("key").alias("keys"))


def lifetimes(trace: DataFrame) -> DataFrame:
    """(key, accesses, lifetime): from a key's first access to its last, in accesses of the trace."""
    return trace.groupBy("key").agg(F.count("*").alias("accesses"), (F.max("event_id") - F.min("event_id")).alias("lifetime"))


def skewness(trace: DataFrame) -> DataFrame:
    """(accesses, keys, share): keys by how often they are accessed, and their share of the accesses."""
    per = trace.groupBy("key").agg(F.count("*").alias("accesses")).groupBy("accesses").agg(F.count("*").alias("keys"))
    total = F.sum(F.col("accesses") * F.col("keys")).over(Window.partitionBy())  # one row for each number of accesses
    return per.select("accesses", "keys", (F.col("accesses") * F.col("keys") / total).alias("share"))


def prefix_rates(trace: DataFrame, prefix: Column, seconds: int) -> DataFrame:
    """``rates`` by key prefix."""
    return rates(trace.withColumn("type", prefix), seconds)


def schedule(trace: DataFrame, speed: float = 1.0) -> DataFrame:
    """The trace with ``due_us``: when a replay that runs ``speed`` times as fast issues each access."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    begin = trace.agg(F.min(at)).first()[0]
    return trace.withColumn("due_us", F.floor((at - F.lit(begin)) / speed).cast("long"))


def replay(trace: DataFrame, write: Column, value: Column) -> DataFrame:
    """(event_id, key, found): what each read meets: the newest value written before it, or null."""
    w = Window.partitionBy("key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    met = F.last(F.when(write, value), ignorenulls=True).over(w)
    return trace.withColumn("__write", write).withColumn("found", met).where(~F.col("__write")).select("event_id", "key", "found")


def accessed_share(trace: DataFrame, state: DataFrame, prefix: Column) -> DataFrame:
    """(prefix, keys, accessed, share): how many of the keys that exist a trace touches, by prefix."""
    touched = trace.select("key").distinct().withColumn("__met", F.lit(1))
    rows = state.select("key").join(touched, "key", "left").groupBy(prefix.alias("prefix")).agg(F.count("*").alias("keys"), F.count("__met").alias("accessed"))
    return rows.withColumn("share", F.col("accessed") / F.col("keys"))


def locality(trace: DataFrame, block: Column) -> DataFrame:
    """(accesses, blocks, keys): blocks of neighbouring keys by how often they are met, and the keys met in them."""
    per = trace.groupBy(block.alias("block"), "key").agg(F.count("*").alias("n")).groupBy("block").agg(F.sum("n").alias("accesses"), F.count("*").alias("met"))
    return per.groupBy("accesses").agg(F.count("*").alias("blocks"), F.sum("met").alias("keys"))


def key_statistics(trace: DataFrame) -> DataFrame:
    """(type, keys, accesses, key_size) with the mean length of the keys as text, weighed by access."""
    return trace.groupBy("type").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("accesses"), F.avg(F.length(F.col("key").cast("string"))).alias("key_size"))
