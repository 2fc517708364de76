"""Versioned key-value operators over logs (key, seq, op, value[, ts])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import merge_fold
from .ordered import at_or_before, running


def get_latest(log: DataFrame, fold: Column | None = None) -> DataFrame:
    """(key, value) of each key, deletes absent; merge operands are folded.

    ``fold`` is the table's merge operator (see merges); without one the newest operand
    stands for the value, as a put does.
    """
    if fold is not None:
        return merge_fold(log, ["key"], fold)
    s = F.max_by(F.struct("op", "value"), "seq")
    return log.groupBy("key").agg(s.alias("s")).where("s.op <> 0").select("key", "s.value")


def multi_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Every asked key, repeats kept, with its value and whether it was found."""
    return keys.join(state.withColumn("found", F.lit(True)), "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def as_of(log: DataFrame, reads: DataFrame) -> DataFrame:
    """(key, ts, value): the newest value at or before each read (key, ts).

    Reads and versions are unioned and walked by one window, so no pair of them is formed.
    """
    both = log.select("key", "ts", "value", "seq", F.lit(0).alias("read")).union(reads.select("key", "ts", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1)))
    w = Window.partitionBy("key").orderBy("ts", "read", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("read = 1").select("key", "ts", "value")


def history(log: DataFrame) -> DataFrame:
    """Every version with its rank in its key, newest first."""
    return log.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc())))


def scan(state: DataFrame, lo=None, hi=None, prefix: str | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Ordered scan; lo is included, hi is not; ``limit`` is top-n, not a sort."""
    if lo is not None:
        state = state.where(F.col("key") >= F.lit(lo))
    if hi is not None:
        state = state.where(F.col("key") < F.lit(hi))
    if prefix is not None:
        state = state.where(F.col("key").startswith(prefix))
    state = state.orderBy(F.col("key").desc() if reverse else F.col("key").asc())
    return state if limit is None else state.limit(limit)


def fixed_prefix(key: Column, n: int) -> Column:
    """Null for keys shorter than n."""
    return F.when(F.length(key) >= n, F.substring(key, 1, n))


def capped_prefix(key: Column, n: int) -> Column:
    """F02b"""
    return F.substring(key, 1, n)


def noop_prefix(key: Column) -> Column:
    """The whole key is its prefix."""
    return key


def merge_operands(log: DataFrame) -> DataFrame:
    """Unmerged operands after the newest base, oldest first, as text."""
    base = log.where("op <> 2").groupBy("key").agg(F.max("seq").alias("base"))
    rows = log.where("op = 2").join(base, "key", "left").where("base is null or seq > base")
    return rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"].cast("string")), ",").alias("operands"), F.count("*").alias("n"))


def limited_operands(log: DataFrame, most: int) -> DataFrame:
    """``merge_operands``, null and incomplete for a key that has more than ``most``."""
    found = merge_operands(log)
    return found.select("key", F.when(F.col("n") <= most, F.col("operands")).alias("operands"), "n", (F.col("n") > most).alias("incomplete"))


def soft_limit(rows: DataFrame, by: str, size: str, most: int) -> DataFrame:
    """Rows in the order of a unique number until their sizes exceed the limit; the rest is flagged aborted."""
    return running(rows, by, size, "__before").withColumn("aborted", F.col("__before") > most).drop("__before")


def may_exist(state: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, may): false only for keys that are not there; the exact answer is one."""
    return multi_get(state, keys).select("key", F.col("found").alias("may"))


def seek_for_prev(state: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, at): the greatest key up to each number asked, or null."""
    known = state.select("key").distinct().withColumn("at", F.col("key"))
    return keys.join(at_or_before(keys, known, "key", "at"), "key")


def seek(state: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, at): the least key of at least each number asked, or null."""
    back = seek_for_prev(state.select((-F.col("key")).alias("key")), keys.select((-F.col("key")).alias("key")))
    return back.select((-F.col("key")).alias("key"), (-F.col("at")).alias("at"))


def coalescing(*frames: DataFrame) -> DataFrame:
    """One ordered view of several column families (key, value); the first that has a key gives its value."""
    rows = [f.select("key", "value", F.lit(k).alias("cf")) for k, f in enumerate(frames)]
    both = rows[0]
    for r in rows[1:]:
        both = both.union(r)
    return both.groupBy("key").agg(F.min_by("value", "cf").alias("value"), F.min("cf").alias("cf"))


def ttl_read(rows: DataFrame) -> DataFrame:
    """W-side of C03: (key, value) of rows that carry a write time; expired rows are read until compacted."""
    return rows.where("ts is not null").groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def checksums(rows: DataFrame, by: Column, value: Column) -> DataFrame:
    """Rows and an order-independent checksum of each part of a table."""
    return rows.groupBy(by.alias("part")).agg(F.count("*").alias("n"), F.bit_xor(F.crc32(value.cast("string").cast("binary"))).alias("checksum"))


def overlay(base: DataFrame, batch: DataFrame) -> DataFrame:
    """(key, value) of a batch (key, op, value) over a state; deletes hide."""
    both = base.alias("b").join(batch.alias("d"), "key", "full_outer")
    return both.where("d.op is null or d.op = 1").select("key", F.when(F.col("d.op").isNotNull(), F.col("d.value")).otherwise(F.col("b.value")).alias("value"))


def ingest(state: DataFrame, files: DataFrame, behind: bool = False) -> DataFrame:
    """(key, value) after ingest; new rows win, or lose if ingested behind."""
    rows = state.select("key", "value", F.lit(1).alias("age")).union(files.select("key", "value", F.lit(0 if behind else 2)))
    return rows.groupBy("key").agg(F.max_by("value", "age").alias("value"))


def attribute_groups(**frames: DataFrame) -> DataFrame:
    """Entities of several column families on one key."""
    out = None
    for name, df in frames.items():
        part = df.select("key", F.col("value").alias(name))
        out = part if out is None else out.join(part, "key", "full_outer")
    return out


def conflicts(tracked: DataFrame, log: DataFrame) -> DataFrame:
    """Tracked keys (key, seq) written after their snapshot."""
    newest = log.groupBy("key").agg(F.max("seq").alias("newest"))
    return tracked.join(newest, "key").where("newest > seq").select("key")


def ttl_compact(rows: DataFrame, ttl_s: int, now: str) -> DataFrame:
    """Rows whose write time plus ttl is not before now; a ttl of zero or less keeps all."""
    return rows if ttl_s <= 0 else rows.where(F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_s)) >= F.lit(now).cast("timestamp_ntz" if dict(rows.dtypes)["ts"] == "timestamp_ntz" else "timestamp"))


def expire_each(rows: DataFrame, now: Column) -> DataFrame:
    """Rows whose own ``expires`` is after now; a null never expires."""
    return rows.where(F.col("expires").isNull() | (F.col("expires") > now))


def deletion_windows(log: DataFrame, n: int, most: int) -> DataFrame:
    """Whether ``most`` deletes or more fall into some n consecutive entries, by key order."""
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(-(n - 1), 0)
    return log.withColumn("deletes", F.sum(F.when(F.col("op") == 0, 1).otherwise(0)).over(w)).groupBy("part").agg((F.max("deletes") >= most).alias("triggered"), F.max("deletes").alias("most"))


def stop_at(records: DataFrame, stop: Column, ignore: Column, corrupted: Column | None = None) -> DataFrame:
    """A log's records before the first that says stop, without those to ignore.

    A corrupted record before the stop is an error.
    """
    bad = F.lit(None).cast("long") if corrupted is None else F.min(F.when(corrupted, F.col("seq")))
    first = records.agg(F.min(F.when(stop, F.col("seq"))).alias("stop"), bad.alias("bad"))
    wrong = F.raise_error(F.concat(F.lit("corrupted record: "), F.col("bad").cast("string"))).cast("long")
    first = first.select(F.when((F.col("bad") < F.col("stop")) | (F.col("stop").isNull() & F.col("bad").isNotNull()), wrong).otherwise(F.col("stop")).alias("stop"))
    return records.join(F.broadcast(first), (F.col("stop").isNull()) | (F.col("seq") < F.col("stop")), "left_semi").where(~ignore)


def without_log_data(log: DataFrame, marker: int = 9) -> DataFrame:
    """A log without the entries that only annotate it, which no read sees."""
    return log.where(F.col("op") != marker)


def updates_since(log: DataFrame, seq: int) -> DataFrame:
    """The change feed from a sequence number on."""
    return log.where(F.col("seq") >= seq)
