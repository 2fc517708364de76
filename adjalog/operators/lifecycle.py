"""Compaction decisions, transaction states, column families, files and checked merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import DELETE, MERGE, PUT, merge_fold

#: What a compaction filter can say of a row besides skipping on (see batches.skip_until).
KEEP, REMOVE, PURGE, CHANGE = "keep", "remove", "purge", "change"
SINGLE_DELETE = 3


def compaction_filter(rows: DataFrame, decision: Column, changed: Column) -> DataFrame:
    """Rows (op, value, ...) after a filter: removed ones become deletes, purged ones single deletes.

    A changed row is a put of the new value. Deletes are not asked; any other decision is an error.
    """
    known = decision.isin(KEEP, REMOVE, PURGE, CHANGE)
    said = F.when(F.col("op") == DELETE, KEEP).when(known, decision).otherwise(F.raise_error(F.concat(F.lit("unknown decision: "), decision)))
    rows = rows.withColumn("__said", said)
    op = F.when(F.col("__said") == REMOVE, DELETE).when(F.col("__said") == PURGE, SINGLE_DELETE).when(F.col("__said") == CHANGE, PUT).otherwise(F.col("op"))
    value = F.when(F.col("__said") == KEEP, F.col("value")).when(F.col("__said") == CHANGE, changed)
    return rows.withColumn("__op", op).withColumn("value", value).withColumn("op", F.col("__op")).drop("__said", "__op")


def transaction_states(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """(xid, writes, state) of each batch: started, prepared, committed or rolledback.

    marks: (xid, mark, mark_seq), mark 'prepare', 'commit' or 'rollback'; the first commit or
    rollback of a batch ends it.
    """
    final = F.when(F.col("mark") != "prepare", F.col("mark_seq"))
    last = marks.groupBy("xid").agg(F.min_by("mark", final).alias("end"))
    writes = entries.groupBy("xid").agg(F.count("*").alias("writes")).join(last.withColumn("marked", F.lit(True)), "xid", "left")
    state = F.when(F.col("end") == "commit", "committed").when(F.col("end") == "rollback", "rolledback").when(F.col("marked"), "prepared").otherwise("started")
    return writes.select("xid", "writes", state.alias("state"))


def overwritten(entries: DataFrame, batch: str) -> DataFrame:
    """What a batch that overwrites keeps: a key's newest put or delete and the operands after it."""
    base = entries.where(F.col("op") != MERGE).groupBy(batch, "key").agg(F.max("seq").alias("__base"))
    return entries.join(base, [batch, "key"], "left").where(F.col("__base").isNull() | (F.col("seq") >= F.col("__base"))).drop("__base")


def column_families(ops: DataFrame) -> DataFrame:
    """(name, created) of the families that exist after (seq, verb, name), verb 'create' or 'drop'.

    Creating one that exists changes nothing; one dropped and created again begins empty.
    """
    dropped = ops.where("verb = 'drop'").groupBy("name").agg(F.max("seq").alias("__gone"))
    made = ops.where("verb = 'create'").join(dropped, "name", "left").where("__gone is null or seq > __gone")
    return made.groupBy("name").agg(F.min("seq").alias("created"))


def table_properties(rows: DataFrame, file: Column) -> DataFrame:
    """(file, entries, deletes, merges, least, most): what a collector notes of each file."""
    return rows.groupBy(file.alias("file")).agg(F.count("*").alias("entries"), F.count_if(F.col("op") == DELETE).alias("deletes"), F.count_if(F.col("op") == MERGE).alias("merges"), F.min("key").alias("least"), F.max("key").alias("most"))


def table_filter(rows: DataFrame, file: Column, wanted: Column) -> DataFrame:
    """The rows of files whose ``table_properties`` satisfy ``wanted``."""
    kept = table_properties(rows, file).where(wanted).select(F.col("file").alias("__file"))
    return rows.withColumn("__file", file).join(kept, "__file", "left_semi").drop("__file")


def drop_files_in_range(rows: DataFrame, file: Column, lo, hi) -> DataFrame:
    """Rows without those of files whose keys all lie in [lo, hi); others keep every row."""
    inside = table_properties(rows, file).where((F.col("least") >= F.lit(lo)) & (F.col("most") < F.lit(hi))).select(F.col("file").alias("__file"))
    return rows.withColumn("__file", file).join(inside, "__file", "left_anti").drop("__file")


def merge_entity(log: DataFrame, fold: Column, others: list[str]) -> DataFrame:
    """(key, value, others): operands merge into the default column, the put's other columns stay."""
    base = log.where(F.col("op") != MERGE).groupBy("key").agg(F.max("seq").alias("__base"))
    rows = log.join(base, "key", "left").where(F.col("__base").isNull() | (F.col("seq") >= F.col("__base")))
    rows = rows.withColumn("value", F.when(F.col("op") != DELETE, F.col("value")))
    kept = [F.max(F.when(F.col("op") == PUT, F.col(c))).alias(c) for c in others]
    return rows.groupBy("key").agg(fold.alias("value"), *kept, F.max("op").alias("__op")).where("__op > 0").drop("__op")


def ttl_merge(log: DataFrame, fold: Column, now: Column) -> DataFrame:
    """(key, value, at): merged without their write times and stamped anew."""
    return merge_fold(log, ["key"], fold).withColumn("at", now)


def merge_checked(log: DataFrame, fold: Column, bad: Column) -> DataFrame:
    """(key, value, error): a read that meets an operand that can't be merged is an error of its key alone.

    Only operands after the newest put or delete are met; others can't fail a read.
    """
    failed = F.max(F.coalesce(F.col("__bad"), F.lit(False)))
    out = merge_entity(log.withColumn("__bad", bad & (F.col("op") == MERGE)), F.struct(fold.alias("value"), failed.alias("error")), [])
    return out.select("key", F.when(~F.col("value.error"), F.col("value.value")).alias("value"), F.col("value.error").alias("error"))
