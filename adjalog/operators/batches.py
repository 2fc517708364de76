"""Batches, transactions and row-rewriting filters over operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running

#: What an entry of a batch can be besides a write.
SET, ROLLBACK, POP = "set", "rollback", "pop"


def committed(log: DataFrame, markers: DataFrame) -> DataFrame:
    """The rows of prepared batches (xid, seq, ...) that a replay makes visible.

    markers: (xid, mark, mark_seq), mark 'commit' or 'rollback'; the first of a batch counts.
    A batch without marker stays prepared and invisible; rows without xid were written
    directly. Rows take the sequence number at which they became visible as ``seq`` and keep
    their order within the batch in ``step``.
    """
    first = markers.groupBy("xid").agg(F.min_by("mark", "mark_seq").alias("mark"), F.min("mark_seq").alias("mark_seq"))
    rows = log.join(first.where("mark = 'commit'"), "xid", "left").where("xid is null or mark_seq is not null")
    return rows.withColumn("step", F.col("seq")).withColumn("seq", F.coalesce("mark_seq", "seq")).drop("mark", "mark_seq")


def after_savepoints(entries: DataFrame, batch: str, order: str, kind: str) -> DataFrame:
    """The writes of each batch that no rollback to a savepoint took away.

    Savepoints nest: a rollback or pop closes the newest open one, and neither does anything
    if none is open. A write inside k open savepoints gets a row for each of them, and goes
    if one is closed by a rollback, so no batch is walked entry by entry.
    """
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(kind) == SET, 1).when(F.col(kind).isin(ROLLBACK, POP), -1).otherwise(0)
    rows = entries.withColumn("__sum", F.sum(step).over(w))
    rows = rows.withColumn("__depth", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w)))
    before = F.lag("__depth", 1, 0).over(Window.partitionBy(batch).orderBy(order))
    rows = rows.withColumn("__closes", F.when(F.col(kind).isin(ROLLBACK, POP) & (before > F.col("__depth")), before))
    writes = ~F.col(kind).isin(SET, ROLLBACK, POP)
    levels = F.when(writes & (F.col("__depth") > 0), F.sequence(F.lit(1), F.col("__depth").cast("int")))
    inside = rows.where(writes).select(batch, order, F.explode(levels).alias("__level"), F.lit(None).cast("string").alias("__end"))
    ends = rows.where("__closes is not null").select(batch, order, F.col("__closes").cast("int").alias("__level"), F.col(kind).alias("__end"))
    ahead = Window.partitionBy(batch, "__level").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    gone = inside.union(ends).withColumn("__first", F.first("__end", ignorenulls=True).over(ahead)).where((F.col("__first") == ROLLBACK) & F.col("__end").isNull())
    return entries.where(writes).join(gone.select(batch, order).distinct(), [batch, order], "left_anti")


def single_deletes(log: DataFrame) -> DataFrame:
    """Entries left when each single delete (op 3) cancels the put just before it.

    A put followed by a single delete goes, and so does the delete. A single delete after
    anything else has no defined effect; here it hides what is older, as a delete does.
    """
    w = Window.partitionBy("key").orderBy("seq")
    rows = log.withColumn("__next", F.lead("op").over(w)).withColumn("__before", F.lag("op").over(w))
    met = ((F.col("op") == 1) & F.coalesce(F.col("__next") == 3, F.lit(False))) | ((F.col("op") == 3) & F.coalesce(F.col("__before") == 1, F.lit(False)))
    return rows.where(~met).drop("__next", "__before")


def skip_until(rows: DataFrame, run: str, key: str, until: Column) -> DataFrame:
    """A compaction of sorted runs whose filter may remove a row and skip on to a key.

    ``until`` is null for rows to keep; else the row goes, with all rows of its run before
    that key, and rows so skipped are not asked themselves. A bound not past the row's key
    keeps it. Asking rows whose ranges overlap form islands, found by a running maximum; only
    within an island does it matter which of them are asked, and a fold in order decides it.
    """
    asked = rows.select(run, key, until.alias("__until")).where(F.col("__until") > F.col(key))
    w = Window.partitionBy(run).orderBy(key)
    top = F.max("__until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    asked = asked.withColumn("__new", F.when(top.isNull() | (top <= F.col(key)), 1).otherwise(0))
    asked = asked.withColumn("__island", F.sum("__new").over(w))
    spans = asked.groupBy(run, "__island").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("a"), F.col("__until").alias("b")))).alias("s"))
    kept = F.aggregate("s", F.slice("s", 1, 1), lambda out, x: F.when(x["a"] >= F.element_at(out, -1)["b"], F.concat(out, F.array(x))).otherwise(out))
    spans = spans.select(run, F.explode(kept).alias("x")).select(run, F.col("x.a").alias("__a"), F.col("x.b").alias("__b"))
    # Spans that were asked are disjoint, so the last one begun decides for every row.
    marks = spans.select(run, F.col("__a").alias(key), F.col("__b").alias("__end"), F.lit(0).alias("__row"))
    both = rows.withColumn("__end", F.lit(None).cast(dict(spans.dtypes)["__b"])).withColumn("__row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    last = F.last("__end", ignorenulls=True).over(Window.partitionBy(run).orderBy(key, "__row").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__end", last).where((F.col("__row") == 1) & (F.col("__end").isNull() | (F.col(key) >= F.col("__end")))).drop("__end", "__row")


def remove_empty(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a value that is not empty."""
    return rows.where(F.length(value) > 0)


def clip(rows: DataFrame, lo, hi, key: str = "key") -> DataFrame:
    """Only the keys in [lo, hi) stay."""
    return rows.where((F.col(key) >= F.lit(lo)) & (F.col(key) < F.lit(hi)))


def fifo_drop(files: DataFrame, most: int, order: str = "created", size: str = "size") -> DataFrame:
    """The newest files whose sizes together do not pass ``most``; the oldest go first.

    ``files`` is a table of files, one row each; ``order`` numbers them uniquely.
    """
    rows = running(files.withColumn("__new", -F.col(order)), "__new", size, "__before")
    return rows.where(F.col("__before") + F.col(size) <= most).drop("__new", "__before")
