"""Ranks, running sums and as-of lookups over a whole table without a single task.

Rows go to ordered buckets by the quantiles of a number; windows run within buckets, and one
row a bucket carries over what the buckets before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets, a bound on the rows that are ordered together to carry over.
BUCKETS = 256


def cuts(rows: DataFrame, by: str, buckets: int = BUCKETS) -> list:
    """Quantiles of a numeric column, distinct and ascending; at most ``buckets`` of them."""
    found = rows.agg(F.percentile_approx(by, [k / buckets for k in range(1, buckets)], 4 * buckets)).first()[0]
    return sorted(set(found or []))


def bucket(x: Column, points: list) -> Column:
    """How many of the ascending points are below x, as a balanced tree of conditions."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > F.lit(points[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(points))


def _whole(points: list, rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("__b", bucket(F.col(by), points))


def ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with their place from 0 in the order of a unique number."""
    rows = _whole(cuts(rows, by), rows, by)
    return _carried(rows, Window.partitionBy("__b").orderBy(by), F.lit(1), name)


def running(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over all rows before them in the order of a unique number."""
    rows = _whole(cuts(rows, by), rows, by)
    return _carried(rows, Window.partitionBy("__b").orderBy(by), F.coalesce(F.col(value), F.lit(0)), name)


def _carried(rows: DataFrame, within, value: Column, name: str) -> DataFrame:
    value = value.cast("long")
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    before = rows.groupBy("__b").agg(F.sum(value).alias("__n")).select("__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__past"))
    own = F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)) - value
    return rows.withColumn("__own", own).join(F.broadcast(before), "__b").withColumn(name, F.col("__own") + F.col("__past")).drop("__b", "__own", "__past")


def at_or_before(asked: DataFrame, known: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value) for the distinct numbers asked: that of the last known number up to each, or null.

    ``known`` has distinct numbers and values that are not null.
    """
    points = cuts(known, by)
    both = known.select(by, value, F.lit(0).alias("__ask")).union(asked.select(by, F.lit(None).cast(dict(known.dtypes)[value]), F.lit(1)).distinct())
    both = _whole(points, both, by)
    w = Window.partitionBy("__b").orderBy(by, "__ask").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__here", F.last(value, ignorenulls=True).over(w)).where("__ask = 1")
    last = _whole(points, known, by).groupBy("__b").agg(F.max_by(value, by).alias("__v"))
    every = known.sparkSession.range(len(points) + 1).select(F.col("id").cast("int").alias("__b"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = every.join(last, "__b", "left").select("__b", F.last("__v", ignorenulls=True).over(ahead).alias("__before"))
    return both.join(F.broadcast(before), "__b").select(by, F.coalesce("__here", "__before").alias(value))
