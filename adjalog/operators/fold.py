"""The heart: resolving an ordered operation log into its current or past state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import at_or_before, ranked

PUT, DELETE, MERGE = 1, 0, 2


def last_write_wins(log: DataFrame, keys: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """The live keys of an add/delete log; the greatest ``seq`` of a key decides.

    ``max_by`` over an integer op keeps a hash aggregate with map-side partial results.
    """
    return log.groupBy(*keys).agg(F.max_by(op, seq).alias("__op")).where("__op = 1").drop("__op")


def latest(log: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """The newest value of each key."""
    return log.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def visible(log: DataFrame, upto_seq: int | None = None, upto_ts=None, from_ts=None) -> DataFrame:
    """The versions that a snapshot or timestamp read sees."""
    for c, v, keep in (("seq", upto_seq, "le"), ("ts", upto_ts, "le"), ("ts", from_ts, "ge")):
        if v is not None:
            log = log.where(F.col(c) <= F.lit(v) if keep == "le" else F.col(c) >= F.lit(v))
    return log


def range_fragments(dels: DataFrame) -> DataFrame:
    """(a, dseq): where the newest covering tombstone changes; dseq is -1 where none covers.

    The bounds of the tombstones [lo, hi) are numbered in order. A tombstone covers a run of
    numbers, cut into aligned blocks of powers of two, two of each size at most; a bound looks
    up its own block of each size. So both sides meet in an equality join, and rows grow with
    the logarithm of the tombstones, not with the width of their ranges.
    """
    points = dels.select(F.col("lo").alias("a")).union(dels.select("hi")).distinct()
    points = ranked(points, "a", "i")
    runs = dels.join(points.select(F.col("a").alias("lo"), F.col("i").alias("x")), "lo").join(points.select(F.col("a").alias("hi"), F.col("i").alias("y")), "hi")
    levels = F.sequence(F.lit(0), F.lit(62))
    # from the left a block starts at the lowest set bit, from the right at that of the end
    up = F.expr("filter(transform(sequence(0, 62), k -> named_struct('k', k, 'x', shiftright(x + shiftleft(1L, k) - 1, k), 'y', shiftright(y, k))), s -> s.x < s.y)")
    blocks = runs.select("seq", F.explode(up).alias("s")).select("seq", "s.k", "s.x", "s.y")
    ends = F.filter(F.array(F.when(F.col("x") % 2 == 1, F.col("x")), F.when(F.col("y") % 2 == 1, F.col("y") - 1)), lambda b: b.isNotNull())
    blocks = blocks.select("seq", "k", F.explode(ends).alias("block")).groupBy("k", "block").agg(F.max("seq").alias("dseq"))
    most = blocks.agg(F.max("k")).first()[0] or 0
    asked = points.select("a", "i", F.explode(F.slice(levels, 1, most + 1)).alias("k")).withColumn("block", F.expr("shiftright(i, k)"))
    return asked.join(blocks, ["k", "block"], "left").groupBy("a").agg(F.coalesce(F.max("dseq"), F.lit(-1)).alias("dseq"))


def apply_range_deletes(log: DataFrame, dels: DataFrame, upto_seq: int | None = None) -> DataFrame:
    """Rows not hidden by a newer range tombstone [lo, hi) over a long key.

    The distinct keys of the log look up the last fragment at or before them; their answer
    joins back by key. Of a snapshot neither rows nor tombstones after ``upto_seq`` count.
    An empty range deletes nothing; one that ends before it begins is an error.
    """
    log, dels = visible(log, upto_seq), visible(dels, upto_seq)
    wrong = F.raise_error(F.concat(F.lit("the range ends before it begins: "), F.col("lo").cast("string"), F.lit(" "), F.col("hi").cast("string")))
    dels = dels.select("seq", F.when(F.col("lo") > F.col("hi"), wrong.cast("long")).otherwise(F.col("lo")).cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).where("lo <> hi")
    newest = at_or_before(log.select("key"), range_fragments(dels).withColumnRenamed("a", "key"), "key", "dseq")
    return log.join(newest, "key", "left").where("dseq is null or dseq <= seq").select(*[log[c] if c != "key" else F.col("key") for c in log.columns])


def merge_fold(log: DataFrame, keys: list[str], fold: Column, seq: str = "seq", with_base: bool = True) -> DataFrame:
    """§2.8: fold puts and merge operands that follow the newest put or delete of a key.

    ``fold`` aggregates over columns ``value`` (null for a delete) and ``seq``; a key whose
    last base is a delete without later operands is absent. Without ``with_base`` operands
    are folded alone, and a put counts only where no operand follows it. The newest base of a
    key comes from a partial aggregate, joined back, not from a window over the log.
    """
    base = log.where(F.col("op") != MERGE).groupBy(*keys).agg(F.max(seq).alias("__base"))
    rows = log.join(base, keys, "left").where(F.col("__base").isNull() | (F.col(seq) >= F.col("__base")))
    counts = F.col("op") != DELETE if with_base else F.col("op") == MERGE
    rows = rows.withColumn("__put", F.when(F.col("op") == PUT, F.col("value"))).withColumn("value", F.when(counts, F.col("value")))
    found = rows.groupBy(*keys).agg(fold.alias("value"), F.max("op").alias("__op"), F.max("__put").alias("__put")).where("__op > 0")
    if not with_base:
        kind = found.schema["value"].dataType
        found = found.withColumn("value", F.when(F.col("__op") == MERGE, F.col("value")).otherwise(F.col("__put").cast(kind)))
    return found.drop("__op", "__put")


def snapshot_stripes(log: DataFrame, snapshots: list[int], keys: list[str]) -> DataFrame:
    """What compaction keeps: the newest version of a key between two snapshots."""
    stripe = sum((F.when(F.col("seq") > s, 1).otherwise(0) for s in snapshots), F.lit(0))
    w = Window.partitionBy(*keys, "stripe").orderBy(F.col("seq").desc())
    return log.withColumn("stripe", stripe).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
