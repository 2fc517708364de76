"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, m): each node's least neighbour, written so that joins with it are plain ones."""
    return scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, scratch, name).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, scratch, name)
    up = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return up.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node reachable.

    Each round takes the least neighbour of every node by partial aggregates, so a hub is
    combined on the map side, and joins it back. Both sides of those joins come from written
    tables, without an aggregate above the exchange: a small side is broadcast, and of two
    large ones adaptive execution splits the partition of a hub. Rounds grow with the
    logarithm of a component's size. An empty table gives no rows.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        large = scratch.keep(_large_star(now, scratch, f"{name}{k}-a"), f"{name}{k}-large")
        after = scratch.keep(_small_star(large, scratch, f"{name}{k}-b"), f"{name}{k}")
        for old in (f"{name}{k}-a", f"{name}{k}-b", f"{name}{k}-large", f"{name}{k - 1}"):
            scratch.drop(old)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
