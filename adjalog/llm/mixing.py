"""Operator 5: mix sources to target weights with a hypergeometric splitting tree.

A source is cut into permuted blocks by a hash of the id. Its quota of blocks is exact; a
binary tree over the output shards splits all quotas from the top: each node draws from the
multivariate hypergeometric distribution how many blocks of each source its left half gets.
So shards are alike and disjoint without any shard seeing another's blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

#: Documents of a block, about; and shards of the mix.
BLOCK_DOCS, SHARDS = 256, 64
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``target`` for rows (source, total, ...): weights repeat over sources in order, null last.

    With all targets at rate * weight the largest rate is found for which targets that stop
    at ``most`` times their total still leave the rest to the others: the end of resharing
    the excess. One row a source, in one sort.
    """
    by_name, alone = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.select("*", w.alias("weight")).withColumn("full", F.col("total") * most / F.col("weight"))
    before = alone.rowsBetween(Window.unboundedPreceding, -1)
    after = alone.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("rate", (F.sum("total").over(everything) * share - F.coalesce(F.sum(F.col("total") * most).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("open", F.min(F.when(F.col("rate") <= F.col("full"), F.struct("full", "rate"))).over(everything))
    target = F.least(F.col("total") * most, F.coalesce(F.col("open.rate") * F.col("weight"), F.col("total") * most))
    return t.select(*totals.columns, target.cast("double").alias("target"))


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) that each shard (row) gets; rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        size = [(total * (i + 1)) // (hi - lo) - (total * i) // (hi - lo) for i in range(hi - lo)]
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, sum(size[: mid - lo]), method="marginals")
        down(lo, mid, draw)
        down(mid, hi, have - draw)

    if shards and len(quotas):
        down(0, shards, quotas.astype(np.int64))
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = 7, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, draws). rows: (row, id, source, size, source_size, target, copies), one for each input row.
    draws: (row, shard, place), one for each copy drawn; ``place`` orders a shard's rows.

    A source passes whole as often as its target holds its size; of the last pass it gives
    whole permuted blocks and, of one block, documents in permuted order, up to the point
    nearest to the target. So it misses the target by half a document's size at most, and
    no document is drawn more often than ``most`` rounded up. Sizes are words; a null text
    has none; a null source is a source. Repeated rows and null ids are drawn as rows of
    their own, told apart by their place. An empty table gives two empty ones. Reruns
    agree as long as the input has the same rows, but for rows that are equal.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text_col)).alias("h"), (F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")).alias("row"))
    base = scratch.keep(base, "base")
    totals = base.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("docs"))
    plan = scratch.keep(targets(totals, weights, share, most).withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS)), "plan")
    with_plan = base.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.*", "p.total", "p.target", "p.blocks")
    order = F.xxhash64(F.lit(seed), "id", "h")
    cut = scratch.keep(with_plan.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "h"), F.col("blocks"))), "cut")

    blocks = cut.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("total").alias("total"), F.first("target").alias("target"))
    # The permutation of blocks is their number, drawn by hash. Running sums in two levels, so that no source is one group.
    group = F.floor(F.col("block") / 4096)
    inner = Window.partitionBy("source", group).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.groupBy("source", group.alias("g")).agg(F.sum("words").alias("gw"))
    outer = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "g", F.coalesce(F.sum("gw").over(outer), F.lit(0)).alias("ahead"))
    placed = blocks.withColumn("g", group).withColumn("upto", F.sum("words").over(inner)).alias("x").join(sums.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.g") == F.col("y.g"))).select("x.source", "x.block", "x.words", "x.total", "x.target", (F.col("x.upto") + F.col("y.ahead")).alias("upto"))
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    rest = F.col("target") - whole * F.col("total")
    placed = placed.select("source", "block", "words", whole.cast("int").alias("passes"), rest.alias("rest"), (F.col("upto") - F.col("words")).alias("from"))
    placed = scratch.keep(placed.withColumn("last", F.when(F.col("from") + F.col("words") <= F.col("rest"), "all").when(F.col("from") < F.col("rest"), "some").otherwise("none")), "placed")

    def same(a: str, b: str):
        return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))

    docs_in = cut.alias("c").join(placed.alias("p"), same("c", "p")).select("c.*", "p.passes", "p.rest", "p.from", "p.last")
    edge = docs_in.where("last = 'some'")  # one block of a source
    run = Window.partitionBy("source").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("from") + F.sum("size").over(run)).withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int"))
    keep = ["row", "id", "source", "block", "size", "order", "total", "target", "passes", "more"]
    rest_docs = docs_in.where("last <> 'some'").withColumn("more", (F.col("last") == "all").cast("int"))
    chosen = scratch.keep(edge.select(*keep).union(rest_docs.select(*keep)).withColumn("copies", F.least(F.col("passes") + F.col("more"), F.lit(int(np.ceil(most))))), "chosen")

    # Quotas in block draws: (source, block, pass), in that order within a source.
    drawn = chosen.where("copies > 0").groupBy("source", "block").agg(F.max("copies").alias("times"))
    drawn = drawn.select("source", "block", F.explode(F.sequence(F.lit(1), "times")).alias("pass"))
    quotas = drawn.groupBy("source").agg(F.count("*").alias("n"))

    def tree(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("source", "ascending")], null_placement="at_end"))
        shares = split_tree(t.column("n").to_numpy(), shards, seed)
        ends = np.cumsum(shares, axis=0).T
        return pa.table({"source": t.column("source"), "ends": pa.array([list(map(int, x)) for x in ends], pa.list_(pa.int64()))})

    kind = base.schema["source"].dataType.simpleString()
    # One row a source; the tree needs all quotas of a node together.
    shares = quotas.withColumn("every", F.lit(0)).groupBy("every").applyInArrow(tree, f"source {kind}, ends array<bigint>")
    key = F.xxhash64(F.lit(seed + 2), "block", "pass")
    band = F.pmod(key, F.lit(4096))
    local = Window.partitionBy("source", "band").orderBy("key", "block", "pass")
    ranked = drawn.withColumn("key", key).withColumn("band", band).withColumn("r", F.row_number().over(local))
    bands = drawn.groupBy("source", band.alias("band")).agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.alias("x").join(bands.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.band") == F.col("y.band"))).select("x.source", "x.block", "x.pass", (F.col("x.r") + F.col("y.ahead")).alias("draw"))
    dealt = ranked.alias("x").join(shares.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source"))).select("x.source", "x.block", "x.pass", F.size(F.filter("y.ends", lambda e: e < F.col("x.draw"))).alias("shard"))
    copies = chosen.where("copies > 0").select("row", "source", "block", "order", F.explode(F.sequence(F.lit(1), "copies")).alias("pass"))
    draws = copies.alias("c").join(dealt.alias("d"), same("c", "d") & (F.col("c.pass") == F.col("d.pass"))).select("c.row", "d.shard", F.xxhash64(F.lit(seed + 3), "c.order", "c.pass").alias("place"))
    out = chosen.select("row", "id", "source", "size", F.col("total").alias("source_size"), "target", "copies")
    return out, draws


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, draws = mix_sources(table(spark, sf_dir, "documents"))
    taken = draws.groupBy("row").agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # two at most
    shards = F.coalesce("shards", F.array().cast("array<int>"))
    return rows.join(taken, "row", "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size(shards)).alias("taken"), F.array_join(shards.cast("array<string>"), ",").alias("shards"))
