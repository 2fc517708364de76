"""A graph as one log of operations: what holds after it, and a store that appends to it.

A log has (at, kind, src, dst, name, value); ``at`` orders it and the greatest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``vertex`` adds src if it is not there; ``reset`` adds it with empty lists and no properties.
VERTEX, RESET, EDGE, UNEDGE, VPROP, EPROP = "vertex", "reset", "edge", "unedge", "vprop", "eprop"
COLUMNS = "at long, kind string, src long, dst long, name string, value string"
#: A batch holds up to 2**STEP_BITS operations.
STEP_BITS = 40


def _after_reset(log: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    resets = log.where(F.col("kind") == RESET).groupBy(F.col("src").alias(owner)).agg(F.max("at").alias("__reset"))
    return rows.join(resets, owner, "left").where("__reset is null or at > __reset").drop("__reset")


def vertices(log: DataFrame) -> DataFrame:
    """(id) of the vertices added, each once; edges add none."""
    return log.where(F.col("kind").isin(VERTEX, RESET)).select(F.col("src").alias("id")).distinct()


def edges(log: DataFrame, inward: bool = False) -> DataFrame:
    """(src, dst) in the out lists of their sources, or in the in lists of their targets.

    A reset empties the vertex's own two lists and leaves those of its neighbours.
    """
    last = log.where(F.col("kind").isin(EDGE, UNEDGE)).groupBy("src", "dst").agg(F.max_by(F.col("kind") == EDGE, "at").alias("__on"), F.max("at").alias("at"))
    live = last.where("__on")
    return _after_reset(log, live, "dst" if inward else "src").select("src", "dst")


def vertex_properties(log: DataFrame) -> DataFrame:
    """(id, name, value), the newest of each name."""
    last = log.where(F.col("kind") == VPROP).groupBy("src", "name").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return _after_reset(log, last, "src").select(F.col("src").alias("id"), "name", "value")


def edge_properties(log: DataFrame) -> DataFrame:
    """(src, dst, name, value), the newest of each name."""
    last = log.where(F.col("kind") == EPROP).groupBy("src", "dst", "name").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return _after_reset(log, last, "src").select("src", "dst", "name", "value")


class GraphStore:
    """A graph below a folder; each append is one Parquet batch, reads resolve them all.

    A batch shows only once it is written. A writer that finds its batch begun by another fails;
    two that begin at one moment are not told apart, so writers take turns.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/log"

    def _batches(self) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return 0
        names = [x.getPath().getName() for x in system.listStatus(folder)]
        return max([int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")], default=0)

    def log(self, upto_batch: int | None = None) -> DataFrame:
        """All operations, or those of the batches up to one: the graph as it was then."""
        if not self._batches():
            return self.spark.createDataFrame([], COLUMNS)
        rows = self.spark.read.schema(f"{COLUMNS}, batch long").parquet(self.path)
        return (rows if upto_batch is None else rows.where(F.col("batch") <= upto_batch)).drop("batch")

    def append(self, ops: DataFrame, step: Column | None = None) -> int:
        """Add operations (kind, src and, where the kind has them, dst, name, value); ``step`` orders those of a batch.

        Returns the batch's number. Equal steps on one key leave its result open.
        """
        have = [F.col(c) if c in ops.columns else F.lit(None) for c in ("kind", "src", "dst", "name", "value")]
        batch = self._batches() + 1
        at = F.lit(batch << STEP_BITS) + (F.lit(0) if step is None else step).cast("long")
        types = ("string", "long", "long", "string", "string")
        rows = ops.select(at.alias("at"), *[c.cast(t).alias(n) for c, t, n in zip(have, types, ("kind", "src", "dst", "name", "value"))])
        rows.write.mode("errorifexists").parquet(f"{self.path}/batch={batch:012d}")
        return batch

    def _each(self, kind: str, rows: list[tuple], names: str) -> int:
        return self.append(self.spark.createDataFrame(rows, names).withColumn("kind", F.lit(kind)))

    def add_vertices(self, ids: list[int], strict: bool = False) -> int:
        return self._each(RESET if strict else VERTEX, [(i,) for i in ids], "src long")

    def add_edges(self, pairs: list[tuple[int, int]]) -> int:
        return self._each(EDGE, pairs, "src long, dst long")

    def delete_edges(self, pairs: list[tuple[int, int]]) -> int:
        return self._each(UNEDGE, pairs, "src long, dst long")

    def set_vertex_property(self, vertex: int, name: str, value: str) -> int:
        return self._each(VPROP, [(vertex, name, value)], "src long, name string, value string")

    def set_edge_property(self, src: int, dst: int, name: str, value: str) -> int:
        return self._each(EPROP, [(src, dst, name, value)], "src long, dst long, name string, value string")

    def vertices(self) -> DataFrame:
        return vertices(self.log())

    def edges(self, inward: bool = False) -> DataFrame:
        return edges(self.log(), inward)

    def vertex_properties(self) -> DataFrame:
        return vertex_properties(self.log())

    def edge_properties(self) -> DataFrame:
        return edge_properties(self.log())

    def edge_property(self, src: int, dst: int) -> list[tuple[str, str]]:
        """The properties of one edge by name; none for an edge that has none."""
        return [(r.name, r.value) for r in self.edge_properties().where((F.col("src") == src) & (F.col("dst") == dst)).orderBy("name").collect()]
