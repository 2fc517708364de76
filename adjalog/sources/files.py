"""Text edge lists and workloads, sorted files, and versioned snapshots of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_edge_list(spark: SparkSession, path: str, undirected: bool = False) -> DataFrame:
    """Distinct (src, dst) from lines ``from to``; other lines are left out."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.try_element_at(part, F.lit(1)).try_cast("long").alias("src"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("dst"))
    rows = rows.where("src >= 0 and dst >= 0")
    return (rows.union(rows.select("dst", "src")) if undirected else rows).distinct()


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """(seq, verb, src, dst) from lines ``add|delete|get|walk from [to]``, in file order.

    ``seq`` orders the lines of a file by place; files by path.
    """
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.lower(part[0]).alias("verb"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("src"), F.try_element_at(part, F.lit(3)).try_cast("long").alias("dst"))
    return rows.where("verb in ('add', 'delete', 'get', 'walk') and src is not null")


def write_sorted(df: DataFrame, path: str, key: str = "key", files: int | None = None, strict: bool = False) -> None:
    """Files of disjoint key ranges, sorted, so that scans of a range prune files.

    With ``strict`` a key that comes twice is an error, and nothing is written.
    """
    if strict:
        twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").first()
        if twice is not None:
            raise ValueError(f"the key comes twice: {twice[0]}")
    ranged = df.repartitionByRange(key) if files is None else df.repartitionByRange(files, key)
    ranged.sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def save_version(df: DataFrame, root: str, version: int) -> str:
    """A table's state below its root, one folder a version."""
    path = f"{root.rstrip('/')}/version={version:012d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def load_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """A state saved before, read only."""
    return spark.read.parquet(f"{root.rstrip('/')}/version={version:012d}")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions below a root that were written to their end, ascending."""
    system, at = _folder(spark, root.rstrip("/"))
    if not system.exists(at):
        return []
    names = [x.getPath().getName() for x in system.listStatus(at)]
    done = [n for n in names if n.startswith("version=") and system.exists(_folder(spark, f"{root.rstrip('/')}/{n}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix("version=")) for n in done)


def purge_versions(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Delete all versions but the newest ``keep``; returns those deleted."""
    if keep < 0:
        raise ValueError("keep must not be negative")
    known = versions(spark, root)
    gone = known[: len(known) - keep] if keep < len(known) else []
    for v in gone:
        system, at = _folder(spark, f"{root.rstrip('/')}/version={v:012d}")
        system.delete(at, True)
    return gone


def fingerprint(df: DataFrame) -> tuple:
    """Rows and an order-independent checksum of all columns."""
    h = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def verify_version(spark: SparkSession, root: str, version: int, expected: tuple) -> bool:
    """Whether a saved version still reads to the ``fingerprint`` it had."""
    return fingerprint(load_version(spark, root, version)) == tuple(expected)


def import_disjoint(base: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Both tables, or an error if their key ranges overlap."""
    (a, b), (c, d) = (df.agg(F.min(key), F.max(key)).first() for df in (base, new))
    if None not in (a, c) and a <= d and c <= b:
        raise ValueError("the key ranges overlap")
    return base.unionByName(new)


def file_metadata(df: DataFrame) -> DataFrame:
    """Rows and bytes of each file that a table reads."""
    return df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count("*").alias("rows"))


def check_sorted(df: DataFrame, key: str = "key") -> DataFrame:
    """(file, rows, least, most, disorder) of a table's files; disorder counts rows not above the one before.

    A window reads one file in one task, as a scan of it would.
    """
    w = Window.partitionBy("file").orderBy("at")
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(key).alias("k"))
    rows = rows.withColumn("bad", (F.col("k") <= F.lag("k").over(w)).cast("int"))
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("k").alias("least"), F.max("k").alias("most"), F.coalesce(F.sum("bad"), F.lit(0)).alias("disorder"))


def prefix_partitions(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with ``part``, the first n characters of the key: what a partitioner keeps apart."""
    return df.withColumn("part", F.substring(key, 1, n))


def write_partitioned(df: DataFrame, path: str, key: str, n: int) -> None:
    """Sorted files none of which holds two prefixes of n characters; a hot prefix spreads over several."""
    rows = prefix_partitions(df, key, n)
    rows.repartitionByRange("part", key).sortWithinPartitions("part", key).write.mode("errorifexists").partitionBy("part").parquet(path)
