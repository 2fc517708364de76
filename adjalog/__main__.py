"""Text commands over a Parquet table of operations (key, seq, op, value); K25.

``python -m adjalog scan PATH --from a --to b --max-keys 10``; keys and values are text.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import kv

SCHEMA = "key string, seq long, op int, value string"
DELIMITER = " ==> "


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add rows (key, op, value) after the newest sequence number; they share the next one."""
    try:
        newest = read_log(spark, path).agg(F.max("seq")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        newest = 0
    out = rows.select("key", F.lit(newest + 1).cast("long").alias("seq"), F.col("op").cast("int").alias("op"), "value")
    out.write.mode("append").parquet(path)


def live(spark: SparkSession, path: str, lo: str | None = None, hi: str | None = None, limit: int | None = None) -> DataFrame:
    """The newest values in key order; the bounds reach the scan of the files."""
    log = read_log(spark, path)
    if lo is not None:
        log = log.where(F.col("key") >= lo)
    if hi is not None:
        log = log.where(F.col("key") < hi)
    return kv.scan(kv.get_latest(log), limit=limit)


def dump(spark: SparkSession, path: str, to: str, **bounds) -> None:
    """Write ``key ==> value`` lines, in key order over the files."""
    live(spark, path, **bounds).select(F.concat("key", F.lit(DELIMITER), "value").alias("value")).write.mode("errorifexists").text(to)


def load(spark: SparkSession, path: str, source: str) -> None:
    """Put the lines that ``dump`` writes; a line without delimiter is an error.

    Of lines with the same key the greatest value counts, as they share a sequence number.
    """
    lines = spark.read.text(source)
    at = F.instr("value", DELIMITER)
    good = F.when(at > 0, F.expr(f"substring(value, 1, instr(value, '{DELIMITER}') - 1)")).otherwise(F.raise_error(F.concat(F.lit("no delimiter: "), "value")))
    rest = F.expr(f"substring(value, instr(value, '{DELIMITER}') + {len(DELIMITER)})")
    append(spark, path, lines.select(good.alias("key"), rest.alias("text")).groupBy("key").agg(F.max("text").alias("value")).withColumn("op", F.lit(1)))


def delete_range(spark: SparkSession, path: str, lo: str, hi: str) -> None:
    """Delete the keys in [lo, hi) that live now; a range that ends before it begins is an error."""
    if hi < lo:
        raise ValueError("the range ends before it begins")
    append(spark, path, live(spark, path, lo, hi).select("key", F.lit(0).alias("op"), F.lit(None).cast("string").alias("value")))


#: Commands and how many arguments follow the path; None: one or more.
COMMANDS = {"get": 1, "multi_get": None, "put": 2, "batchput": None, "delete": 1, "deleterange": 2, "scan": 0, "count": 0, "dump": 1, "load": 1, "approxsize": 0, "checkconsistency": 0}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run one command; prints and returns its lines."""
    parser = argparse.ArgumentParser(prog="adjalog")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("path")
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--from", dest="lo")
    parser.add_argument("--to", dest="hi")
    parser.add_argument("--max-keys", dest="limit", type=int)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("adjalog").getOrCreate()
    bounds = {"lo": a.lo, "hi": a.hi, "limit": a.limit}
    want, have = COMMANDS[a.command], len(a.rest)
    if (want is None and not have) or (want is not None and have != want) or (a.command == "batchput" and have % 2):
        parser.error(f"wrong number of arguments for {a.command}")
    out = []
    if a.command == "get":
        found = kv.get_latest(read_log(spark, a.path).where(F.col("key") == a.rest[0])).first()
        out = [found.value if found else "NotFound"]
    elif a.command == "multi_get":
        asked = spark.createDataFrame([(k,) for k in a.rest], "key string")
        found = {r.key: r.value for r in kv.multi_get(kv.get_latest(read_log(spark, a.path).where(F.col("key").isin(a.rest))), asked).where("found").collect()}
        out = [f"{k}{DELIMITER}{found[k]}" if k in found else f"{k}{DELIMITER}NotFound" for k in a.rest]
    elif a.command in ("put", "batchput"):
        pairs = dict(zip(a.rest[::2], a.rest[1::2]))  # the last value of a key counts
        append(spark, a.path, spark.createDataFrame([(k, 1, v) for k, v in pairs.items()], "key string, op int, value string"))
        out = ["OK"]
    elif a.command == "delete":
        append(spark, a.path, spark.createDataFrame([(a.rest[0], 0, None)], "key string, op int, value string"))
        out = ["OK"]
    elif a.command == "deleterange":
        delete_range(spark, a.path, *a.rest)
        out = ["OK"]
    elif a.command == "approxsize":
        size = F.sum(F.length("key") + F.length("value"))
        out = [str(live(spark, a.path, a.lo, a.hi).agg(size).first()[0] or 0)]
    elif a.command == "checkconsistency":
        wrong = read_log(spark, a.path).where("key is null or seq is null or op is null or op not in (0, 1, 2) or (op <> 0 and value is null)").count()
        out = ["OK" if not wrong else f"Corruption: {wrong} rows"]
    elif a.command == "scan":
        out = [f"{r.key}{DELIMITER}{r.value}" for r in live(spark, a.path, **bounds).toLocalIterator()]
    elif a.command == "count":
        out = [str(live(spark, a.path, **bounds).count())]
    elif a.command == "dump":
        dump(spark, a.path, a.rest[0], **bounds)
    else:
        load(spark, a.path, a.rest[0])
    for line in out:
        print(line)
    return out


if __name__ == "__main__":
    main()
