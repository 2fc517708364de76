"""Scalar functions: property lists, node keys, zig-zag numbers, and byte-wise merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

END = "\u0000"


def encode_properties(props: Column) -> Column:
    """An array of (name, value) as text with a NUL after each part."""
    return F.array_join(F.transform(props, lambda p: F.concat(p["name"], F.lit(END), p["value"], F.lit(END))), "")


def decode_properties(text: Column) -> Column:
    """The array back; empty values are legal."""
    parts = F.split(text, END)
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i % 2 == 0) & (i + 1 < F.size(parts))), lambda i: F.struct(F.get(parts, i).alias("name"), F.get(parts, i + 1).alias("value")))


def zigzag(x: Column) -> Column:
    """§2.15: signed to unsigned order: 0, -1, 1, -2, ..."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1))))


def hex_text(x: Column) -> Column:
    """§2.15: a number's digits as printed, upper case, without leading zeros."""
    return F.hex(x)


def varint_length(x: Column) -> Column:
    """§2.15: bytes of a number of seven bits a byte: 1 for 0 to 127, up to 10."""
    return sum((F.when(F.shiftrightunsigned(x, 7 * k) != 0, 1).otherwise(0) for k in range(1, 10)), F.lit(1))


def uint64_or_zero(x: Column) -> Column:
    """An operand of eight little-endian bytes as a number; any other length counts as 0."""
    digits = F.concat(*[F.hex(F.substring(x, k, 1)) for k in range(8, 0, -1)])
    return F.when(F.length(x) == 8, F.conv(digits, 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def timestamp_key(x: Column) -> Column:
    """§2.15: a timestamp suffix: eight little-endian bytes."""
    return node_key(x)


def node_key(x: Column) -> Column:
    """§2.15: eight little-endian bytes."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)]))


@F.pandas_udf(BinaryType())
def bytes_xor(lists: pd.Series) -> pd.Series:
    """Xor of byte strings of any length; the longer tail is kept. Takes ordered arrays."""

    def fold(parts):
        out = b""
        for p in parts if parts is not None else ():
            p = bytes(p)
            n = max(len(out), len(p))
            out = bytes(a ^ b for a, b in zip(out.ljust(n, b"\0"), p.ljust(n, b"\0")))
        return out

    return lists.map(fold)


def merge_columns(rows: DataFrame) -> DataFrame:
    """A10: (key, col, kind, ts, value): each column's newest version above its row's tombstone.

    ``kind`` is 0 for a value, 1 for a column tombstone, 2 for a row tombstone (col null),
    3 for an expiring value. Ties of a timestamp go to the kind and value in order.
    """
    w = Window.partitionBy("key")
    dead = F.max(F.when(F.col("kind") == 2, F.col("ts"))).over(w)
    live = rows.withColumn("dead", dead).where("kind <> 2 and (dead is null or ts > dead)")
    first = Window.partitionBy("key", "col").orderBy(F.col("ts").desc(), "kind", "value")
    return live.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("key", "col", "kind", "ts", "value")


def expire_columns(rows: DataFrame, now: int, purge: bool = False) -> DataFrame:
    """Expiring values whose ``ts + ttl`` is before now become tombstones, or go."""
    old = (F.col("kind") == 3) & (F.col("ts") + F.col("ttl") < now)
    return rows.where(~old) if purge else rows.withColumn("value", F.when(~old, F.col("value"))).withColumn("kind", F.when(old, 1).otherwise(F.col("kind")))


def property_lint(rows: DataFrame) -> DataFrame:
    """Keys whose columns repeat a name."""
    return rows.groupBy("key", "name").count().where("count > 1").select("key").distinct()
