"""Merge operators as aggregate functions over operands in sequence order (§2.8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uint64_add(value: str = "value") -> Column:
    """A sum modulo 2**64, as a decimal; see codecs.uint64_or_zero for operands as bytes."""
    return F.sum(F.col(value).cast("decimal(20,0)")) % F.expr("18446744073709551616BD")


def max_bytes(value: str = "value") -> Column:
    """The greatest operand, byte by byte."""
    return F.max(F.col(value).cast("string"))


def put(value: str = "value", seq: str = "seq") -> Column:
    """The last operand."""
    return F.max_by(value, seq)


def ordered(value: str, seq: str = "seq") -> Column:
    """Operands oldest first; nulls left out."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))), lambda x: x["v"].isNotNull())
    return F.transform(kept, lambda x: x["v"])


def string_append(value: str = "value", delimiter: str = ",", seq: str = "seq") -> Column:
    """Operands joined in order; empty ones keep their delimiter."""
    return F.array_join(ordered(value, seq), delimiter)


def sort_list(value: str = "value") -> Column:
    """Integers of comma-separated lists, sorted, repeats kept."""
    numbers = F.flatten(F.collect_list(F.transform(F.split(F.col(value).cast("string"), ","), lambda x: x.cast("long"))))
    return F.array_join(F.transform(F.array_sort(numbers), lambda x: x.cast("string")), ",")


def xor64(value: str = "value") -> Column:
    """Xor of eight-byte values."""
    return F.bit_xor(value)


def last_three(value: str = "value", seq: str = "seq") -> Column:
    """The newest three, newest first."""
    return F.array_join(F.transform(F.slice(F.reverse(ordered(value, seq)), 1, 3), lambda x: x.cast("string")), ",")
