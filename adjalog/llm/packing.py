"""Operator 6: bulk-synchronous best-fit packing of tokenised documents.

Pieces are range-sorted by length. Pieces of one length are interchangeable, and so are open
sequences with the same gap, so a sweep works on runs of them: at most ``capacity`` lengths
and the gap runs, a bound that the data cannot move. Each sweep matches a run of pieces to
its successor, the smallest gap that holds it; where pieces compete for gaps the lower rank
wins; gaps shrink and the sweep repeats until the length is placed, opening sequences only
where no gap is left. The placements apply to all pieces at once through their ranks.
"""

from __future__ import annotations

import base64
import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean_batches, table

CAPACITY, END_ID = 1024, 2
#: A text with this string is left to the tokenizer library, where it is one special token.
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of a byte-level BPE vocabulary.

    The rank file holds the vocabulary of the tokenizer file; encoding from ranks gives the
    same ids several times as fast. Special strings take the tokenizer library itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        self.file, self.slow, self.fast = tokenizer, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and SPECIAL not in text:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*files) -> Encoder:
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]


def public_files(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Tokenizer file, rank file and pattern of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, files: tuple | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every row's ids and the end id, cut at capacity.

    A null text counts as empty. Only longer rows are cut; the first piece takes what is
    left over, so all others are full. ``files`` are found on each executor if not given.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        encode = _encoder(*(files or public_files()))
        for b in batches:
            out = []
            for i, t in enumerate(b.column(1)):
                ids = np.append(encode(t.as_py()), np.uint32(end_id)).astype("<u4")
                a, k = 0, 0
                while a < len(ids):
                    n = (len(ids) - a) % capacity or capacity
                    out.append((i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())))
                    a, k = a + n, k + 1
            cols = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], names=["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(lean_batches(run), f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan_best_fit(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its placements (first rank, pieces a sequence, first sequence, offset).

    A placement lays pieces by rank over consecutive sequences, so many in each, and ends
    where the next one begins. The result is that of best-fit decreasing on single pieces.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    gaps: list[int] = []  # with runs, sorted
    opened = 0
    plan: dict[int, list[tuple[int, int, int, int]]] = {}

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left, places = 0, counts[length], []
        while left:
            at = bisect.bisect_left(gaps, length)  # the successor
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            part = left - full * each if full < n else 0
            used = full + (1 if part else 0)
            places.append((rank, each, first, capacity - gap))
            put(gap - each * length, first, full)
            if part:
                put(gap - part * length, first + full, 1)
            put(gap, first + used, n - used)
            rank += full * each + part
            left -= full * each + part
        plan[length] = places
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, files: tuple | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, packed best-fit.

    The driver holds one count for each length in each range partition: at most
    ``capacity`` plus the number of partitions. Repeated rows are packed as often as they
    come; ties order by id and piece; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = pieces(docs, id_col, text_col, capacity, end_id, files)
    raw = scratch.keep(cut, "cut")
    ranged = raw.repartitionByRange(F.col("length").desc(), F.col("id"), F.col("piece")).sortWithinPartitions(F.col("length").desc(), "id", "piece")
    ranged = scratch.keep(ranged.withColumn("place", F.monotonically_increasing_id()), "ranged")
    scratch.drop("cut")
    stats = ranged.groupBy((F.col("place").bitwiseAND(F.lit(~((1 << 33) - 1)))).alias("part"), "length").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()
    counts: dict[int, int] = {}
    starts: dict[int, list[tuple[int, int]]] = {}  # length: (first place, its rank)
    for part, length, n, first in sorted(map(tuple, stats)):
        starts.setdefault(length, []).append((first, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    plan = plan_best_fit(counts, capacity)
    where = {k: (np.array(starts[k], np.int64).T, np.array(plan[k], np.int64).T) for k in counts}

    def run(batches):
        for b in batches:
            length, place = (b.column(c).to_numpy() for c in ("length", "place"))
            seq, off = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                (first, rank0), (ranks, each, s0, o0) = where[int(k)]
                p = np.searchsorted(first, place[at], "right") - 1
                rank = place[at] - first[p] + rank0[p]
                q = np.searchsorted(ranks, rank, "right") - 1
                seq[at] = s0[q] + (rank - ranks[q]) // each[q]
                off[at] = o0[q] + (rank - ranks[q]) % each[q] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = ranged.schema["id"].dataType.simpleString()
    return ranged.mapInArrow(lean_batches(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")
