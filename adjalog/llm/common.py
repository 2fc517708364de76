"""Helpers shared by the operators: tables, scratch storage, word and window hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space; ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1))


#: The folders of all scratch tables of this driver, oldest first.
_BASES_MADE: list[str] = []


class Scratch:
    """Parquet tables below ``spark.checkpoint.dir``, which driver and executors share.

    A written table cuts lineage and survives lost executors. Only where the setting is
    unset (tests in one process) a temporary folder of this machine is taken.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="scratch-")
        self.base = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        _BASES_MADE.append(self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.base}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """Removes at the end all scratch tables begun inside: what needs them must be written by then."""
    before = len(_BASES_MADE)
    try:
        yield
    finally:
        for base in _BASES_MADE[before:]:
            _delete(spark, base)
        del _BASES_MADE[before:]


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the jobs run inside; names with ``__`` for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())

        def run(x: int) -> np.ndarray:
            a = np.full(size, x, np.uint64)
            a[0] = 1
            return np.cumprod(a, dtype=np.uint64)

        have = _POWERS[base] = (run(base), run(pow(base, -1, 1 << 64)))
    return have


def give_back() -> None:
    """Return freed memory to the system.

    Workers live on between tasks, and what they keep counts against their executor.
    """
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def lean_batches(f):
    """A function of batches that gives memory back when its task ends."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def lean_group(f):
    """A function of one group that gives memory back after each."""

    def run(t):
        out = f(t)
        give_back()
        return out

    return run


def lean_pair(f):
    """A function of two cogroups that gives memory back after each."""

    def run(t, notes):
        out = f(t, notes)
        give_back()
        return out

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of several texts: their bytes, bounds, 64-bit hashes and texts.

    ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: list[bytes | None]):
        lines = [b" ".join(t.split()) if t else b"" for t in texts]
        counts = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
        self.buffer = b" ".join(x for x in lines if x)
        self.lines = lines
        self.first = np.concatenate(([0], np.cumsum(counts)))
        raw = np.frombuffer(self.buffer, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        total = int(self.first[-1])
        self.starts = np.concatenate(([0], gaps + 1))[:total]
        self.ends = np.concatenate((gaps, [len(raw)]))[:total]
        power, inverse = _powers(_BASES[0], len(raw) + 1)
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=run[1:])
        lengths = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((run[self.ends] - run[self.starts]) * inverse[self.starts] + lengths * np.uint64(_BASES[1]))

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """Hashes of all runs of k words; ``which`` picks one of two independent hashes.

        Runs that cross from one text into the next are there too: see ``inside``.
        """
        h = self.hashes if which == 0 else mix(self.hashes + np.uint64(0x632BE59BD9B4E019))
        if len(h) < k:
            return np.empty(0, np.uint64)
        power, inverse = _powers(_BASES[which], len(h) + 1)
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], out=run[1:])
        return mix((run[k:] - run[:-k]) * inverse[: len(h) - k + 1])

    def inside(self, k: int) -> np.ndarray:
        """Whether the run of k words from each word on stays in its text."""
        n = max(0, int(self.first[-1]) - k + 1)
        ok = np.zeros(n, bool)
        for a, b in zip(self.first[:-1], self.first[1:]):
            if b - a >= k:
                ok[a : b - k + 1] = True
        return ok


def chunks(texts: list[bytes | None], size: int = 1 << 20):
    """Ranges (i, j) of texts of about ``size`` bytes together, one text at least."""
    i = held = 0
    for j, t in enumerate(texts):
        if held and held + len(t or b"") > size:
            yield i, j
            i, held = j, 0
        held += len(t or b"")
    if i < len(texts):
        yield i, len(texts)
