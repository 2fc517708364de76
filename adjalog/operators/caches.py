"""Cache simulation over access traces, and percentiles from bucketed counts."""

from __future__ import annotations

import bisect
import heapq
from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class _Recent:
    """Least recently used, or first in first out if hits do not renew."""

    def __init__(self, capacity: int, renew: bool):
        self.capacity, self.renew, self.held = capacity, renew, OrderedDict()

    def access(self, key, after) -> bool:
        if key in self.held:
            if self.renew:
                self.held.move_to_end(key)
            return True
        self.held[key] = None
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return False


class _Ranked:
    """Evicts the least rank: a key's count (ties: least recent), or the farthest next use."""

    def __init__(self, capacity: int, farthest: bool):
        self.capacity, self.farthest, self.rank, self.heap, self.clock = capacity, farthest, {}, [], 0

    def access(self, key, after) -> bool:
        self.clock += 1
        hit = key in self.rank
        if not hit and len(self.rank) >= self.capacity:
            while True:
                r, k = heapq.heappop(self.heap)
                if self.rank.get(k) == r:
                    del self.rank[k]
                    break
        self.rank[key] = (-after, 0) if self.farthest else (self.rank[key][0] + 1 if hit else 1, self.clock)
        heapq.heappush(self.heap, (self.rank[key], key))
        if len(self.heap) > 4 * self.capacity + 16:  # entries made stale by later ranks
            self.heap = [(r, k) for k, r in self.rank.items()]
            heapq.heapify(self.heap)
        return hit


class _Newest:
    """Evicts the most recently used."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def access(self, key, after) -> bool:
        hit = key in self.held
        if not hit and len(self.held) >= self.capacity:
            self.held.popitem()
        self.held[key] = None
        self.held.move_to_end(key)
        return hit


class _Hyperbolic:
    """Evicts the least accesses for each access of the cache since a key came in; ties: the oldest."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.clock = capacity, {}, 0

    def access(self, key, after) -> bool:
        self.clock += 1
        if key in self.held:
            self.held[key][0] += 1
            return True
        if len(self.held) >= self.capacity:
            del self.held[min(self.held, key=lambda k: (self.held[k][0] / (self.clock - self.held[k][1]), self.held[k][1]))]
        self.held[key] = [1, self.clock]
        return False


class _Adaptive:
    """Adaptive replacement: keys met once and keys met again, each with a list of those evicted.

    A miss that is still on one of these lists moves the share of its side.
    """

    def __init__(self, capacity: int):
        self.capacity, self.share = capacity, 0.0
        self.once, self.again, self.gone_once, self.gone_again = (OrderedDict() for _ in range(4))

    def _evict(self, was_again: bool) -> None:
        n = len(self.once)
        if n and (n > self.share or (was_again and n == self.share) or not self.again):
            self.gone_once[self.once.popitem(last=False)[0]] = None
        else:
            self.gone_again[self.again.popitem(last=False)[0]] = None

    def access(self, key, after) -> bool:
        for side in (self.once, self.again):
            if key in side:
                del side[key]
                self.again[key] = None
                return True
        a, b = len(self.gone_once), len(self.gone_again)
        if key in self.gone_once:
            self.share = min(self.capacity, self.share + max(1, b / a))
            self._evict(False)
            del self.gone_once[key]
            self.again[key] = None
        elif key in self.gone_again:
            self.share = max(0, self.share - max(1, a / b))
            self._evict(True)
            del self.gone_again[key]
            self.again[key] = None
        else:
            held = len(self.once) + len(self.again)
            if len(self.once) + a == self.capacity:
                if a:
                    self.gone_once.popitem(last=False)
                    self._evict(False)
                else:
                    self.once.popitem(last=False)
            elif held + a + b >= self.capacity:
                if held + a + b == 2 * self.capacity:
                    self.gone_again.popitem(last=False)
                if held >= self.capacity:
                    self._evict(False)
            self.once[key] = None
        return False


POLICIES = {
    "lru": lambda n: _Recent(n, True),
    "fifo": lambda n: _Recent(n, False),
    "lfu": lambda n: _Ranked(n, False),
    "opt": lambda n: _Ranked(n, True),
    "mru": _Newest,
    "hyperbolic": _Hyperbolic,
    "arc": _Adaptive,
}
_NEVER = 1 << 62


def simulate(trace: DataFrame, shard: str, order: str, key: str, capacity: int, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """(shard, policy, accesses, hits) of a sharded cache with ``capacity`` entries a shard.

    Each shard is replayed in order by one task that holds a cache of each policy and a batch
    of rows, so memory follows the capacity, not the trace; more shards spread further. The
    optimal policy sees each access's next one, which a window finds. Counts leave a task
    once a batch.
    """
    ahead = Window.partitionBy(shard, key).orderBy(order)
    rows = trace.select(F.col(shard).alias("shard"), F.col(order).alias("at"), F.col(key).alias("key"), F.coalesce(F.lead(order).over(ahead), F.lit(_NEVER)).cast("long").alias("after"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "at")

    def replay(batches):
        import pandas as pd

        now, caches = None, {}
        for b in batches:
            counts: dict = {}
            for s, k, after in zip(b["shard"].tolist(), b["key"].tolist(), b["after"].tolist()):
                if not caches or s != now:
                    now, caches = s, {p: POLICIES[p](capacity) for p in policies}
                for p, cache in caches.items():
                    c = counts.setdefault((s, p), [0, 0])
                    c[0] += 1
                    c[1] += cache.access(k, after)
            yield pd.DataFrame([(s, p, *c) for (s, p), c in counts.items()], columns=["shard", "policy", "accesses", "hits"])

    kind = rows.schema["shard"].dataType.simpleString()
    parts = rows.mapInPandas(replay, f"shard {kind}, policy string, accesses long, hits long")
    return parts.groupBy("shard", "policy").agg(F.sum("accesses").alias("accesses"), F.sum("hits").alias("hits"))


def reuse_distances(trace: DataFrame, shard: str, order: str, key: str) -> DataFrame:
    """(shard, distance, n): other keys met between two accesses of a key; -1 for its first.

    Each shard is read in order by one task, which holds its distinct keys; more shards
    spread further, and distances then are within a shard, as those of a sharded cache.
    """
    rows = trace.select(F.col(shard).alias("shard"), F.col(order).alias("at"), F.col(key).alias("key")).repartition("shard").sortWithinPartitions("shard", "at")

    def replay(batches):
        import pandas as pd

        now, seen, times, clock = None, None, [], 0
        for b in batches:
            counts: dict = {}
            for s, k in zip(b["shard"].tolist(), b["key"].tolist()):
                if seen is None or s != now:
                    now, seen, times, clock = s, {}, [], 0
                d, last = -1, seen.get(k)
                if last is not None:
                    at = bisect.bisect_left(times, last)
                    d = len(times) - at - 1
                    del times[at]
                clock += 1
                seen[k] = clock
                times.append(clock)
                counts[s, d] = counts.get((s, d), 0) + 1
            yield pd.DataFrame([(*x, n) for x, n in counts.items()], columns=["shard", "distance", "n"])

    kind = rows.schema["shard"].dataType.simpleString()
    return rows.mapInPandas(replay, f"shard {kind}, distance long, n long").groupBy("shard", "distance").agg(F.sum("n").alias("n"))


def miss_ratio_curve(distances: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, misses, ratio) of least-recently-used shards of each capacity, all from one pass."""
    sums = [F.sum(F.when((F.col("distance") < 0) | (F.col("distance") >= c), F.col("n")).otherwise(0)).alias(str(c)) for c in capacities]
    total = distances.agg(F.sum("n").alias("n"), F.array(*sums).alias("m"))
    each = total.select("n", F.explode(F.arrays_zip(F.array(*map(F.lit, capacities)).alias("capacity"), F.col("m").alias("misses"))).alias("x"))
    return each.select(F.col("x.capacity").cast("long").alias("capacity"), F.col("x.misses").alias("misses"), (F.col("x.misses") / F.col("n")).alias("ratio"))


def bucket_limits(most: int = 1 << 63) -> list[int]:
    """Upper limits of histogram buckets: 1, 2, then steps of 1.5, each cut to two digits; the steps are not."""
    out, at = [1, 2], 2.0
    while (at := at * 1.5) <= most:
        power = 10 ** max(0, len(str(int(at))) - 2)
        out.append(int(at) // power * power)
    return out


def bucket_percentile(rows: DataFrame, by: str, value: str, percentile: float, limits: list[int] | None = None) -> DataFrame:
    """(by, n, estimate): a percentile interpolated within its bucket, between min and max.

    Rows shrink to one for each bucket before anything is ordered. Nulls do not count.
    """
    limits = limits or bucket_limits(1 << 40)
    v = F.col(value).cast("long")
    bounds = F.array(*[F.lit(x).cast("long") for x in limits])
    place = F.size(F.filter(bounds, lambda x: x < v))
    counts = rows.where(v.isNotNull()).groupBy(by, place.alias("b")).agg(F.count("*").alias("c"), F.min(v).alias("least"), F.max(v).alias("most"))
    whole, so_far = Window.partitionBy(by), Window.partitionBy(by).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(by, "b", "c", F.sum("c").over(so_far).alias("upto"), F.sum("c").over(whole).alias("n"), F.min("least").over(whole).alias("least"), F.max("most").over(whole).alias("most"))
    goal = F.col("n") * (percentile / 100.0)
    first = counts.where(F.col("upto") >= goal).groupBy(by).agg(F.min_by(F.struct("c", "upto", "n", "least", "most", "b"), "b").alias("x")).select(by, "x.*")
    left = F.when(F.col("b") == 0, 0).otherwise(F.element_at(bounds, F.col("b")))
    right = F.when(F.col("b") < len(limits), F.get(bounds, F.col("b"))).otherwise(F.col("most"))
    at = left + (right - left) * ((goal - (F.col("upto") - F.col("c"))) / F.col("c"))
    return first.select(by, "n", F.greatest(F.least(at, F.col("most").cast("double")), F.col("least").cast("double")).alias("estimate"))
