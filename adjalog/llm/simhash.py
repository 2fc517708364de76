"""Operator 1: SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into so few segments that, for two linked fingerprints, one segment
differs in one bit at most. Each segment is indexed once per bit with that bit wildcarded;
fingerprints that share such a variant meet in an equality join and are then verified.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, chunks, lean_batches, lean_group, mix, table
from .components import components

SEED = 42
#: A variant shared by more fingerprints than this is searched by the exact narrower keys.
CROWDED = 64
_SLICE = 1 << 16


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = hashes[i : i + _SLICE]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return total


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def simhash_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash, signed: a bit is set if over half of the hashes have it."""
    return int(np.frombuffer(_packed(2 * _set_bits(hashes) > len(hashes)), np.int64)[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash, signed; repeats of a shingle count, A-Z are lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return simhash_of(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), runs), np.uint64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp) per row; a null, empty or blank text has fingerprint zero."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            out = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["id", "fp"])

    return rows.mapInArrow(lean_batches(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: With bit i of a 64-bit fingerprint wildcarded: the rest of its 32-bit segment.
VARIANT_MASKS = [_signed((0xFFFFFFFF << (32 * (i // 32))) & ~(1 << i) & (2**64 - 1)) for i in range(64)]
#: A fingerprint itself and its 64 neighbours at one bit.
NEIGHBOUR_MASKS = [0, *(_signed(1 << i) for i in range(64))]


def link_fingerprints(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect all distinct ``fp`` at 2 or fewer differing bits.

    Two segments of 32 bits: of two fingerprints at distance 2 or 3, one segment holds one
    difference at most. Variants shared by up to CROWDED fingerprints are joined and
    verified. Members of a larger bucket take a narrower key instead: their 65 neighbours
    at one bit or none. Two fingerprints share such a neighbour exactly if they are at two
    bits or fewer, and no neighbour has more than 65 of them, so no group is large whatever
    the data and no pairs of a group are emitted: each member links to the least one.
    """
    masks = F.array(*[F.lit(m) for m in VARIANT_MASKS])
    variants = fps.select("fp", F.posexplode(masks).alias("pos", "mask")).select("pos", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared = variants.groupBy("pos", "key").agg(F.count("*").alias("n")).where("n > 1")
    # sizes in plans leave out what an explode adds: without the hint, 64 rows a fingerprint are broadcast by way of the driver
    members = scratch.keep(variants.hint("merge").join(shared, ["pos", "key"]), "members")
    few = members.where(F.col("n") <= CROWDED)
    a, b = few.select("pos", "key", F.col("fp").alias("u")), few.select(F.col("pos").alias("pos2"), F.col("key").alias("key2"), F.col("fp").alias("v"))
    near = (F.col("pos") == F.col("pos2")) & (F.col("key") == F.col("key2")) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    pairs = a.join(b, near).select("u", "v").distinct()
    crowd = members.where(F.col("n") > CROWDED).select("fp").distinct()
    flips = crowd.select("fp", F.explode(F.array(*[F.lit(m) for m in NEIGHBOUR_MASKS])).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("key"), "fp")
    stars = flips.groupBy("key").agg(F.collect_list("fp").alias("all"), F.min("fp").alias("v")).where(F.size("all") > 1).select(F.explode("all").alias("u"), "v").where("u <> v").distinct()
    return pairs.union(stars)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component) for every row; component is the smallest id reachable over links.

    Equal fingerprints are one node, so a hot group of copies is one row before anything is
    compared. Repeated rows and ties share a component; a component without any id that is
    not null has a null one; null and blank texts have fingerprint zero and are linked like
    any other. An empty table gives an empty result. Other input columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, id_col, text_col, shingle), "marked")
    classes = scratch.keep(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(link_fingerprints(classes.select("fp"), scratch), scratch)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return marked.join(named, "fp", "left").select("id", "fp", "component")


#: Cells that count how common shingles are, and the blocks in which tasks send them.
CELLS, BLOCK = 1 << 22, 1 << 14
#: Cells of the bit set that tells whose shingles a verification needs.
WANTED = 1 << 23
#: Bits of the parity that a join looks at.
SHORT = 512
_TINY = 1e-9


def shingle_sets(texts: list[bytes | None], shingle: int):
    """The sorted distinct shingle hashes of each text, None without words; a short text is one shingle."""
    for i, j in chunks(texts):
        w = Words([t.lower() if t else t for t in texts[i:j]])
        h = w.windows(shingle)
        for a, z in zip(w.first[:-1], w.first[1:]):
            if z - a >= shingle:
                yield np.unique(h[a : z - shingle + 1])
            else:
                yield mix(np.bitwise_xor.reduce(w.hashes[a:z] * np.arange(1, 2 * (z - a), 2, dtype=np.uint64), keepdims=True)) if z > a else None


def node_of(hashes: np.ndarray) -> int:
    """64 hash bits of a set, signed: equal sets are one node."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), seed=SEED))


def parity(hashes: np.ndarray) -> bytes:
    """How many hashes fall on each of 2 n bits or more, modulo 2.

    Two sets differ in at least as many members as their parities do in bits.
    """
    size = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return _packed(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1)


def short_parity(hashes: np.ndarray) -> list[int]:
    """The parity on SHORT bits, as longs: a coarser bound, of one size for all sets."""
    bits = np.bincount((hashes & np.uint64(SHORT - 1)).astype(np.int64), minlength=SHORT) & 1
    return np.frombuffer(_packed(bits), np.int64).tolist()


def least_difference(x: bytes, y: bytes) -> int:
    """Members that are in one set only: not more than really, from the sets' parities."""
    x, y = sorted((x, y), key=len)
    folded = np.bitwise_xor.reduce(np.frombuffer(y, np.uint8).reshape(-1, len(x)), axis=0).tobytes()
    return (int.from_bytes(x, "little") ^ int.from_bytes(folded, "little")).bit_count()


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest members, so many that two sets of that similarity share one of them."""
    ranked = hashes[np.lexsort((hashes, common[(hashes & np.uint64(CELLS - 1)).astype(np.int64)]))]
    return ranked[: len(hashes) - math.ceil(similarity * len(hashes) - _TINY) + 1]


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """How often the shingles of each cell occur in all rows; it only orders shingles."""

    def tally(batches):
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                sets = [h for h in shingle_sets(b.column("text").slice(i, 1000).to_pylist(), shingle) if h is not None]
                if sets:
                    cells, n = np.unique(np.concatenate(sets) & np.uint64(CELLS - 1), return_counts=True)
                    counts[cells.astype(np.int64)] += n
        counts = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, BLOCK)
        some = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[k].tobytes() for k in some], pa.binary())], names=["block", "counts"])

    def add(t):
        total = np.zeros(BLOCK, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint16)
        total = np.minimum(total, 65535).astype(np.uint16)
        return pa.table({"block": t.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = texts.mapInArrow(lean_batches(tally), "block int, counts binary").groupBy("block").applyInArrow(lean_group(add), "block int, counts binary")
    out = np.zeros((CELLS // BLOCK, BLOCK), np.uint16)
    for r in parts.collect():
        out[r.block] = np.frombuffer(r.counts, np.uint16)
    return out.reshape(-1)


def _index(texts: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(key, node, size, place): each set's prefix, and how many of its members are rarer."""

    def run(batches):
        seen = set()
        for texts in (b.column("text").slice(i, 1000).to_pylist() for b in batches for i in range(0, b.num_rows, 1000)):
            keys, nodes, sizes, places = [], [], [], []
            for h in shingle_sets(texts, shingle):
                if h is None or (node := node_of(h)) in seen:
                    continue
                seen.add(node)
                head = prefix(h, common, similarity)
                keys.append(head.view(np.int64))
                places.append(np.arange(len(head), dtype=np.int32))
                nodes.append(np.full(len(head), node, np.int64))
                sizes.append(np.full(len(head), len(h), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, sizes, places)], names=["key", "node", "size", "place"])

    return texts.mapInArrow(lean_batches(run), "key long, node long, size int, place int")


def _able(similarity: float):
    """Whether sizes and places let the pair (u, v), first met at this key, be similar."""
    big, small = F.greatest("nu", "nv"), F.least("nu", "nv")
    return (small >= similarity * big - _TINY) & (F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) >= similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - _TINY)


def _sets(texts: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the sets of the texts whose hash is in ``asked`` (seen), and of some others.

    The hashes asked for come to the driver as a bit set of fixed size, never as rows.
    """
    cells = asked.select(F.pmod("seen", F.lit(WANTED)).alias("cell"))
    blocks = cells.groupBy(F.expr("bitmap_bucket_number(cell)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits")).collect()
    wanted = np.zeros(((WANTED >> 15) + 1, 4096), np.uint8)
    for r in blocks:
        wanted[r.k] = np.frombuffer(r.bits, np.uint8)
    wanted = wanted.reshape(-1)

    def fetch(batches):
        sent = set()
        for b in batches:
            at = b.column("at").to_numpy(zero_copy_only=False) + b.column("shift").to_numpy(zero_copy_only=False).astype(np.int64) * 32768
            keep = (wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            nodes, sets = [], []
            for h in shingle_sets(b.column("text").filter(pa.array(keep)).to_pylist(), shingle):
                if h is not None and (node := node_of(h)) not in sent:
                    sent.add(node)
                    nodes.append(node)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    cell = F.pmod(F.xxhash64("text"), F.lit(WANTED))
    rows = texts.select("text", cell.alias("cell")).select("text", F.expr("bitmap_bit_position(cell)").alias("at"), F.expr("bitmap_bucket_number(cell)").cast("int").alias("shift"))
    return rows.mapInArrow(lean_batches(fetch), "node long, hashes binary").dropDuplicates(["node"])


def _similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets have that Jaccard similarity, exactly."""
    from_u, from_v = (classes.select(F.col("node").alias(c), F.col("bits").alias(f"b{c}"), F.col("size").alias(f"n{c}"), F.col("seen").alias(f"s{c}")) for c in "uv")

    def sift(batches):
        for b in batches:
            x, y, n = b.column("bu").to_pylist(), b.column("bv").to_pylist(), b.column("n").to_pylist()
            ok = [least_difference(p, q) <= m - 2 * math.ceil(similarity / (1 + similarity) * m - _TINY) for p, q, m in zip(x, y, n)]
            yield b.select(["u", "v", "su", "sv"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(from_u, "u").join(from_v, "v").select("u", "v", "su", "sv", "bu", "bv", (F.col("nu") + F.col("nv")).alias("n"))
    maybe = scratch.keep(both.mapInArrow(lean_batches(sift), "u long, v long, su long, sv long"), f"{name}-maybe")
    asked = maybe.select(F.col("su").alias("seen")).distinct().union(maybe.select(F.col("sv").alias("seen")).distinct())
    sets = scratch.keep(_sets(texts, asked, shingle), f"{name}-sets")

    def verify(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("hu"), b.column("hv")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= similarity * (len(x) + len(y) - shared) - _TINY)
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    full = maybe.select("u", "v").join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("hu")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("hv")), "v")
    edges = scratch.keep(full.select("u", "v", "hu", "hv").mapInArrow(lean_batches(verify), "u long, v long"), f"{name}-edges")
    scratch.drop(f"{name}-maybe")
    scratch.drop(f"{name}-sets")
    return edges


def variant_pairs(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of nodes (node, fp) that deletion variants of their fingerprints bring together.

    They connect all nodes whose fingerprints link: each node with the least one of its
    fingerprint, and the least ones of linked fingerprints.
    """
    heads = scratch.keep(classes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = classes.select("fp", F.col("node").alias("v")).join(heads, "fp").where("v <> head").select(F.col("head").alias("u"), "v")
    links = link_fingerprints(heads.select("fp"), scratch).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    a, b = (heads.select(F.col("fp").alias(f"f{c}"), F.col("head").alias(c)) for c in "uv")
    return same.union(links.join(a, "fu").join(b, "fv").select(F.least("u", "v"), F.greatest("u", "v")))


def _near_places(rows: DataFrame, order: list) -> DataFrame:
    """Each member of a bucket beside the first and the preceding one in that order, if of another root."""
    inside = Window.partitionBy("key").orderBy(*order)
    me = F.struct("node", "size", "place", "root")
    near = rows.select("node", "size", "place", "root", F.first(me).over(inside).alias("head"), F.lag(me).over(inside).alias("last")).where("last is not null")
    near = near.select(F.explode(F.array("head", "last")).alias("o"), F.col("node").alias("v"), F.col("size").alias("nv"), F.col("place").alias("pv"), F.col("root").alias("rv"))
    return near.select(F.col("o.node").alias("u"), F.col("o.size").alias("nu"), F.col("o.place").alias("pu"), F.col("o.root").alias("ru"), "v", "nv", "pv", "rv").where("ru <> rv")


def _able_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    return pairs.where(_able(similarity)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of rows (key, node, size, place, root, fixed) that share a key but not a root and may be similar."""
    left, right = (rows.select("key", *[F.col(c).alias(f"{short}{side}") for c, short in (("node", ""), ("size", "n"), ("place", "p"), ("root", "r"), ("fixed", "f"))]) for side in "uv")
    apart = F.aggregate(F.zip_with("fu", "fv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    both = F.col("nu") + F.col("nv")
    near = apart <= both - 2 * F.ceil(similarity / (1 + similarity) * both - _TINY)
    return left.join(right, "key").where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & _able(similarity) & near)


def similar_components(texts: DataFrame, classes: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, root) over all pairs of nodes at that Jaccard similarity; ``texts`` has (text).

    First come the pairs that the fingerprints' deletion variants bring together, verified
    by their sets. Pairs of that similarity can differ in more bits than the variants reach,
    so an exact way takes the rest, the nodes that are not connected by then. Two sets that
    are similar enough share one of the rarest members of each (a prefix), so
    buckets by prefix member miss no pair, whatever the size of the table. Two rounds compare
    each member of a bucket with the first and the preceding one only, by size and then in an
    order drawn for each bucket; they connect all but the stragglers of a group of copies.
    Then the members of a bucket that are still unconnected are compared exactly, but for
    pairs whose sizes, places in the prefixes or parities rule that similarity out.
    """
    linked = _similar(variant_pairs(classes, scratch), classes, texts, shingle, similarity, scratch, "linked")
    scratch.drop("members", "heads")
    common = _common(texts, shingle)
    index = _index(texts, shingle, similarity, common).repartition("key").dropDuplicates(["key", "node"])
    w = Window.partitionBy("key")
    shared = scratch.keep(index.withColumn("members", F.count("*").over(w)).where("members > 1"), "shared")

    def unconnected(rows: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        roots = scratch.keep(components(edges, scratch, name), f"{name}-roots")
        placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = placed.withColumn("lo", F.min("root").over(w)).withColumn("hi", F.max("root").over(w)).where("lo <> hi").drop("lo", "hi")
        return scratch.keep(placed, f"{name}-mixed")

    mixed = unconnected(shared, linked, "none")
    scratch.drop("shared")
    first = _similar(_able_pairs(_near_places(mixed, ["size", "node"]), similarity), classes, texts, shingle, similarity, scratch, "first")
    # the first round has seen all pairs of three members
    mixed = unconnected(mixed.where("members > 3").drop("root"), linked.union(first), "one")
    second = _similar(_able_pairs(_near_places(mixed, [F.xxhash64("node", "key"), "node"]), similarity), classes, texts, shingle, similarity, scratch, "second")
    mixed = unconnected(mixed.drop("root"), linked.union(first).union(second), "two")
    rest = _able_pairs(_met(mixed.join(classes.select("node", "fixed"), "node"), similarity), similarity)
    third = _similar(rest, classes, texts, shingle, similarity, scratch, "third")
    out = components(linked.union(first).union(second).union(third), scratch, "all")
    scratch.drop("none-mixed", "one-mixed", "two-mixed", "none-roots", "one-roots", "two-roots", "linked-edges", "first-edges", "second-edges", "third-edges")
    return out


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, order_col: str | None = None) -> DataFrame:
    """(id, key, group_key, keeper) for every row: near-duplicates at a Jaccard similarity.

    Rows are linked exactly if the Jaccard similarity of their sets of shingles (as 64-bit
    hashes) is ``similarity`` or more, and links are followed transitively. Deletion variants
    of the sets' SimHashes find links first, an exact way those beyond their reach. ``keeper`` is
    true for one row of each group: that of the smallest ``order_col``, the id if not given
    (nulls last, then by a hash of the text, then by row), so reruns keep the same documents.
    Repeated rows are copies of each other. Texts without words, null ones among them, form
    no group: each is kept. Whole texts count, however long; other columns, whatever their
    names, are not read; an empty table gives no rows. ``key`` numbers the rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    rows, texts = docs.select(F.col(id_col).alias("id"), text, F.col(order_col or id_col).alias("rank")), docs.select(text)

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column("text").to_pylist(), shingle))
            nodes = [None if h is None else node_of(h) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rank"), b.column("seen"), pa.array(nodes, pa.int64()), pa.array([None if h is None else len(h) for h in sets], pa.int32()), pa.array([None if h is None else simhash_of(h) for h in sets], pa.int64()), pa.array([None if h is None else parity(h) for h in sets], pa.binary()), pa.array([None if h is None else short_parity(h) for h in sets], pa.list_(pa.int64()))], names=["id", "rank", "seen", "node", "size", "fp", "bits", "fixed"])

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, rank {rows.schema['rank'].dataType.simpleString()}"
    marked = rows.withColumn("seen", F.xxhash64("text")).mapInArrow(lean_batches(run), f"{kinds}, seen long, node long, size int, fp long, bits binary, fixed array<bigint>")
    marked = scratch.keep(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    # all rows of a node have the same size, fingerprint and bits; one text of it is fetched later
    classes = scratch.keep(marked.where("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.first("fixed").alias("fixed"), F.min("seen").alias("seen")), "classes")
    roots = similar_components(texts, classes, shingle, similarity, scratch)
    grouped = scratch.keep(marked.join(roots, "node", "left").select("id", "rank", "seen", "row", F.coalesce("root", "node").alias("root")), "grouped")
    best = F.min(F.struct(F.col("rank").isNull().alias("none"), "rank", "seen", "row"))
    first = scratch.keep(grouped.where("root is not null").groupBy("root").agg(best.alias("m"), F.min("row").alias("least")), "first")
    named = grouped.join(first, "root", "left")
    return named.select("id", F.col("row").alias("key"), F.coalesce("least", "row").alias("group_key"), (F.col("root").isNull() | (F.col("row") == F.col("m.row"))).alias("keeper"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), shingle=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
