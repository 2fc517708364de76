"""Operator 10: exact substring dedup behind a distributed count-min prefilter.

Pass 1: each block of documents sketches its windows; the sketches travel as compressed cell
lists, cut by cell range, and are merged range by range. Each block gets back its own cells
whose merged count is two or more. Counts are never too low, so no repeat is lost.
Pass 2: windows whose every cell is counted twice or more are grouped exactly, by 128 hash
bits, to find the first document of each.
Pass 3: candidate windows that are not first are removed.
All passes read the documents from one exchange, which Spark reuses.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, lean_group, lean_pair, table

#: Characters of a block: what one task holds at a time.
BLOCK_CHARS = 8 << 20
#: Sketch rows, and cells in a row for each expected window.
DEPTH, CELLS_PER_WINDOW = 2, 8
#: log2 of the cells that one merging group holds (one byte each).
RANGE_BITS = 24
#: Rows without id come after all ids below this, in the order of a hash of their text.
FIRST_UNNAMED = 2**63 - 2**40


def _encode(cells: np.ndarray) -> bytes:
    """Sorted cells as compressed differences, bytes of equal weight together."""
    d = np.diff(cells, prepend=np.uint64(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 4).T.tobytes())


def _decode(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u4").ravel(), dtype=np.uint64)


def _block_windows(texts: list[bytes | None], window: int):
    """Over parts of a block: the words, both hashes, which windows lie in one text, the first text's place."""
    for i, j in chunks(texts):
        w = Words(texts[i:j])
        yield i, w, w.windows(window, 0), w.windows(window, 1), w.inside(window)


def _repeated(notes: pa.Table, row: int) -> np.ndarray:
    """This block's cells of a sketch row that are counted twice or more, sorted."""
    parts = sorted((s, b) for r, s, b in zip(*(notes.column(c).to_pylist() for c in ("row", "part", "blob"))) if b is not None and r == row)
    return np.concatenate([_decode(b) + (np.uint64(s) << np.uint64(RANGE_BITS)) for s, b in parts]) if parts else np.empty(0, np.uint64)


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def _candidates(h0, h1, ok, cells, shift):
    """Places of windows whose cells are all counted twice or more."""
    at = np.flatnonzero(ok)
    for h, c in zip((h0, h1), cells):
        at = at[_member(h[at] >> shift, c)]
    return at


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """All input columns, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``, for every row.

    A word goes if a window over it also starts earlier: in a document of a smaller id, or
    earlier in the same document. Ids are integers (others are an error). Rows without id
    order last, by a hash of their text, so they are no single group. Rows that share an id
    do not count as earlier than each other, so repeated rows fare alike. A null or blank
    text has no words; an empty table gives no rows.
    ``kept_text`` is the text itself where nothing goes, else the kept words joined by a
    space. Input columns named like a result are replaced; other names don't matter. No size is capped; one document
    is held whole, and otherwise a task holds a block of BLOCK_CHARS. Windows compare by 128
    hash bits.
    """
    results = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results and c not in (id_col, text_col)])
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    bits = max(RANGE_BITS, math.ceil(math.log2(CELLS_PER_WINDOW * (chars / 6 + 1))))
    shift = np.uint64(64 - bits)
    low = np.uint64((1 << RANGE_BITS) - 1)

    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer column")
    own = "__"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    BLOCK, ORDER, TEXT = own + "block", own + "order", own + "text"
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_UNNAMED) + F.xxhash64(text_col).bitwiseAND(F.lit(2**40 - 1)))
    block = F.pmod(F.xxhash64(order), F.lit(blocks))
    columns = [F.col(c) for c in docs.columns]
    spread = docs.select(block.alias(BLOCK), order.alias(ORDER), F.col(text_col).cast("string").cast("binary").alias(TEXT), *[c for n, c in zip(docs.columns, columns) if n != text_col])

    def texts_of(t: pa.Table) -> list[bytes | None]:
        return t.column(TEXT).to_pylist()

    def sketch(t: pa.Table) -> pa.Table:
        out, cells = [], [[] for _ in range(DEPTH)]
        for _, _, h0, h1, ok in _block_windows(texts_of(t), window):
            for k, h in enumerate((h0, h1)):
                cells[k].append(h[ok] >> shift)
        block = t.column(BLOCK)[0].as_py()
        for k, c in enumerate(cells):
            c, n = np.unique(np.concatenate(c), return_counts=True) if c else (np.empty(0, np.uint64), np.empty(0, int))
            c = np.repeat(c, np.minimum(n, 2))
            part = (c >> np.uint64(RANGE_BITS)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for a, z in zip(cut, [*cut[1:], len(c)]):
                out.append((k, int(part[a]), block, _encode(c[a:z] & low)))
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate((("row", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())))})

    def merge(t: pa.Table) -> pa.Table:
        count = np.zeros(1 << RANGE_BITS, np.uint8)
        row, part = t.column("row")[0].as_py(), t.column("part")[0].as_py()
        blobs = list(zip(t.column("block").to_pylist(), t.column("blob").to_pylist()))
        for _, b in blobs:
            c = _decode(b)
            again = np.diff(c, prepend=np.uint64(2**63)) == 0
            c, twice = c[~again], c[again]
            count[c] = np.minimum(count[c] + 1, 2)
            count[twice] = 2
        out = []
        for k, b in blobs:
            c = np.unique(_decode(b))
            c = c[count[c] > 1]
            if len(c):
                out.append((k, _encode(c)))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "row": pa.array([row] * len(out), pa.int32()), "part": pa.array([part] * len(out), pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})

    def candidates(t: pa.Table, notes: pa.Table) -> pa.Table:
        orders, out = t.column(ORDER).to_numpy(), []
        cells = [_repeated(notes, k) for k in range(DEPTH)]
        for i, w, h0, h1, ok in _block_windows(texts_of(t), window):
            at = _candidates(h0, h1, ok, cells, shift)
            doc = np.searchsorted(w.first, at, "right") - 1
            a, b = h0[at], h1[at]
            sort = np.lexsort((a, doc))
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(doc[sort]) != 0) | (a[sort][1:] != a[sort][:-1])
            keep = sort[new]
            out.append((orders[i + doc[keep]], a[keep].view(np.int64), b[keep].view(np.int64)))
        cols = [np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in range(3)]
        return pa.table(dict(zip(("d", "a", "b"), map(pa.array, cols))))

    names = [c for c in docs.columns if c != text_col]

    def finish(t: pa.Table, notes: pa.Table) -> pa.Table:
        cells = [_repeated(notes, k) for k in range(DEPTH)]
        held = notes.filter(notes.column("d").is_valid())
        d, a = held.column("d").to_numpy(), held.column("a").to_numpy().view(np.uint64)
        sort = np.lexsort((a, d))
        d, a = d[sort], a[sort]
        orders, texts, out = t.column(ORDER).to_numpy(), texts_of(t), []
        for i, w, h0, h1, ok in _block_windows(texts, window):
            at = _candidates(h0, h1, ok, cells, shift)
            hit = np.searchsorted(at, w.first)
            for k in range(len(w.lines)):
                start, n = int(w.first[k]), int(w.first[k + 1] - w.first[k])
                places = at[hit[k] : hit[k + 1]]
                gone = 0
                line = w.lines[k]
                if len(places):
                    h = h0[places]
                    lo, hi = np.searchsorted(d, orders[i + k], "left"), np.searchsorted(d, orders[i + k], "right")
                    first = np.zeros(len(h), bool)
                    first[np.unique(h, return_index=True)[1]] = True
                    bad = places[~(first & _member(h, a[lo:hi]))] - start
                    if len(bad):
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, bad, 1)
                        np.add.at(edge, bad + window, -1)
                        kept = np.cumsum(edge[:n]) == 0
                        gone = n - int(kept.sum())
                        words = line.split(b" ")
                        line = b" ".join([words[x] for x in np.flatnonzero(kept)])
                whole = texts[i + k]
                out.append((n, gone, hashlib.sha256(line).hexdigest(), whole if not gone else line))
        res = {c: t.column(c) for c in names}
        for n, (c, kind) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()))):
            res[c] = pa.array([x[n] for x in out], kind)
        res["kept_text"] = pa.array([x[3] for x in out], pa.binary())
        return pa.table(res)

    marked = spread.groupBy(BLOCK).applyInArrow(lean_group(sketch), "row int, part long, block long, blob binary")
    replies = marked.groupBy("row", "part").applyInArrow(lean_group(merge), "block long, row int, part long, blob binary")
    found = spread.groupBy(BLOCK).cogroup(replies.groupBy("block")).applyInArrow(lean_pair(_none_if_no_text(candidates, "d", "a", "b")), "d long, a long, b long")
    first = found.groupBy("a", "b").agg(F.min("d").alias("d"))
    firsts = first.select(F.pmod(F.xxhash64("d"), F.lit(blocks)).alias("block"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("blob"), "d", "a")
    notes = replies.select("block", "row", "part", "blob", F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("a")).unionByName(firsts)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in names}
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "n_words long, n_removed long, kept_sha256 string, kept_text binary"])
    out = spread.groupBy(BLOCK).cogroup(notes.groupBy("block")).applyInArrow(lean_pair(finish), schema)
    return out.select(*names, *results[:3], F.col("kept_text").cast("string").alias("kept_text"))


def _none_if_no_text(f, *longs):
    """Replies go only to blocks that have documents; an empty side gives no rows."""

    def run(t: pa.Table, notes: pa.Table) -> pa.Table:
        if not t.num_rows or not notes.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in longs})
        return f(t, notes)

    return run


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
