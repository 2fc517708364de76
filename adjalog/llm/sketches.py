"""Operator 2: document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs; its set of paragraph digests goes into the cells of a sketch,
each digest into one cell of each of three rows. A cell holds a count, the xor of its digests
and the xor of their check hashes. The number of cells follows the number of digests, so the
sketch alone gives all of them back. Rows have a power of two of cells, so a larger sketch
folds into a smaller one.

Two fingerprints subtract cell by cell at the smaller one's size; what is left peels: a cell
with one digest gives it away, and taking it out of its other cells may lay bare more. A pair
that fails is retried with larger sketches of the same digests; if these fail too, the sets
are compared. All of it is DataFrame functions on the row; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: A paragraph is a line; one of more characters than LONG is cut where sentences end.
LONG, SENTENCE = 2000, r"(?<=[.!?])\s+|(?<=[。！？])"
#: What larger sketches of a failed pair have, as a multiple of the larger one's cells.
LARGER = (2, 8)
#: Rounds of peeling at most; a round that finds nothing ends it.
ROUNDS = 40
#: Rows of one ordered bucket, about, and buckets at most (more rows make larger buckets).
BUCKET_ROWS, BUCKETS = 500, 1 << 16

_CELLS = "array<struct<c: bigint, n: int, k: bigint, h: int>>"
_NONE = "cast(array() as array<bigint>)"


def paragraph_digests(text: Column) -> Column:
    """The set of digests of a text's paragraphs that hold more than spaces; none for a null text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > LONG, F.split(x, SENTENCE)).otherwise(F.array(x))))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(F.trim(p)) > 0), lambda p: F.xxhash64(p)))


def _let(name: str, value: str, body: str) -> str:
    """SQL with a value computed once and used under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def cells_a_row(n: str) -> str:
    """SQL: the power of two of cells in each of the three rows, for n digests."""
    return f"cast(pow(2, ceil(log2({n} / 2 + 3))) as bigint)"


def _entries(items: str, sign: str, x: str, m: str) -> str:
    """SQL: the three cells of each item; the row is above bit 40, the place below."""
    cell = "named_struct('c', shiftleft({r}L, 40) | (shiftrightunsigned({x}, {s}) & ({m} - 1)), 'n', cast({sign} as int), 'k', {x}, 'h', hash({x}))"
    three = ", ".join(cell.format(r=r, s=21 * r, x=x, m=m, sign=sign) for r in range(3))
    return f"flatten(transform({items}, y -> array({three})))"


def merged(entries: str) -> str:
    """SQL: entries of one cell as one, those that cancel left out; in order of the cells."""
    end = "coalesce(get(starts, j + 1), size(s))"
    total = f"if({end} = p + 1, s[p], aggregate(slice(s, p + 2, {end} - p - 1), s[p], (a, x) -> named_struct('c', a.c, 'n', a.n + x.n, 'k', a.k ^ x.k, 'h', a.h ^ x.h)))"
    some = _let("starts", "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i].c <> s[i - 1].c)", f"filter(transform(starts, (p, j) -> {total}), z -> z.n <> 0 or z.k <> 0 or z.h <> 0)")
    return _let("s", f"sort_array({entries})", f"if(size(s) = 0, cast(array() as {_CELLS}), {some})")


def sketch(digests: str, m: str, sign: str = "1") -> str:
    """SQL: the cells of an array of digests that are not empty."""
    return merged(_entries(digests, sign, "y", m))


def subtract(a: str, b: str, m: str) -> str:
    """SQL: the cells of sketch a less those of b, both folded to m cells a row."""
    fold = "named_struct('c', (x.c & -1099511627776L) | (x.c & ({m} - 1)), 'n', {n}x.n, 'k', x.k, 'h', x.h)"
    return merged(f"concat(transform({a}, x -> {fold.format(m=m, n='')}), transform({b}, x -> {fold.format(m=m, n='-')}))")


def peel(cells: str, m: str) -> str:
    """SQL: a struct (removed, added) of the digests with counts 1 and -1, or null if some cell would not peel."""
    pure = "array_distinct(transform(filter(t.cells, c -> c.n = {n} and c.h = hash(c.k)), c -> c.k))"
    after = merged(f"concat(t.cells, {_entries('p', '-1', 'y', m)}, {_entries('q', '1', 'y', m)})")
    stuck = "named_struct('cells', t.cells, 'removed', t.removed, 'added', t.added, 'live', false)"
    moved = f"named_struct('cells', {after}, 'removed', concat(t.removed, p), 'added', concat(t.added, q), 'live', true)"
    step = _let("p", pure.format(n=1), _let("q", pure.format(n=-1), f"if(size(p) + size(q) = 0, {stuck}, {moved})"))
    start = f"named_struct('cells', {cells}, 'removed', {_NONE}, 'added', {_NONE}, 'live', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (t, r) -> if(not t.live or size(t.cells) = 0, t, {step}), t -> if(size(t.cells) = 0, named_struct('removed', t.removed, 'added', t.added), null))"


def difference(a: str, b: str) -> str:
    """SQL: a struct (removed, added): the digests of fingerprint a only, and of b only.

    ``a`` and ``b`` are structs (digests, m, cells). The sketches themselves come first; the
    digests make the larger ones of a failed pair.
    """
    tries = [_let("m", f"least({a}.m, {b}.m)", peel(subtract(f"{a}.cells", f"{b}.cells", "m"), "m"))]
    for k in LARGER:
        both = merged(f"concat({_entries(f'{a}.digests', '1', 'y', 'm')}, {_entries(f'{b}.digests', '-1', 'y', 'm')})")
        tries.append(_let("m", f"{k} * greatest({a}.m, {b}.m)", peel(both, "m")))
    sets = f"named_struct('removed', array_except({a}.digests, {b}.digests), 'added', array_except({b}.digests, {a}.digests))"
    return f"coalesce({', '.join(tries)}, {sets})"


def fingerprint(digests: str) -> Column:
    """A struct (digests, m, cells) of a column of digests: the set and its sketch."""
    return F.expr(_let("m", cells_a_row(f"size({digests})"), f"named_struct('digests', {digests}, 'm', m, 'cells', {sketch(digests, 'm')})"))


def as_text(f: str) -> Column:
    """``digests:cells a row:`` and ``row-place.count.digests.checks`` of each cell, numbers in hexadecimal."""
    cell = "concat(shiftright(c.c, 40), '-', hex(c.c & 1099511627775L), '.', hex(c.n), '.', hex(c.k), '.', hex(c.h & 4294967295L))"
    return F.expr(f"lower(concat(hex(size({f}.digests)), ':', hex({f}.m), ':', array_join(transform({f}.cells, c -> {cell}), ';')))")


def _array(values: list, kind: str) -> Column:
    """An array literal of that element type; numbers in one piece, which is folded to a constant."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.split(F.lit(",".join("" if x is None else str(x) for x in values)), ",").try_cast(f"array<{kind}>")
    return F.array(*[F.lit(x).cast(kind) for x in values]).cast(f"array<{kind}>")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, digests, next, next_digests): the next row in descending order, the first after the last.

    Rows order by id, nulls last, then by a hash of the text, so that null or repeated ids
    don't make one group. They go to buckets of that order, whose bounds are the keys of a
    few rows picked by hash, and the last key. The row at the end of each bucket goes to the
    next one too, for its last row to look at, so texts are exchanged once and no bucket sees
    another. Which rows are bounds says how large buckets are, never what comes out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", "text", F.struct("id", F.xxhash64("text").alias("h")).alias("o"))
    n, last = rows.agg(F.count("*"), F.max("o")).first()
    rate = int(min(1 / BUCKET_ROWS, BUCKETS / max(1, n)) * (1 << 40))
    picked = {tuple(r.o) for r in rows.where(F.pmod(F.xxhash64("o", F.lit(2)), F.lit(1 << 40)) < rate).select("o").distinct().collect()}
    bounds = sorted(picked | ({tuple(last)} if last else set()), key=lambda x: (x[0] is not None, x[0], x[1]) if x[0] is not None else (False, x[1]))
    kind, size = rows.schema["id"].dataType.simpleString(), max(1, len(bounds))
    nulls = sum(x is None for x, _ in bounds)
    rows = rows.withColumn("b", _array([x for x, _ in bounds], kind)).withColumn("bh", _array([h for _, h in bounds], "bigint"))
    at, steps = "lo + shiftleft(1, {k} - i)", max(1, size.bit_length())
    at = at.format(k=steps)
    below = f"if({at} <= {nulls}, id is not null or element_at(bh, {at}) < o.h, id is not null and (element_at(b, {at}) < id or (element_at(b, {at}) = id and element_at(bh, {at}) < o.h)))"
    rows = rows.withColumn("bucket", F.expr(f"aggregate(sequence(1, {steps}), 0, (lo, i) -> if({at} < {size} and {below}, {at}, lo))"))
    here = F.struct("bucket", F.lit(0).alias("end"))
    ahead = F.struct(F.pmod(F.col("bucket") + 1, F.lit(size)).alias("bucket"), F.lit(1).alias("end"))
    ends = F.expr("id <=> get(b, bucket) and o.h = get(bh, bucket)")
    rows = rows.withColumn("to", F.explode(F.when(ends, F.array(here, ahead)).otherwise(F.array(here)))).select("id", "text", paragraph_digests(F.col("text")).alias("digests"), "o.h", "to.bucket", "to.end")
    w = Window.partitionBy("bucket").orderBy("end", F.col("id").desc_nulls_last(), F.col("h").desc_nulls_last())
    return rows.select("id", "text", "digests", "end", F.lead("text").over(w).alias("next"), F.lead("digests").over(w).alias("next_digests")).where("end = 0").drop("end")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, removed, added).

    ``near_*`` is 1 less the differing digests' share of both sets, found by subtracting and
    peeling the fingerprints; two empty sets are alike. ``removed`` and ``added`` are the
    digests recovered from the text's and its edited text's fingerprints. Ids are of any type
    that orders; null ones come last; repeated rows are rows of their own (equal ones meet in
    one bucket). Null texts count as empty; whole texts count, however long. Other columns,
    whatever their names, are not read. An empty table gives no rows. Digests stand for
    paragraphs by 64-bit hash.
    """
    rows = with_next(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("next", F.lit("")).alias("next"), F.col("digests").alias("d_text"), F.col("next_digests").alias("d_next"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(next, int(n_chars div 2)))"))
    names = ("text", "edited", "next")

    def once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
        """Columns made once for each row, not anew for each use: an explode of one struct."""
        return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("made")).select(*keep, "made.*")

    rows = once(rows.withColumn("sha", F.sha2("edited", 256)), ["id", "n_chars", "sha", "d_text", "d_next"], d_edited=paragraph_digests(F.col("edited")))
    rows = once(rows, ["id", "n_chars", "sha"], **{f"f_{c}": fingerprint(f"d_{c}") for c in names})
    rows = once(rows, ["id", "n_chars", "sha", *[f"f_{c}" for c in names]], by_edited=F.expr(difference("f_text", "f_edited")), by_next=F.expr(difference("f_text", "f_next")))

    def near(found: str, other: str) -> Column:
        n = F.size("f_text.digests") + F.size(f"{other}.digests")
        return F.when(n == 0, 1.0).otherwise(1.0 - (F.size(f"{found}.removed") + F.size(f"{found}.added")) / n).cast("double")

    return rows.select("id", "n_chars", F.col("sha").alias("edited_sha256"), as_text("f_text").alias("fingerprint"), as_text("f_edited").alias("edited_fingerprint"), near("by_edited", "f_edited").alias("near_edited"), near("by_next", "f_next").alias("near_next"), "by_edited.removed", "by_edited.added")


def op2_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("removed").alias("n_removed"), F.size("added").alias("n_added"))
