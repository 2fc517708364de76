"""Counts over whole texts, which the quality operators learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks

SYMBOLS = b"#*$%&|<>"
#: Words of a window whose repeats count.
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_unique", "n_lines", "n_marks", "n_digits"]
#: Ratios, each within bounds for any text; what models and rules see.
RATIOS = ["log_words", "mean_length", "symbols", "dup_lines", "repeats", "upper", "unique", "marks", "digits"]


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and COUNTS of every row; a null text has zeros. Ids may repeat or be null.

    ``n_symbols`` counts characters of ``#*$%&|<>``; ``n_dup_lines`` lines with a word that
    equal an earlier line; ``n_repeat_words`` words within 5-word windows found twice or more
    in the text, the first included; ``n_upper`` words of two or more letters without a lower
    case one; ``n_marks`` the characters ``!`` and ``?``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            out, texts = [], b.column(1).to_pylist()
            for i, j in chunks(texts):
                w = Words(texts[i:j])
                h = w.windows(WINDOW)
                for k, t in enumerate(texts[i:j]):
                    a, z = int(w.first[k]), int(w.first[k + 1])
                    n = z - a
                    if not n:
                        out.append((0,) * len(COUNTS))
                        continue
                    repeated = 0
                    if n > WINDOW:
                        _, place, times = np.unique(h[a : z - WINDOW + 1], return_inverse=True, return_counts=True)
                        again = np.flatnonzero(times[place] > 1)
                        if len(again):
                            edge = np.zeros(n + 1, np.int64)
                            np.add.at(edge, again, 1)
                            np.add.at(edge, again + WINDOW, -1)
                            repeated = int((np.cumsum(edge[:n]) > 0).sum())
                    words = w.lines[k].split(b" ")
                    lines = [x for x in t.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
                    text = w.lines[k].decode()
                    upper = sum(map(str.isupper, text.split(" "))) if text.upper() != text.lower() else 0
                    out.append((n, len(text) - n + 1, len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, upper, len(set(words)), len(lines), t.count(b"!") + t.count(b"?"), len(t) - len(t.translate(None, b"0123456789"))))
            cols = np.array(out, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names=["id", *COUNTS])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def with_ratios(counts: DataFrame) -> DataFrame:
    """RATIOS beside the counts; all zero for a text without words."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    cols = {
        "log_words": F.log1p("n_words"),
        "mean_length": F.least(F.col("word_chars") / words, F.lit(50.0)),
        "symbols": F.least(F.col("n_symbols") / words, F.lit(5.0)),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("n_upper") / words,
        "unique": F.col("n_unique") / words,
        "marks": F.least(F.col("n_marks") / words, F.lit(5.0)),
        "digits": F.col("n_digits") / chars,
    }
    return counts.select("*", *[c.cast("double").alias(k) for k, c in cols.items()])


def bounded(rows: DataFrame, most: int, seed: int, key: str = "id") -> DataFrame:
    """About ``most`` rows drawn by a hash of the key, or all if there are no more."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label): one label for each id that has one; of several the least."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
