"""Operator 8: language by compression against a dictionary of each language.

A text is lower-cased, stripped of ASCII punctuation and digits, and compressed in chunks
with zstandard, once for each language with that language's raw-content dictionary. The
language of the smallest total wins; a narrow margin over the next one is a rejection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, lean_batches, table

#: Bytes of a dictionary: what is learned from a language is a bounded sample of this size,
#: of training texts, of longer ones a piece of SAMPLE_CHARS characters.
DICTIONARY_BYTES, SAMPLE_CHARS = 200_000, 20_000
#: Bytes compressed at a time, so that a long text's own repeats don't drown the dictionary.
CHUNK = 1000
#: Rejected below this share of the next best size: in effect ties.
MARGIN = 0.002
_DROP = bytes(c for c in range(128) if not chr(c).isalpha() and chr(c) not in " \t\n\r\x0b\x0c")


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(None, _DROP).split())


def has_letter(text: str, plain: bytes) -> bool:
    return any(97 <= c <= 122 for c in plain[:64]) or any(map(str.isalpha, text))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=3, min_match=3, target_length=8, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params)


def learn_dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each non-null language, the most frequent language first.

    A hash of the text draws each language's sample, each distinct text once, at a rate that
    the characters of its distinct texts set; only that sample comes to the driver. A
    language whose draw falls short of ``size`` is drawn again at a higher rate, up to all
    of its texts. Counts cover all rows. Only a language without any letter has none.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.withColumn("hash", F.xxhash64("text", F.lit(8)))
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    known = known.withColumn("text", F.substring("text", (F.pmod(F.xxhash64("hash"), spare + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS)))
    distinct = known.groupBy("lang", "hash").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("chars"))
    counts = distinct.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).collect()
    counts = sorted(counts, key=lambda r: (-r.n, r.lang))
    draw = F.pmod("hash", F.lit(1 << 20)) / (1 << 20)

    def plain(batches):
        for b in batches:
            out = pa.array([normalised(t) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang"), out], names=["lang", "plain"])

    out = {}
    rates = {r.lang: min(1.0, 2 * size / max(1, r.chars)) for r in counts}
    while rates:
        rate = F.lit(0.0)
        for lang, x in rates.items():
            rate = F.when(F.col("lang") == lang, F.lit(x)).otherwise(rate)
        drawn = known.where(draw < rate).dropDuplicates(["lang", "hash"]).select("lang", "text")
        sample = drawn.mapInArrow(lean_batches(plain), "lang string, plain binary").where("length(plain) > 0").collect()
        for lang in rates:
            out[lang] = b" ".join(sorted({bytes(x.plain) for x in sample if x.lang == lang}))[:size]
        rates = {lang: min(1.0, 8 * x) for lang, x in rates.items() if x < 1 and len(out[lang]) < size}
    # a raw dictionary takes 8 bytes at least
    return {r.lang: v if len(v) >= 8 else b" ".join([v] * 8) for r in counts if (v := out[r.lang])}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """Every row with its columns and ``lang_pred``, ``lang_score``, ``lang_rejected``.

    ``und`` with score 0 and rejected if the text is null or has no letter, or if nothing
    was learned. Ties go to the language more frequent in training. The score grows from 0
    to 1 with the margin over the next language. Each row stands for itself, so repeats,
    null ids and ties need no care; input columns named like a result are replaced. Only
    the dictionaries, of a fixed size for each language, are sent to the executors.
    """
    results = ("lang_pred", "lang_score", "lang_rejected")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results])
    names, contents = list(dictionaries), list(dictionaries.values())

    def judge(compressors, text):
        plain = normalised(text) if text else b""
        if not text or not names or not has_letter(text, plain):
            return "und", 0.0, True
        if not plain:
            plain = text.lower().encode()
        sizes = np.array([sum(len(c.compress(plain[i : i + CHUNK])) for i in range(0, len(plain), CHUNK)) for c in compressors])
        best = int(sizes.argmin())
        if len(names) == 1:
            return names[0], 1.0, False
        second = int(np.partition(sizes, 1)[1])
        lead = (second - int(sizes[best])) / second
        return names[best], float(1 - np.exp(-lead / 0.03)), lead < margin

    def run(batches):
        compressors = [_compressor(c) for c in contents]
        for b in batches:
            out = [judge(compressors, t.as_py()) for t in b.column(b.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=[*b.schema.names, *results])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean_batches(run), f"{kinds}, lang_pred string, lang_score double, lang_rejected boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("fold", fold("doc_id", 4))
    learned = learn_dictionaries(docs.where("fold <> 2"))
    out = identify(docs.select("doc_id", "fold", "text"), learned)
    return out.select("doc_id", (F.col("fold") == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
