"""A corpus pipeline of five stages over ``documents``; part of the subpackage llm.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet and rereads for the next one.

Null texts and texts without letters have no language and go in the first stage; later
stages, called by themselves, take null texts as empty. Repeated rows are copies: one stays.
Rows without id take part like any other and come last where ids decide. Ties are broken by
hashes of id and text, so reruns agree. Texts are read whole, however long. Columns besides
those of documents are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjalog.llm.common import Scratch, fold, table, tidied
from adjalog.llm.language import identify, learn_dictionaries
from adjalog.llm.mixing import mix_sources
from adjalog.llm.packing import pack
from adjalog.llm.simhash import near_duplicate_groups
from adjalog.llm.substrings import remove_repeats
from adjalog.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found get it as ``lang``; those rejected go."""
    ship(spark)
    learned = learn_dictionaries(docs.withColumn("fold", fold("doc_id", 4)).where("fold <> 2"))
    found = identify(docs.select(*COLUMNS), learned).where(~F.col("lang_rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    ship(spark)
    numbered = Scratch(spark, "stage").keep(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "docs")
    kept = near_duplicate_groups(numbered, "row", "text", order_col="doc_id").where("keeper").select("id")
    return numbered.join(kept, numbered.row == kept.id, "left_semi").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows go, and documents of which nothing is left."""
    ship(spark)
    out = remove_repeats(docs.select(*COLUMNS)).where("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("n_words") > 0, F.col("kept_text"))
    return out.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it."""
    ship(spark)
    numbered = Scratch(spark, "stage").keep(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "docs")
    _, draws = mix_sources(numbered, row_col="row")
    drawn = draws.select(F.col("row").alias("drawn"))
    return numbered.join(drawn, numbered.row == drawn.drawn).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each with its sequence and its place there."""
    ship(spark)
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("simhash", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]

#: The stages rest on compression, fingerprints and random draws, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents``; each stage is written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with tidied(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
