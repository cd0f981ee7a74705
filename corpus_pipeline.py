"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.language import UNDECIDED, identify_language
from quillspan.llm.minhash import near_duplicates
from quillspan.llm.mixing import mix_sources
from quillspan.llm.packing import pack_documents
from quillspan.llm.session import WORD, forget, materialize, settled
from quillspan.llm.suffix_trees import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter go. lang becomes the language found."""
    found = identify_language(docs, key=F.col("doc_id")).where(F.col("lang_pred") != UNDECIDED)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near copies.

    A document with words but no id stands under a key made of its text, above usual ids, and once
    however many copies it has.  Rows that share id and text are one document, and stay.
    """
    bare = docs.where(F.col("doc_id").isNull() & F.col("text").rlike(WORD))
    if not bare.take(1):
        return near_duplicates(docs).where("kept").select(*COLUMNS)
    bare = bare.groupBy("text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select(F.lit(None).cast("long").alias("doc_id"), "text", "rest.*")
    high = F.lit(1 << 62)
    key = F.xxhash64("text").bitwiseAND(high - 1).bitwiseOR(high)
    rest = docs.where(F.col("doc_id").isNotNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    both = rest.select(*COLUMNS, F.col("doc_id").alias("node")).unionByName(bare.select(*COLUMNS, key.alias("node")))
    return near_duplicates(materialize(both), id_col="node").where("kept").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; documents of which nothing is left go."""
    out = dedup_substrings(docs).where((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, one row for each copy drawn, shuffled in shards."""
    return mix_sources(docs).select(*COLUMNS)


def pack_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_to_targets),
    ("best_fit_packing", pack_into_sequences),
]

#: Hash draws (language samples, mixing) cannot be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's result is written to the shared folder, and goes when the next one's is there."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023 (called at once)
        if held is not None:
            forget(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
