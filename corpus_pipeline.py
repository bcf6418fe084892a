"""The training-data pipeline: documents in, token ids out. Each stage works on all that the one before it has kept.

All stages read whole texts, however long, take an empty table (and give one), and leave columns of any name as they are.
Those whose result still has to go through Python bound the Arrow batches of the session they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.decontamination import drop_leaking
from siftwell.llm.jaccard_join import keep_one_per_component
from siftwell.llm.language_id import accept_languages
from siftwell.llm.line_dedup import drop_frequent_lines
from siftwell.llm.pieces import round_trip
from siftwell.session import bound_batches, stage, unstage

#: Shingles of five words, similarity 0.8.
WORDS, PERCENT = 5, 80
MIN_DOCS = 10


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too), and those that are near to no language.

    Repeated rows are judged alike.
    """
    bound_batches(spark)
    return accept_languages(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least ten documents share, and documents of which nothing is left.

    ``n_chars``, where there is such a column, follows the text. A document that had nothing to drop stays as it is, a null
    or empty one too; of repeated rows all are treated alike.
    """
    shorter = drop_frequent_lines(docs, min_docs=MIN_DOCS)
    shorter = shorter.where((F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return shorter.select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest id (of equal ids, the smallest text hash).

    Documents without words are kept; of repeated rows one stays.
    """
    return keep_one_per_component(docs, words=WORDS, percent=PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item; null and empty texts leak none, repeated rows go or stay together."""
    bound_batches(spark)
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all texts, and whether decoding gives the text back; a null text counts as empty, repeated rows stay."""
    bound_batches(spark)
    decoded = round_trip(docs.select("doc_id", "text"))
    return decoded.select(
        "doc_id",
        "piece_ids",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Language profiles, WAND and the transducer are not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written as Parquet and read again, that of the one before deleted."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        if held is not None:
            unstage(held)
        held = docs
    return docs
