"""Raw CSV parts -> clean corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import clean_text, long_enough, present
from siftwell.operators.dedup import dedup_clean_text
from siftwell.operators.profile import corpus_stats
from siftwell.session import TEXT_CODEC, spent_shuffles_removed, stage, unstage
from siftwell.sources.csv_parts import BODY_COLUMN, scan_csv_parts
from siftwell.sources.sinks import runs_in_order, sink_clean_parquet, sink_corpus_text


def clean_postings(raw: DataFrame, body: str = BODY_COLUMN) -> DataFrame:
    """Rows with a body whose clean text is long enough, with that text as ``clean_text``.

    The length test sits inside a generator: a plain filter would be pushed below the projection and
    clean every text a second time.
    """
    kept = F.filter(F.array(clean_text(F.col(body))), lambda text: long_enough(text))
    return raw.filter(present(F.col(body))).select("*", F.explode(kept).alias("clean_text"))


def _stage_cleaned(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written table, and its rows.

    Body and clean text lie side by side in one column: a codec finds most of the second in the first.
    """
    texts = F.array(BODY_COLUMN, "clean_text").alias("texts")
    others = [c for c in cleaned.columns if c not in (BODY_COLUMN, "clean_text")]
    staged = stage(cleaned.select(*others, texts), "cleaned", codec=TEXT_CODEC)
    unpacked = {BODY_COLUMN: F.col("texts")[0], "clean_text": F.col("texts")[1]}
    return staged, staged.withColumns(unpacked).select(*cleaned.columns)


def build_corpus(
    spark: SparkSession,
    paths: str | Sequence[str],
    corpus_path: str,
    clean_path: str,
    once_read: Callable[[], None] | None = None,
) -> DataFrame:
    """Write the corpus as text and as Parquet; returns the counts of each stage.

    Files are read and bodies cleaned once: the rows read are counted on the way, the cleaned rows are staged, and
    deduplication, both outputs and the counts start from written tables. Both outputs keep the order of the input:
    by path and row, over files in the order of their names.

    Disk is given back on the way: shuffle files when the step that wrote them has ended, the staged rows before the text
    is written. ``once_read`` is called when all rows read are staged: from then on the files of ``paths`` are not needed.
    """
    read = Observation()
    with spent_shuffles_removed(spark):
        counted = scan_csv_parts(spark, paths).observe(
            read, F.count("*").alias("n_rows"), F.coalesce(F.sum(F.length(BODY_COLUMN)), F.lit(0)).alias("n_chars")
        )
        staged, cleaned = _stage_cleaned(clean_postings(counted))
        if once_read is not None:
            once_read()
        sink_clean_parquet(dedup_clean_text(cleaned, in_order=True), clean_path)
        stats = corpus_stats({"cleaned": (cleaned, "clean_text")})
        before = [("read", read.get["n_rows"], read.get["n_chars"]), *stats.collect()]
        unstage(staged)
        written = spark.read.parquet(clean_path)
        for rows in runs_in_order(spark, clean_path, "clean_text"):
            sink_corpus_text(rows, corpus_path, mode="append")
        unique = corpus_stats({"unique": (written, "clean_text")})
        return stage(spark.createDataFrame(before, stats.schema).unionAll(unique), "corpus_stats")
