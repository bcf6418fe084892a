"""Text corpora and vocabularies, one entry per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import strip
from siftwell.sources.csv_parts import file_order


def scan_corpus_lines(spark: SparkSession, path: str, ord: bool = True) -> DataFrame:
    """Stripped non-empty lines of a corpus as ``value``, with their order key."""
    lines = spark.read.option("lineSep", "\n").text(path)
    columns = [strip(F.col("value")).alias("value"), *([file_order().alias("ord")] if ord else [])]
    return lines.select(*columns).filter("value <> ''")


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file as (token, id); ids follow the lines.

    The file is written as one part and read without splitting.
    """
    lines = spark.read.text(path, wholetext=True)
    return lines.select(
        F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("id", "token")
    ).select("token", "id")
