"""Registry and the inputs that several queries share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of a table's files for which there is a partition of its own.
PARTITION_BYTES = 4_000_000


def text_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to process, dealt out by its key: a file may be a single row group.

    Partitions become more with the table, not larger: what a task holds of it stays the same.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/{name}.parquet")
    parts = math.ceil((files.agg(F.sum("length")).first()[0] or 0) / PARTITION_BYTES)
    if parts <= spark.sparkContext.defaultParallelism:
        return table(spark, folder, name).repartition(key)
    return table(spark, folder, name).repartition(parts, key)


# The texts of ``documents`` hold nothing that cleaning would change, so noise is added by an
# expression that is the same in Spark and in SQL: (position in the cycle of 8, text expression).
NOISE = [
    "'ㆍ면접일정은 추후 통보됩니다.' || chr(10) || text",
    "'① 구직자는 알린다' || chr(10) || replace(text, ' the ', ' ' || chr(160) || 'the' || chr(12288))",
    "'( 1명 )' || chr(10) || '(１명)' || chr(10) || text || chr(10) || chr(9) || '포지션 및 자격요건 '",
    "text || chr(10) || '제 11 조 (채용서류의 반환) 본문' || chr(10) || '대통령령으로 정하는 바'",
    "replace(text, '. ', '.' || chr(13) || chr(10) || '·')",
    "'B2B ＭＤ ㎡ 4대보험' || chr(10) || replace(text, ', ', ',' || chr(9) || ' ')",
    "CASE WHEN length(text) % 5 = 0 THEN '학력 : 학력무관' || chr(10) || 'ㆍ경력 : 경력무관' ELSE text END",
]


def noisy_text(key: str = "doc_id") -> str:
    """SQL expression of a noisy body, valid in both engines."""
    cases = " ".join(f"WHEN {i + 1} THEN {expr}" for i, expr in enumerate(NOISE))
    return f"CASE {key} % 8 {cases} ELSE text END"


def noisy_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` with noise in ``body``."""
    # chr() is limited to Latin-1 in Spark, so the wide blank is written as a character
    expression = noisy_text().replace("chr(12288)", "'\u3000'")
    return text_table(spark, folder, "documents", "doc_id").withColumn("body", F.expr(expression))


NOISY = f"noisy AS (SELECT *, {noisy_text()} AS body FROM documents)"


def digest(col: Column) -> Column:
    """Texts are compared by hash."""
    return F.md5(col)
