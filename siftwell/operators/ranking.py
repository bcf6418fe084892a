"""Numbering, top-k and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import new_path, stage

PART_SIZE = 1000
HEAD_LINES = 5000


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark places a group limit before the shuffle, so every task sends at most ``k`` rows per group
    and a hot group stays small.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def longest_first(blocks: Column, length: str, index: str, k: int) -> Column:
    """The ``k`` longest structs of an array, ties by index; stays inside the row."""
    keyed = F.transform(
        blocks,
        lambda b: F.struct((-b.getField(length)).alias("n"), b.getField(index).alias("i"), b.alias("block")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s.getField("block"))


def head_lines(df: DataFrame, ord: str, n: int = HEAD_LINES) -> DataFrame:
    return df.orderBy(ord).limit(n)


def first_n_links(links: DataFrame, ord: str, n: int = 3) -> DataFrame:
    """The first ``n`` links; raises when there is none."""
    found = links.orderBy(ord).limit(n)
    if found.isEmpty():
        raise ValueError("no posting link found")
    return found


def number_rows(df: DataFrame, ord: str, start: int = 1, name: str = "idx") -> DataFrame:
    """Running number in the order of the unique column ``ord``.

    The rows are range-partitioned, sorted and written once to the shared folder. A row's number is
    its position in its file plus the rows of the files before, so no global window is needed.
    """
    spark = df.sparkSession
    path = new_path(spark, "numbered")
    df.repartitionByRange(F.col(ord)).sortWithinPartitions(ord).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    # one row per written file
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"), F.min(ord).alias("_first"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # written, so that Spark knows how short it is
    offsets = stage(files.select("_file", before.alias("_before")), "offsets")
    numbered = rows.join(offsets, "_file")
    return numbered.withColumn(name, F.col("_before") + F.col("_row") + start).drop(
        "_file", "_row", "_before"
    )


def part_of(idx: Column, size: int = PART_SIZE) -> Column:
    """1-based part of a 1-based running number."""
    return (F.floor((idx - 1) / size) + 1).cast("long")


def preview_head(df: DataFrame, columns: Sequence[str], ord: str, n: int = 30) -> DataFrame:
    return df.orderBy(ord).limit(n).select(*columns)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames with differing columns, duplicates kept; what is missing becomes null."""
    if not frames:
        raise ValueError("nothing to concatenate")
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
