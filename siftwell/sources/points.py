"""A point table in buckets: an upsert reads and rewrites only the buckets that hold incoming ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.vectors import upsert_points
from siftwell.session import stage, unstage

#: Buckets of a new table. At 100 TB each is some gigabytes in many files; an upsert of few points touches few of them.
BUCKETS = 1024
#: Rows in a file.
FILE_ROWS = 1_000_000

_LAYOUT = "_layout"


def _bucketed(points: DataFrame, key: str, buckets: int) -> DataFrame:
    """``bucket`` from the hash of the id; rows of a bucket come together, a large one in several tasks by its size."""
    return points.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")


def _write(rows: DataFrame, path: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy("bucket").parquet(path)


def create_points(points: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """A new table of points, unique by ``key``; the number of buckets and the key are written beside it."""
    _write(_bucketed(points, key, buckets), path)
    points.sparkSession.createDataFrame([(key, buckets)], "key string, buckets int").write.mode("overwrite").json(f"{path}/{_LAYOUT}")


def _layout(spark: SparkSession, path: str) -> tuple[str, int]:
    row = spark.read.schema("key string, buckets int").json(f"{path}/{_LAYOUT}").first()
    return row["key"], row["buckets"]


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_into(path: str, incoming: DataFrame, latest: str | None = None) -> int:
    """Incoming points replace those of the same id or are added; returns the number of buckets written anew.

    Of incoming points with the same id the one with the largest ``latest`` stays, else that with the largest hash. The new
    rows of the touched buckets are written to the shared folder first, so a lost executor or a second attempt finds all old
    rows still in place; then these buckets are exchanged. All other files stay as they are. An empty input touches nothing.
    """
    spark = incoming.sparkSession
    key, buckets = _layout(spark, path)
    arriving = stage(_bucketed(incoming, key, buckets), "incoming_points")
    # at most as many as there are buckets
    touched = [r["bucket"] for r in arriving.select("bucket").distinct().collect()]
    if touched:
        current = spark.read.parquet(path)
        current = current.where(F.col("bucket").isin(touched)).select(*incoming.columns, "bucket")
        merged = stage(upsert_points(current.drop("bucket"), arriving.drop("bucket"), key, latest), "merged_points")
        _write(_bucketed(merged, key, buckets), path)
        unstage(merged)
    unstage(arriving)
    return len(touched)
