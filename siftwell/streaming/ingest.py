"""New CSV parts are indexed as they arrive, instead of running over the whole folder again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.plans.index import filter_success, index_postings
from siftwell.session import shared_dir, stage, unstage
from siftwell.sources.csv_parts import BODY_COLUMN, RAW_COLUMNS, parse_csv_files


def index_new_parts(
    spark: SparkSession, source: str, folder: str, name: str = "index", checkpoint: str | None = None, **options
) -> StreamingQuery:
    """Index every part that appeared in ``source`` since the last call, then stop.

    Parts are streamed as whole files and parsed by their own headers, under the rules of ``scan_csv_parts``. The
    stream's checkpoint, in ``checkpoint`` or else in the shared folder, remembers the files taken; known URLs are
    skipped by the same join as in a batch run, so a micro-batch that is repeated after a failure adds nothing twice.
    """
    parts = spark.readStream.format("binaryFile").schema(_FILE).load(source)

    def index(batch: DataFrame, epoch: int) -> None:
        rows = parse_csv_files(batch, BODY_COLUMN, RAW_COLUMNS).filter("row > 0")
        rows = filter_success(rows).withColumn("ord", F.struct("path", "row")).drop("path", "row", "reason")
        staged = stage(rows, f"batch-{epoch}")
        index_postings(staged, folder, **options)
        unstage(staged)

    return (
        parts.writeStream.foreachBatch(index)
        .option("checkpointLocation", checkpoint or os.path.join(shared_dir(spark), f"siftwell-stream-{name}"))
        .trigger(availableNow=True)
        .start()
    )


# the columns of Spark's reader of whole files
_FILE = "path string, modificationTime timestamp, length long, content binary"
