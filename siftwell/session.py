"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are designed for; everything else is left to the cluster.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lets AQE replace a sort-merge join by a hash join where every partition of one side is small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "siftwell", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the recommended settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of whole texts: of each task, the JVM and Python hold one at a time.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session end at about ``BATCH_BYTES``; a text longer than that stays whole."""
    spark.conf.set(ARROW_BATCH, BATCH_BYTES)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The same for what runs inside; then the session has its own setting again."""
    before = spark.conf.get(ARROW_BATCH)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BATCH, before)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def spent_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it has ended, not when the driver's garbage collector finds them unused."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as named in ``spark.checkpoint.dir``.

    Only a local-mode session may go without it; there a fresh temporary folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="siftwell-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return os.path.join(shared_dir(spark), f"siftwell-{uuid.uuid4().hex}", name)


#: For large tables of texts: at a third less disk than the default.
TEXT_CODEC = "zstd"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, compressed by ``codec`` or as the session says, and read it back.

    Cuts the lineage at a table that survives the loss of executors, so that a costly
    input is computed once however many branches use it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec) if codec else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later result reads."""
    for df in tables:
        discard(df.sparkSession, df.staged_path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path that ``new_path`` gave."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
