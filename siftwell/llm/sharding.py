"""Sharding by extendible hashing: shards are hash prefixes, split on one more bit only where they are too large."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.columns import free_name
from siftwell.session import stage, unstage

BITS = 60
#: Levels below the expected depth that are looked at in one round.
LEVELS = 6


def key_bits(key: Column) -> Column:
    """60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes, shard_docs) for rows (bits, n_bytes): where each cell of ``high`` bits belongs.

    The shard of a cell is its shortest prefix, of ``low`` to ``high`` bits, that holds at most ``limit`` bytes. Without
    such a prefix the depth is null. Rows are summed per cell first, so what is looked at for all depths are cells.
    """
    cells = rows.groupBy(F.shiftright("bits", BITS - high).alias("cell")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")
    )
    cells = stage(cells, "shard_cells")
    views = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)")
    )
    fits = (
        views.groupBy("depth", "prefix")
        .agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
        .where(F.col("shard_bytes") <= limit)
    )
    chosen = (
        views.join(fits, ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("shard"))
    )
    found = stage(cells.select("cell").join(chosen, "cell", "left").select("cell", "shard.*"), "shard_directory")
    unstage(cells)
    return found


def assign_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 16 << 20
) -> DataFrame:
    """``docs`` with ``shard`` (a string of bits), ``n_bytes`` (of the text in UTF-8), ``shard_bytes``, ``shard_docs``.

    A shard is the set of rows whose hashes begin with its bits. All rows of a key go to one shard as long as they fit
    into it. A key whose rows alone exceed ``limit`` (its 60 bits are used up) is split on the bits of a hash of its
    rows; such shards begin with ``r``. Only a single row, or rows equal in id and text, may exceed the limit. A null
    text has no bytes, a null id is a key like others. Columns of these names are replaced; an empty table stays empty.
    """
    docs = docs.drop("shard", "n_bytes", "shard_bytes", "shard_docs")
    size, key = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"), key_bits(F.col(doc_id))
    row_key = key_bits(F.concat_ws("\x00", F.col(doc_id).cast("string"), F.col(text)))
    bits, done = free_name(docs, "key_bits"), free_name(docs, "shard_of")
    left = docs.select(key.alias("bits"), size.alias("n_bytes"), row_key.alias("row_bits"))
    out = docs.withColumn("n_bytes", size).withColumn(done, F.lit(None).cast("struct<shard:string,b:long,n:long>"))
    for phase, kind in (("", key), ("r", row_key)):
        out = out.withColumn(bits, kind)
        low, high = 0, 0
        while high < BITS:
            total = left.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
            high = min(BITS, max(low, math.ceil(math.log2(max(1, total / limit)))) + LEVELS)
            directory = _directory(left.select("bits", "n_bytes"), low, high, limit)
            cell = F.shiftright("bits", BITS - high)
            stuck = directory.where("depth IS NULL").select(F.col("cell").alias("stuck"))
            last = high == BITS and phase == "r"
            name = F.concat(F.lit(phase), F.lpad(F.bin(F.coalesce("prefix", "cell")), F.coalesce("depth", F.lit(high)), "0"))
            name = F.when(F.coalesce("depth", F.lit(high)) == 0, F.lit(phase)).otherwise(name)
            named = directory.where(F.lit(last) | F.col("depth").isNotNull()).select(
                F.col("cell").alias("the_cell"), F.struct(name.alias("shard"), F.col("shard_bytes").alias("b"), F.col("shard_docs").alias("n")).alias("found")
            )
            at = F.when(F.col(done).isNull(), F.shiftright(bits, BITS - high))
            out = out.join(named, at == F.col("the_cell"), "left").withColumn(done, F.coalesce(done, "found"))
            out = out.drop("the_cell", "found")
            left = left.join(stuck, cell == F.col("stuck"), "left_semi")
            if last or not stuck.limit(1).count():
                left = None
                break
            low = high
        if left is None:
            break
        left = left.withColumn("bits", F.col("row_bits"))
    return out.select(
        *docs.columns, F.col(done)["shard"].alias("shard"), "n_bytes", F.col(done)["b"].alias("shard_bytes"),
        F.col(done)["n"].alias("shard_docs"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the rows of ``assign_shards`` below ``path``, one folder with one file for each shard."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = assign_shards(docs, **options).withColumn("shard", F.concat(F.lit("b"), F.col("shard")))
    named.repartition(n, "shard").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The rows of all shards."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.withColumn("shard", F.expr("substring(shard, 2)"))
