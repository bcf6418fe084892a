"""Dealing rows to tasks in the order of an integer id, with the neighbour across every border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(docs: DataFrame, doc_id: str, tie: str, first_of_next: bool = False) -> DataFrame:
    """Rows sorted by (doc_id, tie) within partitions that follow each other; adds ``bucket`` and ``guest``.

    Borders are quantiles of the ids, so every partition has a like share of the rows; a null id comes first. With
    ``first_of_next``, the first row of the next partition that has rows also comes last in the one before it, marked
    as guest (after the last partition: the first). What reaches the driver are the borders and one id per partition.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    bounds = sorted(set(map(int, docs.select(doc_id).approxQuantile(doc_id, shares, 1 / (4 * n)))) if n > 1 else [])
    column = F.col(doc_id)
    bucket = F.lit(0)
    if bounds:
        below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= column))
        bucket = F.coalesce(below, F.lit(0))
    dealt = docs.withColumn("bucket", bucket)
    if first_of_next:
        found = dealt.groupBy("bucket").agg(F.min(F.struct(doc_id, tie)).alias("first")).collect()
        firsts = sorted((row["bucket"], row["first"][doc_id], row["first"][tie]) for row in found)
        before = [firsts[i - 1][0] for i in range(len(firsts))]
        kind = docs.schema[doc_id].dataType.simpleString()
        guests = docs.sparkSession.createDataFrame(
            [(*row, b) for row, b in zip(firsts, before)],
            f"bucket int, first_id {kind}, first_tie {docs.schema[tie].dataType.simpleString()}, before int",
        )
        # one row for each partition
        dealt = dealt.join(F.broadcast(guests), "bucket")
        is_first = column.eqNullSafe(F.col("first_id")) & F.col(tie).eqNullSafe(F.col("first_tie"))
        own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
        other = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
        places = F.when(is_first, F.array(own, other)).otherwise(F.array(own))
        dealt = dealt.withColumn("place", F.explode(places)).select(*docs.columns, "place.bucket", "place.guest")
    else:
        dealt = dealt.withColumn("guest", F.lit(False))
    return dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guest", doc_id, tie)
