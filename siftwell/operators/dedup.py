"""First-wins deduplication and key lookups between postings.

Bodies are compared by a 256-bit hash. Only (hash, order key) pairs are grouped, with map-side
combine, so a text that makes up a third of all rows costs one partial row per task. The surviving
order keys are unique and evenly spread, which keeps the join back free of skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import present, strip


def content_key(col: Column) -> Column:
    return F.unhex(F.sha2(col, 256))


def keep_first(df: DataFrame, key: Column, ord: str, in_order: bool = False) -> DataFrame:
    """Rows with the smallest ``ord`` for their key. ``ord`` has to be unique per row.

    With ``in_order`` they come sorted by ``ord``, over the partitions and within them. Rows and surviving order keys then
    meet in the ranges of ``ord`` that the sort needs anyway, so the bodies are still shuffled once.
    """
    winners = df.select(key.alias("_key"), F.col(ord)).groupBy("_key").agg(F.min(ord).alias(ord)).select(ord)
    if not in_order:
        return df.join(winners, ord, "left_semi")
    # longer than the name of any column, so none of them
    mark, first = (prefix + max(df.columns, key=len) for prefix in ("mark_", "first_"))
    rows, marks = df.withColumn(mark, F.lit(False)), winners.withColumn(mark, F.lit(True))
    met = rows.unionByName(marks, allowMissingColumns=True).repartitionByRange(ord)
    met = met.withColumn(first, F.max(F.col(f"`{mark}`")).over(Window.partitionBy(ord)))
    met = met.filter(F.col(f"`{first}`") & ~F.col(f"`{mark}`")).sortWithinPartitions(ord)
    return met.select(ord, *[F.col(f"`{c}`") for c in df.columns if c != ord])


def dedup_clean_text(df: DataFrame, text: str = "clean_text", ord: str = "ord", in_order: bool = False) -> DataFrame:
    return keep_first(df, content_key(F.col(text)), ord, in_order)


def distinct_raw_text(df: DataFrame, text: str, ord: str) -> DataFrame:
    """First occurrence of every non-blank raw body."""
    body = df.filter(present(strip(F.col(text))))
    return keep_first(body, content_key(F.col(text)), ord)


def dedup_url_first(df: DataFrame, url: str = "url", ord: str = "ord") -> DataFrame:
    return keep_first(df, content_key(F.col(url)), ord)


def new_postings_anti(incoming: DataFrame, existing: DataFrame, url: str = "url", ord: str = "ord") -> DataFrame:
    """First incoming row of every URL the target does not hold yet.

    URLs are made unique before they are looked up, so both sides of the anti join hold a URL once, and
    the bodies are shuffled once, by ``ord``.
    """
    firsts = incoming.filter(F.col(url).isNotNull()).select(content_key(F.col(url)).alias("_key"), ord)
    firsts = firsts.groupBy("_key").agg(F.min(ord).alias(ord))
    known = existing.select(content_key(F.col(url)).alias("_key"))
    return incoming.join(firsts.join(known, "_key", "left_anti").select(ord), ord, "left_semi")


def chunk_to_posting(chunks: DataFrame, postings: DataFrame, chunk_key: str, posting_key: str) -> DataFrame:
    """Chunks with the columns of their posting."""
    return chunks.join(postings, chunks[chunk_key] == postings[posting_key], "inner")


def cascade_chunks(chunks: DataFrame, surviving: DataFrame, chunk_key: str, posting_key: str) -> DataFrame:
    """Chunks whose posting still exists."""
    return chunks.join(surviving.select(F.col(posting_key).alias(chunk_key)), chunk_key, "left_semi")


def zip_chunks_vectors(chunks: Column, vectors: Column) -> Column:
    """Array of (text, vector) pairs, cut to the shorter side."""
    size = F.least(F.size(chunks), F.size(vectors))
    return F.arrays_zip(
        F.slice(chunks, F.lit(1), size).alias("chunk_text"), F.slice(vectors, F.lit(1), size).alias("vector")
    )
