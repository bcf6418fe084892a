"""Lines that many documents share are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.columns import BLANKS, ascii_lower, free_name
from siftwell.session import stage


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key_hash(line: Column) -> Column:
    """128 bits of the line's key; null for an empty key, which is never dropped."""
    key = F.btrim(ascii_lower(line), F.lit(BLANKS))
    return F.when(F.length(key) > 0, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b")))


def _hashes(text: str) -> Column:
    return F.transform(_lines(text), _key_hash)


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10) -> DataFrame:
    """Hashes (a, b) of the line keys that occur in at least ``min_docs`` documents."""
    return (
        docs.select(F.explode(F.array_distinct(_hashes(text))).alias("h"))
        .where("h IS NOT NULL")
        .groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_docs)
        .select("a", "b")
    )


def drop_frequent_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10) -> DataFrame:
    """``docs`` with ``text`` freed from frequent lines, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks at both ends and with A-Z lower-cased. Keys of at least one code point
    that occur in at least ``min_docs`` documents lose all their lines; the other lines stay as they are, in order.
    Every row counts as one document, also where rows repeat or share an id. A null or empty text is one empty line and
    stays null or empty. Columns named like the two counts are replaced; a table without rows gives one without rows.

    Lines are exploded as 128-bit hashes; texts are shuffled once, to meet the positions of their dropped lines.
    """
    docs = docs.drop("n_lines", "n_dropped")
    mark, hits = free_name(docs, "doc_mark"), free_name(docs, "hit_positions")
    # rows with equal marks have equal lines, so positions found for one hold for all
    marked = docs.withColumn(mark, F.xxhash64(F.col(doc_id), F.col(text)))
    # once written, its size is known: Spark broadcasts a short list, and splits hot lines in the join with a long one
    common = stage(frequent_lines(docs, text, min_docs), "frequent_lines")
    places = marked.select(
        F.col(doc_id).alias("d"), F.col(mark).alias("m"), F.posexplode(_hashes(text)).alias("p", "h")
    ).where("h IS NOT NULL").select("d", "m", "p", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    found = places.join(common, ["a", "b"], "left_semi").groupBy("d", "m").agg(F.collect_set("p").alias(hits))
    joined = marked.join(
        found, marked[doc_id].eqNullSafe(found["d"]) & (marked[mark] == found["m"]), "left"
    )
    lines = _lines(text)
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(hits))
    kept = F.array_join(F.transform(kept_at, lambda p: F.get(lines, p)), "\n")
    return joined.select(
        *(F.when(F.col(hits).isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else docs[c] for c in docs.columns),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.array_size(hits), F.lit(0)).cast("long").alias("n_dropped"),
    )
