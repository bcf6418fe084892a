"""Counts over postings, lines, words and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import present, stripped_lines
from siftwell.operators.dedup import content_key


def corpus_stats(stages: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and characters of each named stage, given as (frame, text column)."""
    parts = [
        df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars")).select(
            F.lit(name).alias("stage"), "n_rows", "n_chars"
        )
        for name, (df, text) in stages.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def whitespace_tokens(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"\S+"))


def corpus_profile(df: DataFrame, text: str) -> DataFrame:
    """Rows, bodies present, unique bodies, and sizes measured over the unique bodies."""
    body = F.when(present(F.col(text)), F.col(text))
    # one row per distinct body, and one for all missing ones, whose key and sizes are null
    unique = (
        df.select(
            content_key(body).alias("key"),
            F.length(body).cast("long").alias("chars"),
            whitespace_tokens(body).cast("long").alias("tokens"),
        )
        .groupBy("key")
        .agg(F.count("*").alias("copies"), F.max("chars").alias("chars"), F.max("tokens").alias("tokens"))
    )
    zero = F.lit(0)
    return unique.agg(
        F.coalesce(F.sum("copies"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("copies"))), zero).alias("n_bodies"),
        F.count("key").alias("n_unique"),
        F.coalesce(F.sum("chars"), zero).alias("n_chars"),
        F.coalesce(F.sum("tokens"), zero).alias("n_tokens"),
        F.avg("chars").alias("mean_chars"),
    )


def exploded_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per non-empty stripped line, with its position in the body."""
    return df.select(*keep, F.posexplode(stripped_lines(F.col(text))).alias("line_no", "line")).filter("line <> ''")


def top_repeated_lines(df: DataFrame, text: str, k: int) -> DataFrame:
    counts = exploded_lines(df, text).groupBy("line").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "line").limit(k)


def lines_in_share(df: DataFrame, text: str, share: float) -> DataFrame:
    """Lines found in at least ``share`` of the documents, with their document counts.

    Lines are made distinct inside each row, so counting documents needs no DISTINCT shuffle. The
    result has at most (mean distinct lines per document) / ``share`` rows.
    """
    lines = df.select(F.explode(F.array_distinct(stripped_lines(F.col(text)))).alias("line")).filter("line <> ''")
    counts = lines.groupBy("line").agg(F.count("*").alias("n_docs"))
    total = df.agg(F.count("*")).scalar()
    return counts.filter(F.col("n_docs") >= total * F.lit(share))


def lines_not_listed(lines: DataFrame, listed: DataFrame, line: str = "line") -> DataFrame:
    """Line rows whose text is not in ``listed``.

    No broadcast is forced: AQE broadcasts the list when its measured size allows it, and splits the
    partition of a hot line otherwise.
    """
    return lines.join(listed.select(line).distinct(), line, "left_anti")


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    return df.groupBy(outcome).agg(F.count("*").alias("n"))


def count_per_parent(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): how many rows of ``children`` each of ``parents`` has, 0 included.

    Children are counted before they meet their parents, so a parent with very many of them is no hot key.
    """
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.select(key).distinct().join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def links_per_page(pages: DataFrame, links: DataFrame, page: str) -> DataFrame:
    return count_per_parent(pages, links, page, "n_links")


def text_lengths(df: DataFrame, *columns: str) -> DataFrame:
    """Adds ``<column>_length`` for every named text column; a missing text counts as 0."""
    return df.withColumns({f"{c}_length": F.coalesce(F.length(c), F.lit(0)).cast("long") for c in columns})


def chunks_per_posting(postings: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    return count_per_parent(postings, chunks, key, "n_chunks")
