"""A BM25 index that is built once and asked many times: impact-ordered postings in blocks with their maxima.

A row is a block of postings of one term, with the documents, what the term adds to the score of each (its impact), and the
largest impact (top). The postings of a term are dealt to shards by document, ordered by impact within each, and cut into
blocks, so a common term has many blocks of which few have a large top. Files lie in folders by a hash of the term and are
sorted by term, so a reader opens the folders of the terms asked for, and of the blocks first only their tops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.tokens import pretokenize
from siftwell.operators.ranking import top_k_per_group
from siftwell.operators.retrieval import BM25_B, BM25_K1, sparse_topk
from siftwell.operators.vectors import SEARCH_LIMIT
from siftwell.session import stage, unstage

#: Folders of an index, postings of a term in one shard, and postings in a block.
BUCKETS, SHARD_POSTINGS, BLOCK_POSTINGS = 64, 32_768, 128
#: Postings that a task sorts.
TASK_POSTINGS = 1_000_000
#: By how much a bound may be too low: sums are rounded.
SLACK = 1e-6

_BLOCK = "bucket int, term string, shard long, block int, top double, docs array<long>, impacts array<double>"


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def _blocks(n_docs: int, mean: float, k1: float, b: float):
    """Blocks of the lists of a task; rows come sorted by term and shard, and one list is held at a time besides a batch."""

    def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
        starts = _list_starts(rows)
        sizes = np.diff(np.append(starts, rows.num_rows))
        # a list that is not dealt to shards holds all documents of its term
        df = np.where(rows.column("df").is_null().to_numpy(zero_copy_only=False), np.repeat(sizes, sizes), rows.column("df").fill_null(0).to_numpy())
        tf, dl, docs = (rows.column(c).to_numpy() for c in ("tf", "dl", "doc_id"))
        impact = np.log1p((n_docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
        order = np.lexsort((docs, -impact, np.repeat(np.arange(len(starts)), sizes)))
        place = np.arange(rows.num_rows) - np.repeat(starts, sizes)
        heads = np.flatnonzero(place % BLOCK_POSTINGS == 0)
        offsets = pa.array(np.append(heads, rows.num_rows), pa.int32())
        named = rows.select(["bucket", "term", "shard"]).take(pa.array(heads))
        return pa.RecordBatch.from_arrays(
            [
                *named.columns, pa.array(place[heads] // BLOCK_POSTINGS, pa.int32()), pa.array(impact[order][heads]),
                pa.ListArray.from_arrays(offsets, pa.array(docs[order])), pa.ListArray.from_arrays(offsets, pa.array(impact[order])),
            ],
            names=["bucket", "term", "shard", "block", "top", "docs", "impacts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            last = int(_list_starts(held)[-1])
            if last:
                yield cut(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield cut(held)

    return run


def _list_starts(rows: pa.RecordBatch) -> np.ndarray:
    term = rows.column("term").dictionary_encode().indices.to_numpy()
    shard = rows.column("shard").to_numpy()
    return np.append(0, np.flatnonzero((term[1:] != term[:-1]) | (shard[1:] != shard[:-1])) + 1)


def build_bm25_index(
    documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", k1: float = BM25_K1, b: float = BM25_B
) -> None:
    """Writes the index of ``documents``, whose ids are unique; null texts are left out, empty ones count for the statistics.

    Postings are counted within their document's row and shuffled once, by ranges of bucket, term and shard; a term that
    stands in every document has as many shards as its postings need, so no task holds more than one of them.
    """
    words = documents.select(F.col(doc_id).cast("long").alias("doc_id"), pretokenize(F.col(text)).alias("terms"))
    each = words.select("doc_id", F.array_size("terms").alias("dl"), F.explode("terms").alias("term"))
    postings = stage(each.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    n_docs = documents.where(F.col(text).isNotNull()).count()
    sizes = postings.agg(F.sum("tf").alias("words"), F.count("*").alias("rows")).first()
    mean = (sizes["words"] or 0) / max(1, n_docs) or 1.0
    many = postings.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") > SHARD_POSTINGS)
    shard = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / SHARD_POSTINGS)), F.lit(0).cast("long"))
    # at most one row for each full shard
    dealt = postings.join(F.broadcast(stage(many, "many")), "term", "left").select(
        _bucket(F.col("term")), "term", shard.alias("shard"), "df", "doc_id", "tf", F.col("dl").cast("long").alias("dl")
    )
    keys = ["bucket", "term", "shard"]
    n = max(documents.sparkSession.sparkContext.defaultParallelism, -(-sizes["rows"] // TASK_POSTINGS))
    sorted_ = dealt.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    rows = sorted_.mapInArrow(_blocks(n_docs, mean, k1, b), _BLOCK)
    rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(path)
    unstage(postings)


def _sums(blocks: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) from blocks that are asked for."""
    each = blocks.select("query_id", F.explode(F.arrays_zip("docs", "impacts")).alias("p"))
    return each.groupBy("query_id", F.col("p.docs").alias("doc_id")).agg(F.sum("p.impacts").alias("score"))


def needed_blocks(spark: SparkSession, path: str, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, bucket, term, shard, block) of the blocks that can hold a posting of one of the ``k`` best.

    ``asked`` is a written table (query_id, bucket, term). The first block of every shard gives some documents a part of their score, and
    the k-th largest such part is a score that the k best reach. A document in a block of term t has at most the block's top
    and the largest tops of the query's other terms. If that is below, no posting of the block belongs to one of the k best,
    so leaving such blocks out leaves the scores of the k best whole.
    """
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
    index = spark.read.parquet(path).where(F.col("bucket").isin(buckets))
    first = index.where("block = 0").join(asked, ["bucket", "term"])
    floor = top_k_per_group(_sums(first), ["query_id"], [F.desc("score"), F.col("doc_id")], k).where(F.col("rank") == k)
    tops = index.where("block = 0").groupBy("bucket", "term").agg(F.max("top").alias("most"))
    terms = stage(asked.join(tops, ["bucket", "term"]), "asked_tops")
    bound = terms.groupBy("query_id").agg(F.sum("most").alias("all"))
    bound = bound.join(floor.select("query_id", F.col("score").alias("floor")), "query_id", "left")
    least = F.coalesce("floor", F.lit(0.0)) - (F.col("all") - F.col("most")) - SLACK
    wanted = terms.join(bound, "query_id").select("query_id", "bucket", "term", least.alias("least"))
    tops_only = index.select("bucket", "term", "shard", "block", "top")
    return tops_only.join(wanted, ["bucket", "term"]).where("top >= least").select("query_id", "bucket", "term", "shard", "block", "top")


def bm25_index_topk(
    spark: SparkSession, path: str, queries: DataFrame, k: int = SEARCH_LIMIT, query_id: str = "query_id", text: str = "text"
) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best of the index at ``path``, as ``bm25_topk`` of the documents themselves.

    A repeated query word counts once. Postings are read only from the blocks that can matter, and from no folder and below
    no top that none of them has. A block is read once for all queries; its postings are dealt by document and scored there.
    """
    words = F.explode(F.array_distinct(pretokenize(F.col(text)))).alias("term")
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), words).select("query_id", _bucket(F.col("term")), "term")
    asked = stage(asked.distinct(), "asked")
    blocks = stage(needed_blocks(spark, path, asked, k), "needed_blocks")
    least = blocks.agg(F.min("top").alias("top"), F.collect_set("bucket").alias("buckets")).first()
    index = spark.read.parquet(path).where(F.col("bucket").isin(least["buckets"]) & (F.col("top") >= F.lit(least["top"])))
    once = blocks.select("bucket", "term", "shard", "block").distinct()
    found = index.drop("top").join(once, ["bucket", "term", "shard", "block"], "left_semi")
    postings = found.select("term", F.explode(F.arrays_zip("docs", "impacts")).alias("p"))
    postings = postings.select(F.col("p.docs").alias("doc_id"), "term", F.col("p.impacts").alias("weight"))
    return sparse_topk(asked.select("query_id", "term", F.lit(1.0).alias("weight")), postings, k)
