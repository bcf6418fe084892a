"""Sparse ranking, roll-up, fusion and evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.tokens import pretokenize
from siftwell.operators.ranking import top_k_per_group
from siftwell.operators.vectors import CANDIDATES, SCORE_CELLS, SCORE_DIGITS, SEARCH_LIMIT, _Best
from siftwell.session import stage

# The usual BM25 parameters and the usual rank constant of reciprocal rank fusion.
BM25_K1 = 1.2
BM25_B = 0.75
RRF_CONSTANT = 60

# terms of queries that are sent to the tasks at a time
BLOCK_TERMS = 200_000
# postings that a task scores at a time
BATCH_POSTINGS = 200_000
# postings that a task sorts by document
TASK_POSTINGS = 400_000


def _by_score() -> list[Column]:
    return [F.desc("score"), F.col("doc_id")]


def term_weights(df: DataFrame, key: str, text: str, alias: str) -> DataFrame:
    """Sparse vectors (key, term, weight) with the number of occurrences as weight.

    All words of a text sit in one task, so the map-side combine already makes them distinct.
    """
    words = df.select(F.col(key).alias(alias), F.explode(pretokenize(F.col(text))).alias("term"))
    return words.groupBy(alias, "term").agg(F.count("*").cast("double").alias("weight"))


def _term_blocks(asked: DataFrame, block_terms: int) -> Iterator[_TermBlock]:
    """The queries (query_id, term, value) in blocks of about ``block_terms`` rows; a query stays whole."""
    rows, last = [], None
    for row in asked.orderBy("query_id").toLocalIterator():
        if len(rows) >= block_terms and row.query_id != last:
            yield _TermBlock(rows)
            rows = []
        rows.append((row.query_id, row.term, row.value))
        last = row.query_id
    if rows:
        yield _TermBlock(rows)


class _TermBlock:
    """Inverted lists of some queries: for each term, who asks for it and with which value."""

    def __init__(self, rows: list[tuple[int, str, float]]):
        self.query_ids = np.unique([q for q, _, _ in rows])
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for _, t, _ in rows))}
        term = np.array([self.terms[t] for _, t, _ in rows])
        order = np.argsort(term, kind="stable")
        self.query = np.searchsorted(self.query_ids, [q for q, _, _ in rows])[order]
        self.value = np.array([v for _, _, v in rows], dtype=float)[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def places(self, terms: pa.Array) -> np.ndarray:
        """Number of each term in this block; -1 for what nobody asks for."""
        words = terms.dictionary_encode()
        known = np.array([self.terms.get(t, -1) for t in words.dictionary.to_pylist()] or [-1])
        return known[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)

    def score(self, best: _Best, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Offers the dot products of documents given as (row of ``doc_ids``, term, weight), sorted by row."""
        step = max(1, SCORE_CELLS // len(self.query_ids))
        for lo in range(0, len(doc_ids), step):
            a, b = np.searchsorted(doc, [lo, lo + step])
            if a == b:
                continue
            shape = (min(step, len(doc_ids) - lo), len(self.query_ids))
            n = self.start[term[a:b] + 1] - self.start[term[a:b]]
            ends = np.cumsum(n)
            at = np.repeat(self.start[term[a:b]] - (ends - n), n) + np.arange(ends[-1])
            cell = np.repeat(doc[a:b] - lo, n) * shape[1] + self.query[at]
            total = np.bincount(cell, np.repeat(weight[a:b], n) * self.value[at], minlength=shape[0] * shape[1])
            hit = np.bincount(cell, minlength=shape[0] * shape[1]) > 0
            scores = np.where(hit, np.round(total, SCORE_DIGITS), -np.inf).reshape(shape).T
            touched = np.flatnonzero(hit.reshape(shape).any(axis=1))
            best.offer(scores[:, touched], doc_ids[lo + touched])


def _ranked(asked: DataFrame, documents: DataFrame, k: int, block_terms: int, weigh) -> DataFrame:
    """The ``k`` best of ``documents`` (doc_id, terms, ...) for the queries; ``weigh`` reads a batch's term weights.

    Each block of queries is sent to the tasks, which score their own documents and keep ``k`` for each query: what is
    shuffled are tasks x queries x ``k`` rows, however common a term is.
    """
    spark, candidates = documents.sparkSession, None
    for block in _term_blocks(asked, block_terms):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Best(shared.value.query_ids, k)
            for batch in batches:
                shared.value.score(best, batch.column("doc_id").to_numpy(), *weigh(shared.value, batch))
            yield best.batch(None)

        found = documents.mapInArrow(search, CANDIDATES)
        candidates = found if candidates is None else candidates.unionAll(found)
    return _top(spark, candidates, k)


def _top(spark: SparkSession, candidates: DataFrame | None, k: int) -> DataFrame:
    if candidates is None:
        candidates = spark.createDataFrame([], CANDIDATES)
    return top_k_per_group(candidates, ["query_id"], _by_score(), k).select("query_id", "doc_id", "score", "rank")


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    """For every entry of the lists, the row it belongs to."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document in batches of about ``BATCH_POSTINGS``, none of which parts a document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH_POSTINGS:
            rows = pa.concat_batches(held)
            ids = rows.column("doc_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield rows.slice(0, cut)
            held = [rows.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def sparse_topk(
    query_terms: DataFrame, postings: DataFrame, k: int = SEARCH_LIMIT, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """Highest dot products of (query_id, term, weight) with (doc_id, term, weight).

    Postings of terms that nobody asks for are left out before the others are dealt by document; a task reads them in
    that order, so it holds some documents at a time. They are counted first, since more of them are dealt to more tasks
    and not to larger ones: postings that are costly to make should be staged.
    """
    asked = query_terms.select("query_id", "term", F.col("weight").cast("double").alias("value"))
    terms = stage(asked.select("term").distinct(), "asked_terms")
    rows = postings.select(F.col("doc_id").cast("long").alias("doc_id"), "term", F.col("weight").cast("double").alias("weight"))
    wanted = rows.join(terms, "term", "left_semi")
    parts = max(1, math.ceil(wanted.count() / TASK_POSTINGS))
    dealt = wanted.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    spark, candidates = postings.sparkSession, None
    for block in _term_blocks(asked, block_terms):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Best(shared.value.query_ids, k)
            for batch in _whole_documents(batches):
                place = shared.value.places(batch.column("term"))
                doc_ids, row = np.unique(batch.column("doc_id").to_numpy(), return_inverse=True)
                known = place >= 0
                shared.value.score(best, doc_ids, row[known], place[known], batch.column("weight").to_numpy()[known])
            yield best.batch(None)

        found = dealt.mapInArrow(search, CANDIDATES)
        candidates = found if candidates is None else candidates.unionAll(found)
    return _top(spark, candidates, k)


def bm25_topk(
    queries: DataFrame,
    documents: DataFrame,
    k: int = SEARCH_LIMIT,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    text: str = "text",
    k1: float = BM25_K1,
    b: float = BM25_B,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """BM25 over the words of a text; a repeated query word counts once.

    One aggregate gives document counts and lengths: words are made distinct inside each row, and an empty word per
    document carries its length. Documents are then scored in place, without a shuffle.
    """
    asked = queries.select(
        F.col(query_id).cast("long").alias("query_id"), F.explode(F.array_distinct(pretokenize(F.col(text)))).alias("term")
    )
    # a filter on the words would be pushed below a shuffle of the documents, and split every text twice
    known = documents.where(F.col(text).isNotNull())
    words = known.select(F.col(doc_id).cast("long").alias("doc_id"), pretokenize(F.col(text)).alias("terms"))
    distinct = words.select(
        F.array_size("terms").alias("dl"), F.explode(F.array_append(F.array_distinct("terms"), F.lit(""))).alias("term")
    )
    counts = stage(distinct.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")), "term_counts")
    n_docs, length = counts.filter("term = ''").select("df", "dl").first() or (0, 0)
    mean_size = length / n_docs if n_docs and length else 1.0
    idf = F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(counts, "term").select("query_id", "term", idf.alias("value"))

    def weigh(block: _TermBlock, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        terms = batch.column("terms")
        place, row = block.places(terms.flatten()), _rows_of(terms)
        size = np.diff(terms.offsets.to_numpy())
        key, tf = np.unique((row * len(block.terms) + place)[place >= 0], return_counts=True)
        row, place = key // len(block.terms), key % len(block.terms)
        return row, place, tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean_size))

    return _ranked(weighted, words, k, block_terms, weigh)


def min_max(run: DataFrame) -> DataFrame:
    """Adds the score scaled to 0..1 within each query; equal scores give 1."""
    window = Window.partitionBy("query_id")
    low, high = F.min("score").over(window), F.max("score").over(window)
    return run.withColumn("scaled", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def hybrid_fuse(
    dense: DataFrame,
    sparse: DataFrame,
    k: int = SEARCH_LIMIT,
    method: str = "weighted",
    dense_weight: float = 0.5,
    rrf_constant: int = RRF_CONSTANT,
) -> DataFrame:
    """Combine two runs (query_id, doc_id, score, rank) of bounded depth.

    ``weighted`` adds min-max scaled scores, ``rrf`` adds reciprocal ranks; a document missing from a
    run adds nothing for it.
    """
    if method == "weighted":
        value, weights = F.col("scaled"), (dense_weight, 1 - dense_weight)
        dense, sparse = min_max(dense), min_max(sparse)
    elif method == "rrf":
        value, weights = 1.0 / (F.col("rank") + rrf_constant), (1.0, 1.0)
    else:
        raise ValueError(f"unknown method {method}")
    a = dense.select("query_id", "doc_id", (value * weights[0]).alias("a"))
    b = sparse.select("query_id", "doc_id", (value * weights[1]).alias("b"))
    score = F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), SCORE_DIGITS)
    fused = a.join(b, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", score.alias("score"))
    return top_k_per_group(fused, ["query_id"], _by_score(), k)


def mask_terms(postings: DataFrame, masked: DataFrame, factor: float = 0.0) -> DataFrame:
    """Multiply the weight of listed terms by ``factor``; a weight of zero leaves the vector.

    The list is written first: a short one is then broadcast, and the skew join splits a common term otherwise.
    """
    listed = stage(masked.select("term").distinct().withColumn("_masked", F.lit(True)), "masked")
    damped = F.when(F.col("_masked"), F.col("weight") * factor).otherwise(F.col("weight"))
    joined = postings.join(listed, "term", "left").withColumn("weight", damped).drop("_masked")
    return joined.filter("weight <> 0")


def retrieval_metrics(run: DataFrame, qrels: DataFrame, ndcg_depth: int = 10, recall_depth: int = 50) -> DataFrame:
    """nDCG, recall and reciprocal rank per query that has a relevant document.

    ``run`` is (query_id, doc_id, rank), ``qrels`` is (query_id, doc_id, rel) with 0 for irrelevant.
    """
    relevant = qrels.filter("rel > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))
    gain = lambda rank: F.col("rel") / F.log2(rank + 1.0)
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    ideal = (
        relevant.withColumn("ideal", ideal_rank)
        .filter(F.col("ideal") <= ndcg_depth)
        .groupBy("query_id")
        .agg(F.sum(gain(F.col("ideal"))).alias("idcg"))
    )
    found = run.join(relevant, ["query_id", "doc_id"])
    rank = F.col("rank")
    per_query = found.groupBy("query_id").agg(
        F.sum(F.when(rank <= ndcg_depth, gain(rank))).alias("dcg"),
        F.count(F.when(rank <= recall_depth, 1)).alias("hits"),
        F.min(rank).alias("first"),
    )
    zero = F.lit(0.0)
    return (
        totals.join(ideal, "query_id")
        .join(per_query, "query_id", "left")
        .select(
            "query_id",
            F.round(F.coalesce(F.col("dcg") / F.col("idcg"), zero), SCORE_DIGITS).alias("ndcg"),
            F.round(F.coalesce(F.col("hits") / F.col("n_relevant"), zero), SCORE_DIGITS).alias("recall"),
            F.round(F.coalesce(1.0 / F.col("first"), zero), SCORE_DIGITS).alias("mrr"),
        )
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        *[F.round(F.avg(c), SCORE_DIGITS).alias(c) for c in ("ndcg", "recall", "mrr")], F.count("*").alias("n_queries")
    )
