"""Retrieval over dense and sparse vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import chunking as C
from siftwell.operators import retrieval as R
from siftwell.operators import stored_index as S
from siftwell.operators import vectors as V
from siftwell.queries import sql
from siftwell.queries.registry import query, table, text_table
from siftwell.queries.token_queries import hashed_sql
from siftwell.session import new_path, stage

DIMENSION = 256

TOP_DENSE = """ranked AS (SELECT query_id, doc_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)"""

_COSINE = """scores AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings q, embeddings d)"""


def _embeddings(spark, folder):
    return text_table(spark, folder, "embeddings", "vec_id")


@query("dense_topk", f"WITH {_COSINE}, {TOP_DENSE} SELECT * FROM ranked WHERE rank <= 5")
def dense(spark, folder):
    """Every vector asks for its five nearest, itself among them."""
    rows = _embeddings(spark, folder).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return V.dense_topk(rows.withColumnRenamed("doc_id", "query_id"), rows)


_DOC_TERMS = f"""doc_terms AS (SELECT doc_id, term, count(*) AS weight FROM
    (SELECT doc_id, unnest({sql.words('text')}) AS term FROM documents) GROUP BY ALL)"""
_QUERY_TERMS = f"""query_terms AS (SELECT item_id AS query_id, term, count(*) AS weight FROM
    (SELECT item_id, unnest({sql.words('text')}) AS term FROM benchmark) GROUP BY ALL)"""


def _questions(spark, folder):
    return table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")


def _documents(spark, folder):
    return text_table(spark, folder, "documents", "doc_id").select("doc_id", "text")


@query(
    "sparse_topk",
    f"""WITH {_DOC_TERMS}, {_QUERY_TERMS}, scores AS (
        SELECT query_id, doc_id, round(CAST(sum(q.weight * d.weight) AS DOUBLE), 6) AS score
        FROM query_terms q JOIN doc_terms d USING (term) GROUP BY ALL), {TOP_DENSE}
    SELECT * FROM ranked WHERE rank <= 5""",
)
def sparse(spark, folder):
    asked = R.term_weights(_questions(spark, folder), "query_id", "text", "query_id")
    held = stage(R.term_weights(_documents(spark, folder), "doc_id", "text", "doc_id"), "doc_terms")
    return R.sparse_topk(asked, held)


def bm25_sql(depth: int) -> str:
    return f"""doc_words AS (SELECT doc_id, {sql.words('text')} AS w FROM documents),
    sizes AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM doc_words),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM doc_words) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    asked AS (SELECT DISTINCT item_id AS query_id, unnest({sql.words('text')}) AS term FROM benchmark),
    bm25_scores AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
        FROM asked JOIN df USING (term) JOIN tf USING (term), sizes GROUP BY query_id, doc_id),
    bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
        FROM bm25_scores) WHERE rank <= {depth})"""


def _bm25(spark, folder, depth):
    return R.bm25_topk(_questions(spark, folder), _documents(spark, folder), depth)


@query("bm25_topk", f"WITH {bm25_sql(5)} SELECT * FROM bm25")
def bm25(spark, folder):
    return _bm25(spark, folder, 5)


@query("bm25_index_topk", f"WITH {bm25_sql(5)} SELECT * FROM bm25")
def bm25_stored(spark, folder):
    """The same from an index that is built once; all items ask it."""
    path = new_path(spark, "bm25_index")
    S.build_bm25_index(_documents(spark, folder), path)
    return S.bm25_index_topk(spark, path, _questions(spark, folder))


def hashed_run_sql(depth: int) -> str:
    """Cosine of hashed document and query vectors."""
    return f"""dv AS ({hashed_sql('documents', 'doc_id', DIMENSION)}), qv AS ({hashed_sql('benchmark', 'item_id', DIMENSION)}),
    dense_scores AS (SELECT item_id AS query_id, doc_id, round(sum(qv.weight * dv.weight), 6) AS score
        FROM qv JOIN dv USING (bucket) GROUP BY ALL),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
        FROM dense_scores) WHERE rank <= {depth})"""


def _hashed(df):
    """Vectors of doubles, so that rounded cosines agree with SQL."""
    return C.embed_chunks(df, "text", C.hashing_embedder(DIMENSION), dtype="double")


def _hashed_run(spark, folder, depth):
    return V.dense_topk(_hashed(_questions(spark, folder)), _hashed(_documents(spark, folder)), depth)


_SCALED = """(score - min(score) OVER (PARTITION BY query_id)) / nullif(max(score) OVER (PARTITION BY query_id)
    - min(score) OVER (PARTITION BY query_id), 0)"""


def _fused_sql(a: str, b: str) -> str:
    return f"""WITH {hashed_run_sql(50)}, {bm25_sql(50)},
    a AS (SELECT query_id, doc_id, {a} AS a FROM dense), b AS (SELECT query_id, doc_id, {b} AS b FROM bm25),
    scores AS (SELECT query_id, doc_id, round(coalesce(a, 0) + coalesce(b, 0), 6) AS score
        FROM a FULL OUTER JOIN b USING (query_id, doc_id)), {TOP_DENSE}
    SELECT * FROM ranked WHERE rank <= 5"""


@query("hybrid_fuse", _fused_sql(f"0.4 * coalesce({_SCALED}, 1)", f"0.6 * coalesce({_SCALED}, 1)"))
def hybrid(spark, folder):
    return R.hybrid_fuse(_hashed_run(spark, folder, 50), _bm25(spark, folder, 50), dense_weight=0.4)


@query("hybrid_fuse_rrf", _fused_sql("1.0 / (60 + rank)", "1.0 / (60 + rank)"))
def hybrid_rrf(spark, folder):
    return R.hybrid_fuse(_hashed_run(spark, folder, 50), _bm25(spark, folder, 50), method="rrf")


@query(
    "recommend_postings",
    f"""WITH cv AS ({hashed_sql('conversations', 'conv_id, turn', DIMENSION)}),
    qv AS ({hashed_sql('benchmark', 'item_id', DIMENSION)}),
    chunk_scores AS (SELECT item_id AS query_id, conv_id, turn, round(sum(qv.weight * cv.weight), 6) AS score
        FROM qv JOIN cv USING (bucket) GROUP BY ALL),
    scores AS (SELECT query_id, conv_id AS doc_id, max(score) AS score FROM chunk_scores GROUP BY ALL), {TOP_DENSE}
    SELECT query_id, doc_id AS job_post_id, score, rank FROM ranked WHERE rank <= 5""",
)
def recommend(spark, folder):
    """Turns are the chunks of a conversation."""
    chunks = text_table(spark, folder, "conversations", "conv_id").withColumnRenamed("conv_id", "job_post_id")
    return V.recommend_postings(_hashed(_questions(spark, folder)), _hashed(chunks))


_COMMON = "common AS (SELECT term FROM doc_terms GROUP BY term HAVING count(*) >= 0.3 * (SELECT count(*) FROM documents))"


@query(
    "mask_terms",
    f"""WITH {_DOC_TERMS}, {_COMMON}
    SELECT doc_id, term, CAST(round(weight * CASE WHEN term IN (SELECT term FROM common) THEN 0.1 ELSE 1.0 END, 6) AS DOUBLE) AS weight
    FROM doc_terms""",
)
def masked(spark, folder):
    """Terms of three documents in ten are damped."""
    documents = _documents(spark, folder)
    held = stage(R.term_weights(documents, "doc_id", "text", "doc_id"), "doc_terms")
    total = documents.agg(F.count("*")).scalar()
    common = held.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= total * 0.3)
    return R.mask_terms(held, common, 0.1).withColumn("weight", F.round("weight", 6)).select("doc_id", "term", "weight")


_QRELS = "qrels AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id, quality AS rel FROM labels)"
_METRICS = f"""WITH {bm25_sql(50)}, {_QRELS}, relevant AS (SELECT * FROM qrels WHERE rel > 0),
    ideal AS (SELECT query_id, count(*) AS n_relevant, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1) ELSE 0 END) AS idcg FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS i FROM relevant) GROUP BY query_id),
    hit AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg,
        count(*) FILTER (rank <= 50) AS hits, min(rank) AS first FROM bm25 JOIN relevant USING (query_id, doc_id) GROUP BY query_id),
    metrics AS (SELECT query_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(hits / n_relevant, 0), 6) AS recall,
        round(coalesce(1.0 / first, 0), 6) AS mrr FROM ideal LEFT JOIN hit USING (query_id))"""


def _metrics(spark, folder):
    labels = table(spark, folder, "labels")
    n_queries = table(spark, folder, "benchmark").agg(F.count("*")).scalar()
    qrels = labels.select((F.col("doc_id") % n_queries).alias("query_id"), "doc_id", F.col("quality").alias("rel"))
    return R.retrieval_metrics(_bm25(spark, folder, 50), qrels)


@query("retrieval_metrics", f"{_METRICS} SELECT * FROM metrics")
def metrics(spark, folder):
    """Each labelled document is judged for one query, by its quality."""
    return _metrics(spark, folder)


@query(
    "retrieval_metrics_mean",
    f"{_METRICS} SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, "
    "count(*) AS n_queries FROM metrics",
)
def metrics_mean(spark, folder):
    return R.mean_metrics(_metrics(spark, folder))
