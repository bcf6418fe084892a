import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.operators import retrieval as R
from siftwell.operators import vectors as V
from siftwell.operators.ranking import top_k_per_group


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, vector array<float>")


def brute(queries, corpus, k):
    out = []
    for q, a in queries:
        best = {}
        for d, b in corpus:
            a64, b64 = np.array(a or [], np.float64), np.array(b or [], np.float64)
            score = None
            if a and b and np.linalg.norm(a64) and np.linalg.norm(b64):
                score = round(float(a64 @ b64 / np.linalg.norm(a64) / np.linalg.norm(b64)), 6)
            if d not in best or (score is not None and (best[d] is None or score > best[d])):
                best[d] = score
        ranked = sorted(best.items(), key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))[:k]
        out += [(q, d, s, i) for i, (d, s) in enumerate(ranked, start=1)]
    return out


def close(got, want):
    got = sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in got)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in sorted(want)]
    for g, w in zip(got, sorted(want)):
        assert (g[2] is None) == (w[2] is None) and (g[2] is None or math.isclose(g[2], w[2], abs_tol=2e-6))


@pytest.mark.parametrize("cell_rows, query_rows", [(50_000, 200_000), (9, 5)])
@pytest.mark.parametrize("partitions", [1, 17])
def test_dense_search_equals_brute_force(spark, monkeypatch, cell_rows, query_rows, partitions):
    """Ties, zero and missing vectors, and a hot cell of copies, in one part or in many."""
    monkeypatch.setattr(V, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(V, "QUERY_ROWS", query_rows)
    rng = random.Random(partitions)
    corpus = [(i // 2, [rng.randint(-2, 2) * 1.0 for _ in range(4)]) for i in range(300)]
    corpus += [(900 + i % 3, [1.0, 1.0, 0.0, 0.0]) for i in range(150)]  # copies, and ties between ids
    corpus += [(2000, [0.0] * 4), (2001, None)]
    queries = [(i, [rng.randint(-2, 2) * 1.0 for _ in range(4)]) for i in range(30)] + [(99, [0.0] * 4), (98, None)]
    got = V.dense_topk(
        vectors(spark, queries, "query_id"), vectors(spark, corpus, "doc_id").repartition(partitions), 5
    ).collect()
    close(got, brute(queries, corpus, 5))


def clustered(seed, clusters, each, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return np.concatenate([c + 0.05 * rng.normal(size=(each, size)) for c in centres])


def test_few_cells_are_asked_where_vectors_cluster(spark):
    rows = clustered(1, 30, 40).astype(np.float32)
    corpus = [(i, v.tolist()) for i, v in enumerate(rows)]
    queries = [(i, v) for i, v in corpus if i % 13 == 0]
    got = V.dense_topk(vectors(spark, queries, "query_id"), vectors(spark, corpus, "doc_id"), 5).collect()
    close(got, brute(queries, corpus, 5))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    pivots = unit[::37]
    angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    cell = angle.argmin(axis=1)
    own = [angle[cell == c, c] for c in range(len(pivots))]
    cells = V.Cells(pivots, np.bincount(cell, minlength=len(pivots)), np.array([o.min() for o in own]), np.array([o.max() for o in own]))
    scores = np.sort(unit @ unit.T, axis=1)[:, -5]
    asked = [np.union1d(a, b) for a, b in zip(cells.nearest(unit, 5), cells.within(unit, scores))]
    assert sum(cells.counts[a].sum() for a in asked) < 0.15 * len(unit) ** 2
    for i, a in enumerate(asked):  # nothing that reaches the score is left out
        assert np.isin(cell[unit @ unit[i] >= scores[i] - 1e-7], a).all()


def test_queries_stay_on_the_executors(spark, monkeypatch):
    """What reaches the driver are pivots, a row for each cell, and k ids."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    take = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append(len(found := take(df))) or found)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **b: pytest.fail("rows passed through the driver"))
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(2, 9, 50, 6))]
    V.dense_topk(vectors(spark, rows, "query_id"), vectors(spark, rows, "doc_id"), 3)
    assert seen and max(seen) <= 22


def _dealt(monkeypatch):
    """What is dealt to the tasks of dense searches from now on."""
    from pyspark.sql.classic.dataframe import DataFrame

    dealt, deal = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *a: dealt.append(df) or deal(df, *a))
    return dealt


def test_a_query_is_sent_once_to_a_task_however_many_cells_it_asks(spark, monkeypatch):
    """Vectors without clusters: every query asks every cell."""
    dealt = _dealt(monkeypatch)
    made = np.random.default_rng(3).normal(size=(400, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    got = V.dense_topk(vectors(spark, rows, "query_id"), vectors(spark, rows, "doc_id"), 5).collect()
    close(got, brute(rows, rows, 5))
    assert dealt and all(df.count() <= 2 * len(rows) for df in dealt)


def test_few_queries_are_sent_to_the_documents(spark, monkeypatch):
    """No document is dealt anew; copies, documents with several vectors, missing and zero vectors on both sides."""
    dealt = _dealt(monkeypatch)
    rng = random.Random(8)
    corpus = [(i // 2, [rng.randint(-2, 2) * 1.0 for _ in range(3)]) for i in range(300)] + [(7, None), (500, None), (501, [0.0] * 3)]
    queries = [(1, [1.0, 2.0, 0.0]), (2, [0.0, -1.0, 1.0]), (3, None), (4, [0.0] * 3)]
    got = V.dense_topk(vectors(spark, queries, "query_id"), vectors(spark, corpus, "doc_id"), 9).collect()
    close(got, brute(queries, corpus, 9))
    got = V.dense_topk(vectors(spark, queries[::2], "query_id"), vectors(spark, corpus[:4] + corpus[-3:], "doc_id"), 9)
    assert got.where("query_id = 1").count() == 5 and not dealt


def test_texts_are_split_once_for_scoring(spark, monkeypatch):
    """Not a second time below the shuffle that deals the documents out."""
    seen = []
    ranked = R._ranked
    monkeypatch.setattr(R, "_ranked", lambda asked, documents, *a: seen.append(documents) or ranked(asked, documents, *a))
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string").repartition(3, "doc_id")
    queries = spark.createDataFrame([(7, "a")], "query_id long, text string")
    assert [(r["doc_id"], r["rank"]) for r in R.bm25_topk(queries, docs).collect()] == [(1, 1)]
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_undefined_scores_rank_last(spark):
    corpus = vectors(spark, [(1, [0.0, 0.0]), (2, [-1.0, 0.0])], "doc_id")
    rows = V.dense_topk(vectors(spark, [(7, [1.0, 0.0])], "query_id"), corpus).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(2, -1.0), (1, None)]


def test_empty_sides(spark):
    some, none = vectors(spark, [(1, [1.0])], "doc_id"), vectors(spark, [], "query_id")
    assert V.dense_topk(none, some).count() == 0
    assert V.dense_topk(some.withColumnRenamed("doc_id", "query_id"), some.limit(0)).count() == 0


def test_postings_score_as_their_best_chunk(spark):
    chunks = spark.createDataFrame(
        [(1, [1.0, 0.1]), (1, [1.0, 0.0]), (1, [1.0, 0.2]), (2, [0.5, 0.5]), (3, [0.0, 1.0])], "job_post_id long, vector array<float>"
    )
    rows = V.recommend_postings(vectors(spark, [(5, [1.0, 0.0])], "query_id"), chunks, 2).orderBy("rank").collect()
    assert [(r["job_post_id"], r["score"]) for r in rows] == [(1, 1.0), (2, 0.707107)]


def test_a_stored_index_ranks_as_the_documents_do(spark, tmp_path, monkeypatch):
    from siftwell.operators import stored_index as S

    monkeypatch.setattr(S, "BLOCK_POSTINGS", 4)
    monkeypatch.setattr(S, "SHARD_POSTINGS", 60)
    rng = random.Random(6)
    words = ["the"] * 60 + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(400)] + ["", None, "only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [" ".join(rng.choices(words, k=4)) for _ in range(12)] + ["the", "only here", "unknown", "", None, "w1 w1 w2"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    path = str(tmp_path / "index")
    S.build_bm25_index(docs, path)
    got = S.bm25_index_topk(spark, path, queries, 5).orderBy("query_id", "rank").collect()
    want = R.bm25_topk(queries, docs, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(r["query_id"], r["doc_id"], r["rank"]) for r in want]
    assert all(abs(g["score"] - w["score"]) < 2e-6 for g, w in zip(got, want))
    # postings of blocks that can't matter are not read
    pairs = queries.select("query_id", F.explode(F.array_distinct(F.split("text", " "))).alias("term"))
    pairs = pairs.select("query_id", S._bucket("term"), "term")
    blocks = S.needed_blocks(spark, path, pairs, 5)
    index = spark.read.parquet(path)
    assert blocks.count() < index.join(pairs, ["bucket", "term"]).count()
    # a common term alone: from each of its shards only the first blocks
    alone = blocks.where("query_id = 12").count()
    assert alone < 0.4 * index.where("term = 'the'").count()
    assert index.where("size(docs) > 4").count() == 0 and index.groupBy("term", "shard").agg(F.sum(F.size("docs")).alias("n")).where("n > 120").count() == 0


def test_a_block_of_the_index_is_read_once_for_all_queries(spark, tmp_path, monkeypatch):
    from siftwell.operators import stored_index as S

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot word "), "id").alias("text"))
    queries = spark.createDataFrame([(i, "hot word") for i in range(40)], "query_id long, text string")
    read = []
    scored = S.sparse_topk
    monkeypatch.setattr(S, "sparse_topk", lambda asked, postings, k: read.append(postings.count()) or scored(asked, postings, k))
    path = str(tmp_path / "index")
    S.build_bm25_index(docs, path)
    found = S.bm25_index_topk(spark, path, queries, 2).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in found) == [(q, d) for q in range(40) for d in (0, 1)]
    assert read == [600]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    assert sorted(tuple(r) for r in V.upsert_points(old, new).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    once = V.upsert_points(old, new)
    assert V.upsert_points(once, new).exceptAll(once).count() == 0


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    from siftwell.sources import points as P

    path = str(tmp_path / "points")
    files = lambda: {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "points").glob("bucket=*/*.parquet")}
    old = spark.range(500).select("id", F.lit("old").alias("v"), F.array(F.col("id").cast("float")).alias("vector"))
    P.create_points(old, path, buckets=40)
    before = files()
    assert len({f.parent for f in before}) == 40
    new = spark.createDataFrame([(7, "a", [1.0]), (7, "b", [2.0]), (100_000, "new", [3.0])], "id long, v string, vector array<float>")
    assert P.upsert_into(path, new, latest="v") == 2
    after = files()
    untouched = {f for f in before if after.get(f) == before[f]}
    assert len({f.parent for f in untouched}) == 38 and len({f.parent for f in set(after) - untouched}) == 2
    rows = {r["id"]: (r["v"], r["vector"]) for r in P.read_points(spark, path).collect()}
    assert len(rows) == 501 and rows[7] == ("b", [2.0]) and rows[100_000] == ("new", [3.0]) and rows[8] == ("old", [8.0])
    assert P.upsert_into(path, new, latest="v") == 2 and P.read_points(spark, path).count() == 501
    assert P.upsert_into(path, new.limit(0)) == 0 and files().keys() >= untouched
    assert P.read_points(spark, path).columns == ["id", "v", "vector"]


def test_a_hot_bucket_is_written_in_parts(spark, tmp_path, monkeypatch):
    from siftwell.sources import points as P

    monkeypatch.setattr(P, "FILE_ROWS", 100)
    P.create_points(spark.range(950).select("id", F.lit("v").alias("v")), str(tmp_path / "points"), buckets=1)
    assert len(list((tmp_path / "points" / "bucket=0").glob("*.parquet"))) >= 10
    assert P.read_points(spark, str(tmp_path / "points")).count() == 950


@pytest.mark.parametrize("block_terms", [1000, 1])
def test_sparse_and_bm25_equal_brute_force(spark, block_terms):
    rng = random.Random(2)
    words = ["hot"] * 10 + [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12))) for i in range(80)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(6)], "query_id long, text string")
    asked, held = R.term_weights(queries, "query_id", "text", "query_id"), R.term_weights(docs, "doc_id", "text", "doc_id")
    key = lambda r: (r["query_id"], r["rank"])
    got = sorted(R.sparse_topk(asked, held, 4, block_terms).collect(), key=key)
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for query in queries.collect():
        q = query["text"].split()
        scores = {d: float(sum(q.count(t) * w.count(t) for t in set(q))) for d, w in texts.items()}
        ranked = sorted(((d, s) for d, s in scores.items() if s), key=lambda p: (-p[1], p[0]))[:4]
        assert [(r["doc_id"], r["score"]) for r in got if r["query_id"] == query["query_id"]] == ranked
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    bm25 = sorted(R.bm25_topk(queries, docs, 4, block_terms=block_terms).collect(), key=key)
    for query in queries.collect():
        scores = {}
        for d, w in texts.items():
            total = 0.0
            for t in set(query["text"].split()):
                df, tf = sum(t in v for v in texts.values()), w.count(t)
                if tf:
                    total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if total:
                scores[d] = round(total, 6)
        ranked = sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:4]
        mine = [(r["doc_id"], r["score"]) for r in bm25 if r["query_id"] == query["query_id"]]
        assert [d for d, _ in mine] == [d for d, _ in ranked]


def test_postings_that_nobody_asks_for_are_not_dealt(spark, monkeypatch):
    """A task streams its documents, whole ones at a time, and sees only the terms of queries."""
    monkeypatch.setattr(R, "BATCH_POSTINGS", 3)
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("w"), "id"))).alias("term"))
    held = docs.withColumn("weight", F.when(F.col("term") == "hot", 1.0).otherwise(5.0))
    asked = spark.createDataFrame([(1, "hot", 2.0), (2, "w7", 1.0), (2, "none", 1.0)], "query_id long, term string, weight double")
    plan = R.sparse_topk(asked, held, 2)
    assert "LeftSemi" in plan._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in plan.collect()) == [(1, 0, 2.0, 1), (1, 1, 2.0, 2), (2, 7, 5.0, 1)]
    parts = [pa.RecordBatch.from_pydict({"doc_id": d}) for d in ([1, 1, 2], [2, 2, 2, 2], [3, 4], [4])]
    assert [b.column("doc_id").to_pylist() for b in R._whole_documents(iter(parts))] == [[1, 1], [2, 2, 2, 2, 2, 3], [4, 4]]


def test_more_postings_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_POSTINGS", 100)
    asked = spark.createDataFrame([(1, "hot", 2.0)], "query_id long, term string, weight double")
    for n in (250, 2_500):
        held = spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("hot"), F.lit("cold"))).alias("term"), F.lit(1.0).alias("weight"))
        plan = R.sparse_topk(asked, held, 2)
        assert f"hashpartitioning(doc_id, {math.ceil(n / 100)}), REPARTITION_BY_NUM" in re.sub(r"#\d+L?", "", plan._jdf.queryExecution().toString())
        assert sorted(tuple(r) for r in plan.collect()) == [(1, 0, 2.0, 1), (1, 1, 2.0, 2)]


def test_what_is_shuffled_does_not_grow_with_the_documents(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot word "), "id").alias("text")).repartition(6)
    queries = spark.createDataFrame([(i, "hot word") for i in range(5)], "query_id long, text string")
    seen = {}

    def top_k(candidates, *args):
        seen["rows"] = candidates.count()
        return top_k_per_group(candidates, *args)

    monkeypatch.setattr(R, "top_k_per_group", top_k)
    assert R.bm25_topk(queries, docs, 3).count() == 15
    assert 15 <= seen["rows"] <= 6 * 5 * 3


def test_negative_products_are_scores(spark):
    negative = R.sparse_topk(
        spark.createDataFrame([(1, "a", -2.0)], "query_id long, term string, weight double"),
        spark.createDataFrame([(7, "a", 1.0), (8, "b", 1.0)], "doc_id long, term string, weight double"),
    )
    rows = [tuple(r) for r in negative.collect()]
    assert rows == [(1, 7, -2.0, 1)]


def run(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long")


def test_fusion(spark):
    dense = run(spark, [(1, 10, 0.9, 1), (1, 11, 0.5, 2), (1, 12, 0.1, 3)])
    sparse = run(spark, [(1, 11, 8.0, 1), (1, 13, 4.0, 2)])
    weighted = R.hybrid_fuse(dense, sparse, 4, dense_weight=0.25).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in weighted] == [(11, 0.875), (10, 0.25), (12, 0.0), (13, 0.0)]
    rrf = R.hybrid_fuse(dense, sparse, 2, method="rrf").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in rrf] == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6))]
    with pytest.raises(ValueError):
        R.hybrid_fuse(dense, sparse, method="other")


def test_metrics(spark):
    ranked = run(spark, [(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3), (3, 10, 1.0, 1)])
    qrels = spark.createDataFrame([(1, 11, 2), (1, 99, 1), (1, 10, 0), (2, 10, 1), (3, 10, 0)], "query_id long, doc_id long, rel int")
    rows = {r["query_id"]: r for r in R.retrieval_metrics(ranked, qrels).collect()}
    assert set(rows) == {1, 2}  # query 3 has nothing relevant
    assert rows[1]["ndcg"] == round((2 / math.log2(3)) / (2 + 1 / math.log2(3)), 6)
    assert (rows[1]["recall"], rows[1]["mrr"]) == (0.5, 0.5)
    assert (rows[2]["ndcg"], rows[2]["recall"], rows[2]["mrr"]) == (0.0, 0.0, 0.0)
    mean = R.mean_metrics(R.retrieval_metrics(ranked, qrels)).first()
    assert (mean["recall"], mean["n_queries"]) == (0.25, 2)


def test_masking(spark):
    postings = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "doc_id long, term string, weight double")
    listed = spark.createDataFrame([("b",)], "term string")
    assert [tuple(r)[1:] for r in R.mask_terms(postings, listed).select("doc_id", "term", "weight").collect()] == [("a", 2.0)]
    damped = R.mask_terms(postings, listed, 0.5).select("term", "weight").collect()
    assert sorted(tuple(r) for r in damped) == [("a", 2.0), ("b", 1.5)]
