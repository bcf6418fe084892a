import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import dedup as D
from siftwell.operators import profile as P
from siftwell.operators import ranking as R
from siftwell.plans.index import posting_outcomes

PARTITIONS = [1, 4, 17]


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_first_row_wins(spark, partitions):
    rng = random.Random(3)
    # one text makes up a third of the rows
    rows = [(i, "hot" if rng.random() < 0.33 else f"t{rng.randint(0, 50)}") for i in range(500)]
    df = spark.createDataFrame(rows, "ord int, clean_text string").repartition(partitions)
    firsts = {}
    for i, text in rows:
        firsts.setdefault(text, i)
    assert sorted(r["ord"] for r in D.dedup_clean_text(df).collect()) == sorted(firsts.values())


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_first_rows_in_order(spark, partitions):
    rng = random.Random(4)
    rows = [((f"p{i % 7}", i), f"u{i}", None if i == 9 else "hot" if rng.random() < 0.33 else f"t{rng.randint(0, 50)}") for i in range(500)]
    df = spark.createDataFrame(rows, "ord struct<path: string, row: int>, `mark_a.b` string, clean_text string").repartition(partitions)
    firsts = {}
    for ord, url, text in sorted(rows):
        firsts.setdefault(text, (ord, url, text))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = D.dedup_clean_text(df.select("`mark_a.b`", "ord", "clean_text"), in_order=True)
        found = kept.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert kept.columns == ["ord", "mark_a.b", "clean_text"]
    assert [(tuple(r["ord"]), r["mark_a.b"], r["clean_text"]) for r in sorted(found, key=lambda r: r["at"])] == sorted(
        firsts.values(), key=lambda row: row[0]
    )
    assert len({r["part"] for r in found}) > 1


def test_first_rows_in_order_are_shuffled_once(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("ord"), (F.col("id") % 700).cast("string").alias("clean_text")).write.parquet(f"{tmp_path}/t")
    kept = D.dedup_clean_text(spark.read.parquet(f"{tmp_path}/t"), in_order=True)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Exchange" in line and "rangepartitioning" in line] and "Join" not in plan
    # the other one is that of the hashes
    assert plan.count("Exchange") == 2 and "hashpartitioning(_key" in plan


def test_blank_bodies_are_not_distinct_texts(spark):
    df = spark.createDataFrame([(1, " 　"), (2, "a"), (3, None), (4, "a"), (5, "")], "ord int, t string")
    assert [r["ord"] for r in D.distinct_raw_text(df, "t", "ord").collect()] == [2]


def outcomes_one_by_one(rows, known):
    known, out = set(known), {}
    for ord, url, ok in rows:
        if url in known:
            out[ord] = "skip"
        elif ok and url is not None:
            known.add(url)
            out[ord] = "success"
        else:
            out[ord] = "fail"
    return out


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_outcomes_equal_taking_rows_one_by_one(spark, partitions):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        url = None if i % 50 == 0 else f"u{rng.randint(0, 60)}"
        rows.append((i, url, url is not None and rng.random() < 0.6))
    known = [f"u{i}" for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ord int, url string, ok boolean").repartition(partitions)
    existing = spark.createDataFrame([(u,) for u in known], "url string")
    got = {r["ord"]: r["outcome"] for r in posting_outcomes(df, existing).collect()}
    assert got == outcomes_one_by_one(rows, known)
    fresh = D.new_postings_anti(df.filter("ok"), existing)
    assert sorted(r["ord"] for r in fresh.collect()) == sorted(o for o, v in got.items() if v == "success")


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_numbers_follow_the_order(spark, partitions):
    values = random.Random(1).sample(range(10_000), 777)
    df = spark.createDataFrame([(v,) for v in values], "ord int").repartition(partitions)
    got = {r["ord"]: r["idx"] for r in R.number_rows(df, "ord", start=5).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values), start=5)}
    assert R.number_rows(df.limit(0), "ord").count() == 0


def test_parts_start_at_one(spark):
    df = spark.createDataFrame([(1,), (1000,), (1001,), (2001,)], "i long").withColumn("p", R.part_of(F.col("i")))
    assert [r["p"] for r in df.orderBy("i").collect()] == [1, 1, 2, 3]


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("g"), "id")
    top = R.top_k_per_group(df, ["g"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted((r["g"], r["id"], r["rank"]) for r in top.collect()) == [
        (0, 9996, 2), (0, 9999, 1), (1, 9994, 2), (1, 9997, 1), (2, 9995, 2), (2, 9998, 1)]


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("s",)], "y string")
    assert [tuple(r) for r in R.union_by_name([a, b]).collect()] == [(1, None), (None, "s")]
    with pytest.raises(ValueError):
        R.union_by_name([])


def test_first_links_need_one(spark):
    links = spark.createDataFrame([(2, "b"), (1, "a")], "ord int, url string")
    assert [r["url"] for r in R.first_n_links(links, "ord", 1).collect()] == ["a"]
    with pytest.raises(ValueError):
        R.first_n_links(links.limit(0), "ord")


def test_profile_counts_missing_bodies(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("xyz",), ("",), (None,)], "t string")
    assert P.corpus_profile(df, "t").first().asDict() == {
        "n_rows": 5, "n_bodies": 3, "n_unique": 2, "n_chars": 6, "n_tokens": 3, "mean_chars": 3.0}


def test_line_lists(spark):
    df = spark.createDataFrame([(1, "x\nx\na"), (2, "x \n\nb"), (3, "c")], "id int, t string")
    shared = P.lines_in_share(df, "t", 0.5)
    assert [tuple(r) for r in shared.collect()] == [("x", 2)]
    left = P.lines_not_listed(P.exploded_lines(df, "t", "id"), shared)
    assert sorted((r["id"], r["line"]) for r in left.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert [tuple(r) for r in P.top_repeated_lines(df, "t", 1).collect()] == [("x", 3)]


def test_zip_is_cut_to_the_shorter_side(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2, 3]), ([], [1])], "c array<string>, v array<int>")
    out = [r["z"] for r in df.select(D.zip_chunks_vectors(F.col("c"), F.col("v")).alias("z")).collect()]
    assert [[tuple(p) for p in row] for row in out] == [[("a", 1), ("b", 2)], []]


def test_cascade(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "post long, chunk_index int")
    posts = spark.createDataFrame([(1,)], "id long")
    assert D.cascade_chunks(chunks, posts, "post", "id").count() == 2
    assert D.chunk_to_posting(chunks, posts, "post", "id").count() == 2


@pytest.mark.parametrize("counters", [3, 12, 20_000])
def test_summaries_lose_no_frequent_line(spark, counters):
    from siftwell.operators import heavy_hitters as H

    rng = random.Random(counters)
    often = [f"often {i}" for i in range(6)]
    texts = ["\n".join(rng.choice(often) if rng.random() < 0.5 else f"rare {rng.randrange(3000)}" for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", " \n "]], "t string").repartition(5)
    for k in (1, 4, 6, 40):
        assert H.top_lines(df, "t", k, counters).collect() == P.top_repeated_lines(df, "t", k).collect()
    for share in (0.001, 0.01, 0.2, 0.6):
        want = {tuple(r) for r in P.lines_in_share(df, "t", share).collect()}
        assert {tuple(r) for r in H.lines_in_share(df, "t", share, counters).collect()} == want
    assert H.top_lines(df.limit(0), "t", 3, counters).collect() == []


def test_estimates_bound_the_counts_and_few_lines_are_counted_again(spark):
    from siftwell.operators import heavy_hitters as H

    rng = random.Random(1)
    lines = [rng.choice(["a", "a", "b", f"rare {i}"]) for i in range(8000)]
    df = spark.createDataFrame([(line,) for line in lines], "line string").repartition(4)
    summaries, estimates, error = H._estimates(df, 20)
    held = {r["line"]: r["least"] for r in estimates.collect()}
    count = {line: lines.count(line) for line in {"a", "b", *held}}
    assert len(held) <= 4 * 20 and error <= len(lines) / 21
    assert all(held[x] <= n <= held[x] + error for x, n in count.items() if x in held) and {"a", "b"} <= held.keys()
    assert estimates.where(estimates.least + error >= held["b"]).count() == 2
