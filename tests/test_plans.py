import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftwell.plans.corpus import _stage_cleaned, build_corpus
from siftwell.plans.index import index_postings, posting_outcomes
from siftwell.plans.vocabulary import train_vocab
from siftwell.session import SHUFFLE_CLEANUP, TEXT_CODEC, new_path, shared_dir, stage
from siftwell.sources.text_lines import scan_corpus_lines
from siftwell.streaming.ingest import index_new_parts

BODY = "물류 창고에서 일할 분을 찾습니다. 지게차 면허와 엑셀 사용이 필요하며 주간 근무입니다"
COLUMNS = "ord long, company string, url string, iframe_jd_text string, json_ld string"


def counts(df):
    return {r["outcome"]: r["n"] for r in df.collect()}


def postings(spark, rows):
    return spark.createDataFrame([(i, c, u, b, j) for i, (c, u, b, j) in enumerate(rows)], COLUMNS)


def test_corpus_job(spark, tmp_path):
    (tmp_path / "p_1.csv").write_text(f'company,url,iframe_jd_text\nA,u1,"{BODY}\nㆍ학력 : 학력무관"\nB,u2,짧다\n', encoding="utf-8")
    (tmp_path / "p_2.csv").write_text(f'url,iframe_jd_text\nu3,"{BODY}"\nu4,"{BODY} 둘째"\nu5,\n', encoding="utf-8")
    text, clean = new_path(spark, "text"), new_path(spark, "clean")
    stats = {r["stage"]: (r["n_rows"], r["n_chars"]) for r in build_corpus(spark, f"{tmp_path}/p_*.csv", text, clean).collect()}
    assert stats["read"][0] == 5 and stats["cleaned"] == (3, 3 * len(BODY) + 3) and stats["unique"] == (2, 2 * len(BODY) + 3)
    rows = spark.read.parquet(clean).orderBy("url").collect()
    assert [(r["company"], r["url"], r["clean_text"]) for r in rows] == [("A", "u1", BODY), (None, "u4", BODY + " 둘째")]
    assert sorted(r["value"] for r in spark.read.text(text).collect()) == [BODY, BODY + " 둘째"]
    rate = train_vocab(spark, text, new_path(spark, "vocab"), size=120, min_frequency=1).first()
    assert rate["n_unknown"] == 0 and rate["n_tokens"] > 0


def test_corpus_keeps_the_order_of_the_input(spark, tmp_path):
    for part in range(12):
        lines = "".join(f'u{part},"{BODY} {part:02d} {row:03d}"\n' for row in range(250))
        (tmp_path / f"p_{part:02d}.csv").write_text("url,iframe_jd_text\n" + lines, encoding="utf-8")
    text, clean = new_path(spark, "text"), new_path(spark, "clean")
    adaptive = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in adaptive}
    try:
        for k, v in adaptive.items():
            spark.conf.set(k, v)
        build_corpus(spark, f"{tmp_path}/p_*.csv", text, clean)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    ordered = [r["value"] for r in scan_corpus_lines(spark, text).orderBy("ord").collect()]
    assert ordered == sorted(ordered) and len(ordered) == 3000


def files_below(folder):
    return sorted(p for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_")))


def shuffle_files(spark):
    """Names of the shuffle files that this session holds."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (blocks.apply(i).getName() for i in range(blocks.size()))
    return {name for name in names if name.startswith("shuffle_")}


def write_parts(folder, files=6, rows=60):
    """CSV parts in which every other row repeats a body of the part before."""
    for part in range(files):
        lines = "".join(f'u{part}-{row},"{BODY} {part - row % 2:02d} {row:03d}\nㆍ학력 : 학력무관"\n' for row in range(rows))
        (folder / f"p_{part:02d}.csv").write_text("url,iframe_jd_text\n" + lines, encoding="utf-8")


def test_corpus_job_keeps_no_shuffle_files_and_no_staged_rows(spark, tmp_path):
    write_parts(tmp_path)
    text, clean = new_path(spark, "text"), new_path(spark, "clean")
    tables, blocks, setting = files_below(shared_dir(spark)), shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    build_corpus(spark, f"{tmp_path}/p_*.csv", text, clean)
    until = time.time() + 20
    while shuffle_files(spark) - blocks and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - blocks
    assert {p.parent.name for p in files_below(shared_dir(spark)) if p not in tables} == {"text", "clean", "corpus_stats"}
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting


def test_parts_may_go_when_the_corpus_job_has_read_them(spark, tmp_path):
    text, clean, seen = new_path(spark, "text"), new_path(spark, "clean"), []

    def once_read():
        seen.append((Path(text).exists(), Path(clean).exists()))
        for part in tmp_path.glob("p_*.csv"):
            part.unlink()

    write_parts(tmp_path)
    kept = build_corpus(spark, f"{tmp_path}/p_*.csv", text, clean, once_read=once_read)
    stats = {r["stage"]: (r["n_rows"], r["n_chars"]) for r in kept.collect()}
    size, dropped = len(f"{BODY} 00 000"), "\nㆍ학력 : 학력무관"
    assert seen == [(False, False)] and not list(tmp_path.glob("p_*.csv"))
    assert stats["read"] == (360, 360 * (size + len(dropped))) and stats["cleaned"] == (360, 360 * size)
    rows = spark.read.parquet(clean).collect()
    assert stats["unique"] == (len(rows), sum(len(r["clean_text"]) for r in rows))
    bodies = {f"{BODY} {part - row % 2:02d} {row:03d}" for part in range(6) for row in range(60)}
    assert sorted(r["clean_text"] for r in rows) == sorted(bodies)
    assert all(r["iframe_jd_text"] == r["clean_text"] + dropped for r in rows)


def test_staged_texts_take_little_more_disk_than_one_of_them(spark):
    words = [f"{i * 7919 % 99_991:05x}" for i in range(5000)]
    bodies = [(f"u{n}", " ".join(words[(n * k) % 5000] for k in range(1, 400)), (str(n), n)) for n in range(1000, 1300)]
    rows = spark.createDataFrame(bodies, "url string, iframe_jd_text string, ord struct<path: string, row: long>").coalesce(1)
    rows = rows.withColumn("clean_text", F.replace("iframe_jd_text", F.lit(" 0"), F.lit("\n0")))
    staged, unpacked = _stage_cleaned(rows)
    assert unpacked.schema.names == rows.schema.names
    assert sorted(unpacked.collect()) == sorted(rows.collect())
    one = stage(rows.drop("iframe_jd_text"), "one", codec=TEXT_CODEC)
    size = {df: sum(p.stat().st_size for p in files_below(df.staged_path)) for df in (staged, one)}
    assert size[staged] < 1.4 * size[one]


@pytest.mark.parametrize("name", ["공고 모음", "#1 20%", "a%20b", "d+e"])
def test_corpus_in_a_folder_of_any_name(spark, tmp_path, name):
    write_parts(tmp_path, files=2)
    text, clean = (f"{new_path(spark, kind)}/{name}" for kind in ("text", "clean"))
    stats = {r["stage"]: r["n_rows"] for r in build_corpus(spark, f"{tmp_path}/p_*.csv", text, clean).collect()}
    lines = [r["value"] for r in scan_corpus_lines(spark, text).orderBy("ord").collect()]
    assert lines == [r["clean_text"] for r in spark.read.parquet(clean).orderBy("ord").collect()] and len(lines) == stats["unique"]


def test_a_corpus_of_no_rows(spark, tmp_path):
    (tmp_path / "p_1.csv").write_text("url,iframe_jd_text\nu1,짧다\n", encoding="utf-8")
    text, clean = new_path(spark, "text"), new_path(spark, "clean")
    stats = {r["stage"]: (r["n_rows"], r["n_chars"]) for r in build_corpus(spark, f"{tmp_path}/p_*.csv", text, clean).collect()}
    assert stats == {"read": (1, 2), "cleaned": (0, 0), "unique": (0, 0)}
    assert spark.read.parquet(clean).count() == spark.read.text(text).count() == 0


def test_a_later_run_adds_to_the_folder(spark):
    folder = new_path(spark, "index")
    for url, added in (("u1", {"success": 1}), ("u2", {"success": 1}), ("u1", {"skip": 1})):
        assert counts(index_postings(postings(spark, [("A", url, "text", "{}")]), folder)) == added
    rows = spark.read.parquet(f"{folder}/job_posts").orderBy("id").collect()
    assert [(r["id"], r["url"]) for r in rows] == [(1, "u1"), (2, "u2")]
    assert spark.read.parquet(f"{folder}/points").count() == 2


def test_json_that_the_parser_refuses_fails(spark):
    texts = ["{'a': 1}", '{"a": "x\ny"}', '{"a": 1, "a": 2}', '{"a": 1}', "[1]", "3"]
    rows = postings(spark, [("A", f"u{i}", "text", t) for i, t in enumerate(texts)])
    folder = new_path(spark, "index")
    assert counts(index_postings(rows, folder)) == {"success": 3, "fail": 3}
    assert all(r["json_ld"] for r in spark.read.parquet(f"{folder}/job_posts").collect())


def test_a_hot_url_is_split_over_tasks(spark):
    rows = spark.range(200_000).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 4 > 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), "id")).alias("url"),
        F.lit(True).alias("ok"),
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = posting_outcomes(rows, spark.createDataFrame([(1, "u0")], "id long, url string"))
        grouped = found.groupBy("outcome").count()
        assert {r["outcome"]: r["count"] for r in grouped.collect()} == {"success": 50_000, "skip": 150_000}
        assert "skew=true" in grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_empty_corpus_is_an_error(spark):
    path = new_path(spark, "none")
    spark.createDataFrame([("  ",)], "value string").write.text(path)
    with pytest.raises(ValueError, match="build the corpus"):
        train_vocab(spark, path, new_path(spark, "vocab"))


def test_index_job(spark):
    folder = new_path(spark, "index")
    ld = json.dumps({"a": 1})
    first = postings(spark, [
        ("A", "u1", "x" * 1500, ld), ("A", "u1", "again", ld), ("B", "u2", "bad", "{"), ("B", "u2", "good", ld),
        ("C", None, "no url", ld), (None, "u3", "no company", ld), ("D" * 256, "u4", "long name", ld),
        ("E", "u5", "", ld), ("F", "u6", None, ld), ("G", "u7", "two documents", ld + "\n" + ld), ("H", "u8", "none", None),
    ])
    assert counts(index_postings(first, folder)) == {"success": 2, "skip": 1, "fail": 6}
    posts = spark.read.parquet(f"{folder}/job_posts").orderBy("id")
    assert [(r["id"], r["url"], r["iframe_jd_text"][:4], r["status"]) for r in posts.collect()] == [(1, "u1", "xxxx", None), (2, "u2", "good", None)]
    chunks = spark.read.parquet(f"{folder}/job_post_chunks").orderBy("job_post_id", "chunk_index").collect()
    assert [(r["job_post_id"], r["chunk_index"], len(r["chunk_text"])) for r in chunks] == [(1, 0, 1000), (1, 1, 700), (2, 0, 4)]
    points = {r["id"]: r for r in spark.read.parquet(f"{folder}/points").collect()}
    assert {c["point_id"] for c in chunks} == set(points)
    assert len(points[chunks[0]["point_id"]]["vector"]) == 1536
    assert tuple(points[chunks[1]["point_id"]]["payload"]) == (1, 1)

    again = postings(spark, [("A", "u1", "x", ld), ("Z", "u9", "new", ld), ("B", "u2", "bad", "{")])
    assert counts(index_postings(again, folder, posts.select("id", "url"))) == {"success": 1, "skip": 2}
    ids = sorted((r["id"], r["url"]) for r in spark.read.parquet(f"{folder}/job_posts").collect())
    assert ids == [(1, "u1"), (2, "u2"), (3, "u9")]


def test_a_repeated_run_replaces_what_a_failed_one_left(spark):
    folder = new_path(spark, "index")
    rows = postings(spark, [("A", "u1", "text one", "{}"), ("B", "u2", "text two", "{}")])
    index_postings(rows, folder)
    # the posting table was not written: the URLs are still unknown
    index_postings(rows, folder)
    assert spark.read.parquet(f"{folder}/job_post_chunks").count() == spark.read.parquet(f"{folder}/points").count() == 2


def test_bad_rows_can_stop_the_run(spark):
    rows = postings(spark, [("A", "u1", "text", "{")])
    with pytest.raises(ValueError, match="cannot be stored"):
        index_postings(rows, new_path(spark, "index"), on_error="fail")
    assert counts(index_postings(rows, new_path(spark, "index"))) == {"fail": 1}


def test_new_parts_are_indexed_as_they_arrive(spark, tmp_path):
    source, folder = tmp_path / "in", new_path(spark, "stream")
    source.mkdir()
    header = "company,url,iframe_jd_text,main_jd_text,json_ld,status,error\n"

    def arrive(name, *urls):
        lines = "".join(f'A,{u},"text of\n{u}",,{{}},success,\n' for u in urls) + "B,x,,,,fail,timeout\n"
        (source / name).write_text(header + lines, encoding="utf-8")
        index_new_parts(spark, str(source), folder, name=tmp_path.name).awaitTermination()
        return sorted(r["url"] for r in spark.read.parquet(f"{folder}/job_posts").collect())

    assert arrive("p_1.csv", "u1", "u2") == ["u1", "u2"]
    assert arrive("p_2.csv", "u2", "u3", "u3") == ["u1", "u2", "u3"]
    (source / "다른 순서.csv").write_text("url,iframe_jd_text,status,company,json_ld\nu4,text,success,ACME,{}\n", encoding="utf-8")
    assert arrive("p_3.csv", "u5") == ["u1", "u2", "u3", "u4", "u5"]
    stored = spark.read.parquet(f"{folder}/job_posts").filter("url = 'u4'").first()
    assert stored["company"] == "ACME"
