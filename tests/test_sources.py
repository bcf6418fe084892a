import pytest
from pyspark.sql import functions as F

from siftwell.operators.dedup import dedup_clean_text
from siftwell.session import new_path
from siftwell.sources import csv_parts, sinks, text_lines, url_ranges

BOM = "﻿"


@pytest.fixture
def parts(tmp_path):
    files = {
        "p_1.csv": f'{BOM}company,url,iframe_jd_text\r\nA,u1,"line one\nline ""two"""\r\nB,u2,\r\n',
        "p_2.csv": "iframe_jd_text,status,url,company\nsame body,success,u3,C\n",
        "p_10.csv": "url,iframe_jd_text\nu4,same body\nu5,NA\n",
        "p_11.csv": "company,url\nD,u6\n",
        "p_12.csv": "company,url,iframe_jd_text\nE,u7,t\nF,u8,t,too many\n",
        "p_13.csv": "",
        "p_14.csv": "company,url,iframe_jd_text\nG,u9\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "p_15.csv").write_bytes(b"company,url,iframe_jd_text\n\xff\xfe,\x80,x\n")
    (tmp_path / "other.csv").write_text("company,url,iframe_jd_text\nH,u10,t\n")
    return tmp_path


def test_parts_with_mixed_headers(spark, parts):
    rows = csv_parts.scan_csv_parts(spark, f"{parts}/p_*.csv").orderBy("url").collect()
    assert [(r["company"], r["url"], r["iframe_jd_text"]) for r in rows] == [
        ("A", "u1", 'line one\nline "two"'), ("B", "u2", None), ("C", "u3", "same body"), (None, "u4", "same body"),
        (None, "u5", "NA"), ("G", "u9", None)]


def test_words_for_missing_are_an_option(spark, parts):
    rows = csv_parts.scan_csv_parts(spark, f"{parts}/p_10.csv", na_values=["NA"]).orderBy("url").collect()
    assert [r["iframe_jd_text"] for r in rows] == ["same body", None]


def test_first_row_follows_the_path_order(spark, parts):
    rows = csv_parts.scan_csv_parts(spark, [f"{parts}/p_2.csv", f"{parts}/p_10.csv"])
    kept = dedup_clean_text(rows, "iframe_jd_text").collect()
    assert sorted(r["url"] for r in kept) == ["u4", "u5"]


@pytest.mark.parametrize("name", ["공고.csv", "with blank.csv", "100%.csv", "a%20b.csv", "c#1.csv", "d+e.csv", "[x].csv"])
def test_odd_names_are_read(spark, tmp_path, name):
    (tmp_path / name).write_text("company,url,iframe_jd_text\nA,u1,body\n", encoding="utf-8")
    rows = csv_parts.scan_csv_parts(spark, str(tmp_path)).collect()
    assert [(r["company"], r["url"], r["iframe_jd_text"]) for r in rows] == [("A", "u1", "body")]
    assert rows[0]["ord"]["path"].endswith("/" + name)


@pytest.mark.parametrize("rows", [1, 60_000])
def test_bad_bytes_skip_a_file_of_any_size(spark, tmp_path, rows):
    good = "company,url,iframe_jd_text\n" + "A,u,some text of a posting\n" * rows
    (tmp_path / "bad.csv").write_bytes(good.encode() + b"B,v,\xff\n")
    (tmp_path / "good.csv").write_text(good)
    assert csv_parts.scan_csv_parts(spark, f"{tmp_path}/*.csv").count() == rows
    skipped = csv_parts.skipped_csv_files(spark, f"{tmp_path}/*.csv").collect()
    assert [(r["path"].rpartition("/")[2], r["reason"]) for r in skipped] == [("bad.csv", f"not UTF-8 at byte {len(good) + 4}")]


def test_skipped_files_have_reasons(spark, parts):
    found = {r["path"].rpartition("/")[2]: r["reason"] for r in csv_parts.skipped_csv_files(spark, f"{parts}/p_*.csv").collect()}
    assert found == {
        "p_11.csv": "no column iframe_jd_text", "p_12.csv": "too many fields in row 2",
        "p_15.csv": "not UTF-8 at byte 27",
    }


def test_of_a_repeated_name_the_first_column_counts(spark, tmp_path):
    (tmp_path / "p.csv").write_text("url,iframe_jd_text,url\nu1,body,u2\n")
    rows = csv_parts.scan_csv_parts(spark, str(tmp_path)).collect()
    assert [(r["company"], r["url"], r["iframe_jd_text"]) for r in rows] == [(None, "u1", "body")]


def test_paths_are_ordered_as_spelled(spark, tmp_path):
    for name in ("b c.csv", "b.csv", "bz.csv", "가.csv", "b%.csv"):
        (tmp_path / name).write_text(f"iframe_jd_text\n{name}\n", encoding="utf-8")
    rows = csv_parts.scan_csv_parts(spark, str(tmp_path), keep=["iframe_jd_text"]).orderBy("ord").collect()
    assert [r["iframe_jd_text"] for r in rows] == sorted(["b c.csv", "b.csv", "bz.csv", "가.csv", "b%.csv"])
    (tmp_path / "text").mkdir()
    for name in ("b c.txt", "b.txt", "가+.txt"):
        (tmp_path / "text" / name).write_text(name, encoding="utf-8")
    lines = text_lines.scan_corpus_lines(spark, f"{tmp_path}/text").orderBy("ord").collect()
    assert [r["value"] for r in lines] == sorted(["b c.txt", "b.txt", "가+.txt"])


def test_no_usable_file_is_an_error(spark, parts):
    with pytest.raises(ValueError, match="no usable"):
        csv_parts.scan_csv_parts(spark, f"{parts}/p_11.csv")


def test_links(spark, tmp_path):
    path = tmp_path / "links.csv"
    path.write_text(f"{BOM}text,href,className\n  Job 　,/Recruit/GI_Read/1 ,c\n,/Recruit/GI_Read/2,\nX,/other,\n", encoding="utf-8")
    links = csv_parts.scan_link_csv(spark, str(path))
    rows = links.orderBy("ord").collect()
    assert [(r["text"], r["href"], r["className"]) for r in rows] == [
        ("Job", "/Recruit/GI_Read/1", "c"), ("", "/Recruit/GI_Read/2", ""), ("X", "/other", "")]
    assert [r["href"] for r in csv_parts.filter_link_pattern(links).collect()] == ["/Recruit/GI_Read/1"]


def test_csv_parts_keep_order_and_text(spark, tmp_path):
    texts = [f'  t{i} "q"\r\nx, ' if i % 3 else None for i in range(25)]
    df = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "ord int, company string, body string").repartition(5)
    path = new_path(spark, "parts")
    sinks.sink_csv_parts(df, path, "ord", size=10)
    back = spark.read.schema("company string, body string, part int").options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    sizes = {r["part"]: r["count"] for r in back.groupBy("part").count().collect()}
    assert sizes == {1: 10, 2: 10, 3: 5}
    first = [r["body"] for r in back.filter("part = 1").collect()]
    assert first == texts[:10]


def test_corpus_lines_are_stripped(spark):
    path = new_path(spark, "corpus")
    spark.createDataFrame([("  a b 　",), ("",), (" \t ",), ("c",)], "value string").coalesce(1).write.text(path)
    rows = text_lines.scan_corpus_lines(spark, path).orderBy("ord").collect()
    assert [r["value"] for r in rows] == ["a b", "c"]


def test_url_lists(spark):
    rows = url_ranges.gen_url_range(spark, 49100001, 49100003).orderBy("number").collect()
    assert [(r["list_title"], r["url"]) for r in rows] == [
        ("임시 공고 (49100001)", "https://www.jobkorea.co.kr/Recruit/GI_Read/49100001"),
        ("임시 공고 (49100002)", "https://www.jobkorea.co.kr/Recruit/GI_Read/49100002")]
    pages = url_ranges.gen_page_urls(spark.createDataFrame([("ai",)], "term string"), "term").orderBy("page_no").collect()
    assert len(pages) == 10 and pages[9]["url"].endswith("stext=ai&FeatureCode=IDS&tabType=recruit&careerType=1&Page_No=10")


def test_page_parts(spark):
    df = spark.createDataFrame([(1, "<body><h1>T</h1><a href='/x'>l</a><div>" + "y" * 400 + "</div></body>")], "page_id long, html string")
    path = new_path(spark, "pages")
    sinks.sink_page_parts(df, path)
    kinds = {r["kind"]: r["part"] for r in spark.read.schema("page_id long, part string, kind string").json(path).collect()}
    assert kinds["heading"] == '{"tag":"H1","text":"T","className":""}' and set(kinds) == {"heading", "link", "block", "body"}


def test_frames_that_are_appended_keep_the_order_of_the_files(spark):
    source, text = new_path(spark, "source"), new_path(spark, "text")
    rows = spark.range(1000).select(F.format_string("line %04d", "id").alias("clean_text"), F.lit("x").alias("other"))
    # files of 30 rows, several of each task, more and less at the end of a task
    rows.repartitionByRange(7, "clean_text").sortWithinPartitions("clean_text").write.option("maxRecordsPerFile", 30).parquet(source)
    frames = list(sinks.runs_in_order(spark, source, "clean_text", runs=4))
    assert len(frames) == 4 and all(150 < frame.count() < 350 for frame in frames)
    for frame in frames:
        sinks.sink_corpus_text(frame, text, mode="append")
    lines = [r["value"] for r in text_lines.scan_corpus_lines(spark, text).orderBy("ord").collect()]
    assert lines == [f"line {i:04d}" for i in range(1000)]
    # one file of text for each file of the table
    filled = [r["length"] for r in spark.read.format("binaryFile").load(text).select("length").collect() if r["length"]]
    assert len(filled) == spark.read.format("binaryFile").load(source).select("path").count() >= 34


def test_clean_table_is_compressed_well(spark):
    path = new_path(spark, "clean")
    sinks.sink_clean_parquet(spark.range(10).select(F.col("id").cast("string").alias("clean_text")), path)
    assert {r["path"].rsplit(".", 2)[1] for r in spark.read.format("binaryFile").load(path).select("path").collect()} == {"zstd"}
