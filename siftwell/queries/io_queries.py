"""Readers and writers: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions.text import flatten_newlines
from siftwell.operators import html as H
from siftwell.operators.chunking import chunk_point_id
from siftwell.operators.dedup import dedup_clean_text
from siftwell.operators.ranking import number_rows
from siftwell.operators.wordpiece import VOCAB_SIZE, word_counts
from siftwell.plans.corpus import build_corpus
from siftwell.plans.index import index_postings
from siftwell.plans.vocabulary import train_vocab
from siftwell.queries import sql
from siftwell.queries.html_queries import LINKS, text_of
from siftwell.queries.html_queries import HREF as HREF_SQL
from siftwell.queries.registry import NOISY, digest, noisy_documents, query, table, text_table
from siftwell.queries.text_queries import CLEANED, cleaned_documents
from siftwell.queries.token_queries import COUNTS, WORDS, _bodies
from siftwell.session import discard, new_path, spent_shuffles_removed
from siftwell.sources import csv_parts, sinks, text_lines, url_ranges
from siftwell.sources.points import create_points, read_points, upsert_into


def _write_csv(df, path, header=True):
    trim = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("append").options(header=header, quote='"', escape='"', **trim).csv(path)


def _raw_parts(spark, folder, path):
    """CSV parts as a crawler leaves them: three headers under odd names; beside them parts without a body and broken ones."""
    rows = noisy_documents(spark, folder).select(
        "doc_id", F.col("source").alias("company"), F.concat(F.lit("u/"), "doc_id").alias("url"),
        F.col("body").alias("iframe_jd_text"),
    )
    group = F.col("doc_id") % 3
    broken = F.concat_ws("\n", F.lit("company,url,iframe_jd_text"), F.concat_ws(",", "company", "url", F.lit("t"), F.lit("more")))
    with spent_shuffles_removed(spark):
        _write_csv(rows.filter(group == 0).select("company", "url", "iframe_jd_text"), f"{path}/공고 모음")
        _write_csv(rows.filter(group == 1).select("iframe_jd_text", F.lit("x").alias("status"), "url", "company"), f"{path}/part #1 20%")
        _write_csv(rows.filter(group == 2).select("url", "iframe_jd_text"), f"{path}/plain")
        _write_csv(rows.filter("doc_id % 5 = 0").select("company", "url"), f"{path}/no body")
        rows.filter("doc_id % 5 = 1").select(broken.alias("value")).write.text(f"{path}/broken")
    return f"{path}/*/part-*"


@query(
    "scan_csv_parts",
    f"""WITH {NOISY} SELECT CASE WHEN doc_id % 3 <> 2 THEN source END AS company, 'u/' || doc_id AS url, md5(body) AS body FROM noisy""",
)
def scan_parts(spark, folder):
    rows = csv_parts.scan_csv_parts(spark, _raw_parts(spark, folder, new_path(spark, "parts")), ord=False)
    return rows.select("company", "url", digest(F.col("iframe_jd_text")).alias("body"))


@query(
    "scan_csv_single",
    f"WITH {NOISY} SELECT source AS company, 'u/' || doc_id AS url, md5(body) AS body, NULL AS error FROM noisy",
)
def scan_single(spark, folder):
    path = new_path(spark, "raw")
    rows = noisy_documents(spark, folder).select(
        F.col("source").alias("company"), F.concat(F.lit("u/"), "doc_id").alias("url"),
        F.col("body").alias("iframe_jd_text"), F.lit("").alias("error"),
    )
    _write_csv(rows, path)
    back = csv_parts.scan_csv_single(spark, path, ord=False)
    return back.select("company", "url", digest(F.col("iframe_jd_text")).alias("body"), "error")


@query(
    "scan_link_csv",
    f"""WITH {LINKS} SELECT {text_of('a', repr(''))} AS text, {HREF_SQL} AS href, '' AS "className" FROM links""",
)
def scan_links(spark, folder):
    path = new_path(spark, "links")
    pages = text_table(spark, folder, "pages", "page_id").select(H.parse_html(F.col("html"), ["a"]).alias("dom"))
    links = pages.select(F.explode(H.links(F.col("dom"))).alias("l"))
    padded = links.select(F.concat(F.lit(" "), "l.text").alias("text"), "l.href", "l.className")
    _write_csv(padded, path)
    return csv_parts.scan_link_csv(spark, path, ord=False).select("text", "href", "className")


_FLAT = "replace(body, chr(10), ' ')"


@query(
    "sink_corpus_text",
    f"WITH {CLEANED} SELECT md5(replace(clean_text, chr(10), ' ')) AS line, count(*) AS n FROM cleaned GROUP BY 1",
)
def corpus_text(spark, folder):
    path = new_path(spark, "corpus")
    sinks.sink_corpus_text(cleaned_documents(spark, folder), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.groupBy(digest(F.col("value")).alias("line")).agg(F.count("*").alias("n"))


@query(
    "scan_corpus_lines",
    f"WITH {NOISY} SELECT md5({sql.strip(_FLAT)}) AS line FROM noisy WHERE {sql.strip(_FLAT)} <> ''",
)
def corpus_lines(spark, folder):
    path = new_path(spark, "corpus")
    rows = noisy_documents(spark, folder).select(flatten_newlines(F.col("body")).alias("value"))
    rows.write.option("lineSep", "\n").text(path)
    return text_lines.scan_corpus_lines(spark, path, ord=False).select(digest(F.col("value")).alias("line"))


@query(
    "sink_clean_parquet",
    f"""WITH {CLEANED} SELECT min(doc_id) AS doc_id, md5(clean_text) AS clean, length(clean_text) AS n FROM cleaned
    GROUP BY clean_text""",
)
def clean_parquet(spark, folder):
    path = new_path(spark, "clean")
    sinks.sink_clean_parquet(dedup_clean_text(cleaned_documents(spark, folder), "clean_text", "doc_id"), path)
    back = spark.read.parquet(path)
    return back.select("doc_id", digest(F.col("clean_text")).alias("clean"), F.length("clean_text").cast("long").alias("n"))


def _event_parts(spark, folder, size):
    path = new_path(spark, "event-parts")
    events = table(spark, folder, "events").select("event_id", "event_type", "value", "props", F.col("event_id").alias("ord"))
    sinks.sink_csv_parts(events, path, "ord", size)
    return path


@query(
    "sink_csv_parts",
    "SELECT event_id, event_type, value, props, (row_number() OVER (ORDER BY event_id) - 1) // 1000 + 1 AS part FROM events",
)
def event_parts(spark, folder):
    path = _event_parts(spark, folder, 1000)
    schema = "event_id long, event_type string, value double, props string, part long"
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)


@query(
    "file_order",
    """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS idx FROM events)
    SELECT event_id, row_number() OVER (ORDER BY CAST((idx - 1) // 500 + 1 AS VARCHAR), idx) AS position FROM n""",
)
def file_order(spark, folder):
    """Parts are read in path order, in which part 10 comes before part 2."""
    path = f"{_event_parts(spark, folder, 500)}/*/*.csv"
    rows = csv_parts.scan_csv_parts(spark, path, required="event_id", keep=["event_id"])
    numbered = number_rows(rows, "ord", name="position")
    return numbered.select(F.col("event_id").cast("long").alias("event_id"), "position")


@query(
    "gen_url_range",
    """SELECT '임시 공고 (' || i || ')' AS list_title, 'https://www.jobkorea.co.kr/Recruit/GI_Read/' || i AS url
    FROM (SELECT unnest(range(min(doc_id), max(doc_id) + 1)) AS i FROM documents)""",
)
def url_range(spark, folder):
    """The range of numbers in use."""
    ends = table(spark, folder, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    return url_ranges.gen_url_range(spark, ends[0], ends[1] + 1).select("list_title", "url")


@query(
    "gen_page_urls",
    """SELECT source, CAST(p AS INTEGER) AS page_no, 'https://www.jobkorea.co.kr/Search/?stext=' || source ||
        '&FeatureCode=IDS&tabType=recruit&careerType=1&Page_No=' || p AS url
    FROM (SELECT source, unnest(range(1, (count(*) + 9) // 10 + 1)) AS p FROM documents GROUP BY source)""",
)
def search_pages(spark, folder):
    """Ten results a page: as many pages per source as it has documents for."""
    sources = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return url_ranges.gen_page_urls(sources, "source", F.ceil(F.col("n") / 10))


@query(
    "sink_postings",
    """WITH old AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS id FROM pages WHERE page_id % 3 = 0)
    SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY page_id) AS id, page_id % 11 || ' Ltd' AS company, url,
        NULL AS status FROM pages WHERE page_id % 3 <> 0""",
)
def postings(spark, folder):
    """Two runs: the second continues the numbers of the first."""
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("ord"), F.concat((F.col("page_id") % 11).cast("string"), F.lit(" Ltd")).alias("company"), "url"
    )
    first, second = new_path(spark, "posts-1"), new_path(spark, "posts-2")
    sinks.sink_postings(sinks.posting_rows(pages.filter("ord % 3 = 0"), "ord"), first)
    known = spark.read.parquet(first)
    sinks.sink_postings(sinks.posting_rows(pages.filter("ord % 3 <> 0"), "ord", known), second)
    return spark.read.parquet(second).select("id", "company", "url", "status")


@query(
    "sink_chunks",
    """SELECT conv_id AS job_post_id, turn AS chunk_index, md5(text) AS chunk, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4),
        substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS point_id
    FROM (SELECT *, md5(conv_id || ':' || turn) AS h FROM conversations)""",
)
def chunk_rows(spark, folder):
    path = new_path(spark, "chunks")
    turns = text_table(spark, folder, "conversations", "conv_id").select(
        F.col("conv_id").alias("job_post_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("chunk_text"),
        chunk_point_id(F.col("conv_id"), F.col("turn")).alias("point_id"),
    )
    sinks.sink_chunks(turns, path)
    back = spark.read.parquet(path)
    return back.select("job_post_id", "chunk_index", digest(F.col("chunk_text")).alias("chunk"), "point_id")


@query(
    "sink_vectors",
    """SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN label + 100 ELSE label END AS label,
        round(CAST(embedding[CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END] AS DOUBLE), 6) AS head FROM embeddings
    UNION ALL SELECT vec_id + 1000000, label + 100, round(CAST(embedding[2] AS DOUBLE), 6) FROM embeddings WHERE label % 2 = 0""",
)
def points(spark, folder):
    """Points of even label come again, changed, and once more under new ids."""
    path = new_path(spark, "points")
    current = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    changed = current.filter("label % 2 = 0").select("id", (F.col("label") + 100).alias("label"), F.slice("vector", 2, 1).alias("vector"))
    incoming = changed.unionByName(changed.withColumn("id", F.col("id") + 1_000_000))
    create_points(current, path, buckets=64)
    upsert_into(path, incoming)
    return read_points(spark, path).select("id", "label", F.round(F.col("vector")[0].cast("double"), 6).alias("head"))


@query(
    "sink_vocab",
    f"""WITH {NOISY}, {WORDS}, {COUNTS} SELECT word AS token, CAST(row_number() OVER (ORDER BY freq DESC, word) - 1 AS INTEGER) AS id
    FROM counts ORDER BY id LIMIT {VOCAB_SIZE}""",
)
def vocab_file(spark, folder):
    path = new_path(spark, "vocab")
    top = word_counts(_bodies(spark, folder), "body").orderBy(F.desc("freq"), "word").limit(VOCAB_SIZE)
    # at most VOCAB_SIZE rows are left to number
    number = F.row_number().over(Window.orderBy(F.desc("freq"), "word")) - 1
    sinks.sink_vocab(top.select(F.col("word").alias("token"), number.alias("id")), path)
    return text_lines.scan_vocab(spark, path)


@query(
    "sink_page_parts",
    f"""WITH {LINKS} SELECT 'heading' AS kind, count(*) AS n FROM pages UNION ALL SELECT 'body', count(*) FROM pages
    UNION ALL SELECT 'link', count(*) FROM links
    UNION ALL SELECT 'block', count(*) FROM (
        SELECT {text_of("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)", repr(' '))} AS t FROM pages UNION ALL
        SELECT {text_of("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)", repr(' '))} FROM pages) WHERE length(t) > 300""",
)
def page_parts(spark, folder):
    path = new_path(spark, "page-parts")
    sinks.sink_page_parts(text_table(spark, folder, "pages", "page_id").select("page_id", "html"), path)
    back = spark.read.schema("page_id long, part string, kind string").json(path)
    return back.groupBy("kind").agg(F.count("part").alias("n"))


@query(
    "build_corpus",
    f"""WITH {CLEANED}, u AS (SELECT DISTINCT clean_text FROM cleaned)
    SELECT 'read' AS stage, count(*) AS n_rows, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM noisy
    UNION ALL SELECT 'cleaned', count(*), CAST(sum(length(clean_text)) AS BIGINT) FROM cleaned
    UNION ALL SELECT 'unique', count(*), CAST(sum(length(clean_text)) AS BIGINT) FROM u""",
)
def corpus_job(spark, folder):
    """The whole corpus job over CSV parts with mixed headers, which were made for it and go when they are read."""
    parts = new_path(spark, "parts")
    raw = _raw_parts(spark, folder, parts)
    return build_corpus(spark, raw, new_path(spark, "corpus"), new_path(spark, "clean"), once_read=lambda: discard(spark, parts))


@query(
    "index_postings",
    """WITH i AS (SELECT doc_id AS ord, 'u/' || (doc_id - CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END) AS url, true AS ok FROM documents
        UNION ALL SELECT -1 - doc_id, CASE WHEN doc_id % 2 = 0 THEN 'u/' || doc_id ELSE 'bad/' || doc_id END, false FROM documents
        WHERE doc_id % 5 = 2),
    f AS (SELECT *, min(CASE WHEN ok THEN ord END) OVER (PARTITION BY url) AS first_ok FROM i)
    SELECT CASE WHEN first_ok < ord THEN 'skip' WHEN ok THEN 'success' ELSE 'fail' END AS outcome, count(*) AS n FROM f GROUP BY 1""",
)
def index_job(spark, folder):
    """The whole index job: URLs repeat, and as many postings again as a fifth come with broken JSON-LD, half of them under a
    URL of their own."""
    documents = text_table(spark, folder, "documents", "doc_id")
    rows = documents.select(
        F.col("doc_id").alias("ord"), F.col("source").alias("company"),
        F.expr("'u/' || (doc_id - CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END)").alias("url"),
        F.col("text").alias("iframe_jd_text"), F.to_json(F.struct("lang", "source")).alias("json_ld"),
    )
    broken = documents.filter("doc_id % 5 = 2").select(
        (-1 - F.col("doc_id")).alias("ord"), F.col("source").alias("company"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'u/' || doc_id ELSE 'bad/' || doc_id END").alias("url"),
        F.col("text").alias("iframe_jd_text"), F.lit("{").alias("json_ld"),
    )
    return index_postings(rows.unionAll(broken), new_path(spark, "index"))


@query("train_vocab")
def vocab_job(spark, folder):
    """The whole vocabulary job, in its morpheme variant; returns the unknown-token rate."""
    corpus = new_path(spark, "corpus")
    sinks.sink_corpus_text(cleaned_documents(spark, folder), corpus)
    return train_vocab(spark, corpus, new_path(spark, "vocab"), morphemes=True)
