"""Joins, deduplication, profiling, ranking and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.text import stripped_lines
from siftwell.operators import dedup as D
from siftwell.operators import heavy_hitters as HH
from siftwell.operators import profile as P
from siftwell.operators import ranking as R
from siftwell.plans.index import posting_outcomes
from siftwell.queries import sql
from siftwell.queries.registry import NOISY, ORACLES, digest, noisy_documents, query, table, text_table
from siftwell.queries.text_queries import CLEANED, cleaned_documents
from siftwell.session import stage


@query(
    "dedup_url_first",
    "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def url_first(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", F.col("user_id"))
    return D.keep_first(rows, F.col("user_id"), "event_id").select("user_id", "event_id", "event_type")


@query(
    "distinct_raw_text",
    f"""WITH {NOISY} SELECT min(doc_id) AS doc_id, md5(body) AS result FROM noisy
    WHERE {sql.strip('body')} <> '' GROUP BY body""",
)
def raw_distinct(spark, folder):
    rows = noisy_documents(spark, folder).select("doc_id", "body")
    return D.distinct_raw_text(rows, "body", "doc_id").select("doc_id", digest(F.col("body")).alias("result"))


# every fourth posting repeats the address of the one before
_URL = "'u/' || (doc_id - CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END)"
_INCOMING = f"SELECT doc_id AS ord, {_URL} AS url FROM documents"
_EXISTING = f"SELECT DISTINCT {_URL} AS url FROM documents JOIN labels USING (doc_id)"


def _incoming(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("ord"), F.expr(_URL).alias("url"))


def _existing(spark, folder):
    known = _incoming(spark, folder).join(table(spark, folder, "labels").select(F.col("doc_id").alias("ord")), "ord", "left_semi")
    return known.select("url").distinct()


@query(
    "new_postings_anti",
    f"SELECT min(ord) AS ord, url FROM ({_INCOMING}) WHERE url NOT IN ({_EXISTING}) GROUP BY url",
)
def new_postings(spark, folder):
    return D.new_postings_anti(_incoming(spark, folder), _existing(spark, folder)).select("ord", "url")


@query(
    "ingest_outcomes",
    f"""WITH i AS (SELECT ord, url, ord % 5 <> 2 AS ok FROM ({_INCOMING})),
    f AS (SELECT *, min(CASE WHEN ok THEN ord END) OVER (PARTITION BY url) AS first_ok,
          url IN ({_EXISTING}) AS known FROM i)
    SELECT CASE WHEN known OR first_ok < ord THEN 'skip' WHEN ok THEN 'success' ELSE 'fail' END AS outcome,
           count(*) AS n FROM f GROUP BY 1""",
)
def outcomes(spark, folder):
    rows = _incoming(spark, folder).withColumn("ok", F.col("ord") % 5 != 2)
    return P.outcome_counts(posting_outcomes(rows, _existing(spark, folder)))


_LINES = (
    f"lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, {sql.lines('body')} AS l, "
    f"unnest(range(1, len({sql.lines('body')}) + 1)) AS i FROM noisy) WHERE l[i] <> '')"
)


@query(
    "lines_not_in_list",
    f"""WITH {NOISY}, {_LINES},
    listed AS (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT doc_id) >= 0.05 * (SELECT count(*) FROM noisy))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line FROM lines
    WHERE line NOT IN (SELECT line FROM listed)""",
)
def lines_not_in_list(spark, folder):
    """The list comes from the data: lines found in one document out of twenty."""
    documents = noisy_documents(spark, folder).select("doc_id", "body")
    listed = P.lines_in_share(documents, "body", 0.05)
    kept = P.lines_not_listed(P.exploded_lines(documents, "body", "doc_id"), listed)
    return kept.select("doc_id", "line_no", digest(F.col("line")).alias("line"))


@query(
    "boilerplate_by_frequency",
    f"""WITH {NOISY}, {_LINES} SELECT line, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY line
    HAVING count(DISTINCT doc_id) >= 0.02 * (SELECT count(*) FROM noisy)""",
)
def boilerplate(spark, folder):
    return P.lines_in_share(noisy_documents(spark, folder), "body", 0.02)


@query(
    "top_repeated_lines",
    f"""WITH {NOISY}, u AS (SELECT min(doc_id) AS doc_id, body FROM noisy GROUP BY body),
    lines AS (SELECT unnest({sql.lines('body')}) AS line FROM u)
    SELECT line, count(*) AS n FROM lines WHERE line <> '' GROUP BY line ORDER BY n DESC, line LIMIT 20""",
)
def repeated_lines(spark, folder):
    """Over unique bodies; bodies are made distinct by hash first."""
    rows = noisy_documents(spark, folder).select("doc_id", "body")
    return P.top_repeated_lines(D.keep_first(rows, D.content_key(F.col("body")), "doc_id"), "body", 20)


@query("top_lines_by_summary", ORACLES["top_repeated_lines"])
def repeated_lines_by_summary(spark, folder):
    """The same by bounded summaries and one exact count of the lines that they leave."""
    rows = noisy_documents(spark, folder).select("doc_id", "body")
    return HH.top_lines(D.keep_first(rows, D.content_key(F.col("body")), "doc_id"), "body", 20)


@query("boilerplate_by_summary", ORACLES["boilerplate_by_frequency"])
def boilerplate_by_summary(spark, folder):
    return HH.lines_in_share(noisy_documents(spark, folder), "body", 0.02)


@query(
    "chunk_to_posting",
    "SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def chunk_parent(spark, folder):
    chunks = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    postings = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return D.chunk_to_posting(chunks, postings, "l_orderkey", "o_orderkey").drop("o_orderkey")


@query(
    "cascade_chunks",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')",
)
def cascade(spark, folder):
    chunks = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    surviving = table(spark, folder, "orders").filter("o_orderstatus <> 'F'")
    return D.cascade_chunks(chunks, surviving, "l_orderkey", "o_orderkey")


@query(
    "zip_chunks_vectors",
    f"""WITH {NOISY}, z AS (SELECT doc_id, {sql.lines('body')} AS l, string_split(source || ',' || lang || ',' || n_chars, ',') AS v
        FROM noisy),
    i AS (SELECT doc_id, l, v, unnest(range(1, least(len(l), len(v)) + 1)) AS i FROM z)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, md5(l[i]) AS chunk, v[i] AS vector FROM i""",
)
def zipped(spark, folder):
    rows = noisy_documents(spark, folder).select(
        "doc_id", stripped_lines(F.col("body")).alias("l"),
        F.array("source", "lang", F.col("n_chars").cast("string")).alias("v"),
    )
    pairs = rows.select("doc_id", F.posexplode(D.zip_chunks_vectors(F.col("l"), F.col("v"))).alias("position", "p"))
    return pairs.select("doc_id", "position", digest(F.col("p.chunk_text")).alias("chunk"), F.col("p.vector").alias("vector"))


@query(
    "corpus_stats",
    f"""WITH {CLEANED}, u AS (SELECT DISTINCT clean_text FROM cleaned)
    SELECT 'read' AS stage, count(*) AS n_rows, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM noisy
    UNION ALL SELECT 'cleaned', count(*), CAST(sum(length(clean_text)) AS BIGINT) FROM cleaned
    UNION ALL SELECT 'unique', count(*), CAST(sum(length(clean_text)) AS BIGINT) FROM u""",
)
def stats(spark, folder):
    """The cleaned rows are staged, as in the corpus job, so that texts are cleaned once."""
    raw = noisy_documents(spark, folder)
    cleaned = stage(cleaned_documents(spark, folder).select("doc_id", "clean_text"), "cleaned")
    unique = D.dedup_clean_text(cleaned, "clean_text", "doc_id")
    return P.corpus_stats({"read": (raw, "body"), "cleaned": (cleaned, "clean_text"), "unique": (unique, "clean_text")})


@query(
    "corpus_profile",
    """WITH d AS (SELECT nullif(text, '') AS body FROM documents UNION ALL SELECT NULL FROM documents WHERE doc_id % 5 < 2),
    u AS (SELECT DISTINCT body FROM d WHERE body IS NOT NULL)
    SELECT (SELECT count(*) FROM d) AS n_rows, (SELECT count(body) FROM d) AS n_bodies, count(*) AS n_unique,
        CAST(sum(length(body)) AS BIGINT) AS n_chars,
        CAST(sum(len(regexp_extract_all(body, '\\S+'))) AS BIGINT) AS n_tokens,
        round(avg(length(body)), 6) AS mean_chars FROM u""",
)
def corpus_profile(spark, folder):
    """All documents, and as many rows again as two fifths of them without a body: missing or empty."""
    documents = text_table(spark, folder, "documents", "doc_id")
    without = documents.filter("doc_id % 5 < 2").select(F.when(F.col("doc_id") % 5 == 1, F.lit("")).alias("body"))
    rows = documents.select(F.col("text").alias("body")).unionAll(without)
    return P.corpus_profile(rows, "body").withColumn("mean_chars", F.round("mean_chars", 6))


@query(
    "topk_blocks_per_page",
    f"""WITH {NOISY}, {_LINES}, ranked AS (SELECT doc_id, line_no, length(line) AS n,
        row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line_no) AS rank FROM lines)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, n, rank FROM ranked WHERE rank <= 30""",
)
def topk_blocks(spark, folder):
    """The 30 longest lines per document; the lines of one document never leave its row."""
    lines = F.transform(
        stripped_lines(F.col("body")),
        lambda line, i: F.struct(i.alias("line_no"), F.length(line).alias("n")),
    )
    top = R.longest_first(F.filter(lines, lambda b: b["n"] > 0), "n", "line_no", 30)
    rows = noisy_documents(spark, folder).select("doc_id", F.posexplode(top).alias("position", "b"))
    return rows.select(
        "doc_id", "b.line_no", F.col("b.n").cast("long").alias("n"), (F.col("position") + 1).cast("long").alias("rank")
    )


@query(
    "head_lines",
    f"""WITH {NOISY} SELECT doc_id, md5(replace(body, chr(10), ' ')) AS line FROM noisy ORDER BY doc_id LIMIT 5000""",
)
def head(spark, folder):
    rows = noisy_documents(spark, folder).select("doc_id", "body")
    line = F.replace("body", F.lit("\n"), F.lit(" "))
    return R.head_lines(rows, "doc_id").select("doc_id", digest(line).alias("line"))


@query(
    "first_n_links",
    "SELECT page_id, url FROM pages WHERE contains(url, '/en/') ORDER BY page_id LIMIT 3",
)
def first_links(spark, folder):
    links = table(spark, folder, "pages").filter(F.col("url").contains("/en/")).select("page_id", "url")
    return R.first_n_links(links, "page_id", 3)


@query("preview_head", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 30")
def preview(spark, folder):
    return R.preview_head(table(spark, folder, "events"), ["event_id", "event_type", "value"], "event_id")


_NUMBERED = "SELECT event_id, row_number() OVER (ORDER BY event_id) AS idx FROM events"


@query("number_rows", f"SELECT event_id, idx, (idx - 1) // 1000 + 1 AS part FROM ({_NUMBERED})")
def numbered(spark, folder):
    rows = table(spark, folder, "events").select("event_id")
    return R.number_rows(rows, "event_id").withColumn("part", R.part_of(F.col("idx")))


@query(
    "union_by_name",
    "SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS quantity FROM orders UNION ALL "
    "SELECT l_orderkey, NULL, l_quantity FROM lineitem",
)
def unioned(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("id"))
    return R.union_by_name([orders, lines]).select("id", "status", "quantity")
