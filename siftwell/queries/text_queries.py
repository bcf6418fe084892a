"""Cleaning, filters and scalar text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.dedup import dedup_clean_text
from siftwell.operators.profile import text_lengths
from siftwell.plans.corpus import clean_postings
from siftwell.plans.index import filter_success, project_posting
from siftwell.queries import sql
from siftwell.queries.registry import NOISY, digest, noisy_documents, query, table, text_table
from siftwell.session import stage
from siftwell.sources.csv_parts import filter_link_pattern, prune_columns


def _noisy_query(name, operator, oracle):
    """A text operator over the noisy bodies: the hash and the length of its result per document."""

    @query(
        name,
        f"WITH {NOISY} SELECT doc_id, md5(r) AS result, length(r) AS n FROM (SELECT doc_id, {oracle} AS r FROM noisy)",
    )
    def run(spark, folder):
        result = operator(F.col("body"))
        return (
            noisy_documents(spark, folder)
            .select("doc_id", result.alias("r"))
            .select("doc_id", digest(F.col("r")).alias("result"), F.length("r").cast("long").alias("n"))
        )


_noisy_query("bullets_to_space", T.bullets_to_space, sql.bullets("body"))
_noisy_query("normalize_nfkc", T.normalize_nfkc, sql.nfkc("body"))
_noisy_query("collapse_line_ws", T.collapse_line_ws, sql.join_lines(sql.lines(sql.blanks("body"))))
_noisy_query(
    "drop_exact_lines",
    lambda c: T.drop_exact_lines(T.collapse_line_ws(T.bullets_to_space(c))),
    sql.join_lines(sql.keep_exact(sql.lines(sql.blanks(sql.bullets("body"))))),
)
_noisy_query(
    "drop_pattern_lines",
    lambda c: T.drop_pattern_lines(T.collapse_line_ws(T.normalize_nfkc(c))),
    sql.join_lines(sql.keep_pattern(sql.lines(sql.blanks(sql.nfkc("body"))))),
)
_noisy_query("clean_text", T.clean_text, sql.clean("body"))
_noisy_query("flatten_newlines", T.flatten_newlines, "replace(body, chr(10), ' ')")
_noisy_query(
    "collapse_blank_lines",
    lambda c: T.collapse_blank_lines(F.regexp_replace(c, r"\. ", ".\n\n\n\n"), blanks=True),
    sql.strip(
        r"regexp_replace(regexp_replace(replace(body, '. ', '.' || repeat(chr(10), 4)), '\n{3,}', chr(10) || chr(10), 'g'), "
        r"'[ \t]{2,}', ' ', 'g')"
    ),
)
_noisy_query("truncate_preview", lambda c: T.truncate_preview(c, 500), "substr(body, 1, 500)")
_noisy_query(
    "join_parts",
    lambda c: T.join_parts(F.array(F.when(F.col("doc_id") % 3 != 0, F.col("source")), c, F.lit(None)), "\n\n"),
    "concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 3 <> 0 THEN source END, body)",
)

CLEANED = (
    f"{NOISY}, cleaned AS (SELECT * FROM (SELECT doc_id, lang, source, body, {sql.clean('body')} AS clean_text FROM noisy "
    f"WHERE body <> '') WHERE length(clean_text) >= 30)"
)


def cleaned_documents(spark, folder):
    return clean_postings(noisy_documents(spark, folder).select("doc_id", "lang", "source", "body"), "body")


@query(
    "filter_min_length",
    f"WITH {CLEANED} SELECT doc_id, length(clean_text) AS n FROM cleaned",
)
def filter_min_length(spark, folder):
    return cleaned_documents(spark, folder).select("doc_id", F.length("clean_text").cast("long").alias("n"))


@query(
    "clean_corpus_by_lang",
    f"""WITH {CLEANED}, firsts AS (
        SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) AS rn FROM cleaned)
    SELECT lang, count(*) AS docs, count(*) FILTER (rn = 1) AS unique_docs,
           CAST(sum(CASE WHEN rn = 1 THEN length(clean_text) ELSE 0 END) AS BIGINT) AS chars
    FROM firsts GROUP BY lang""",
)
def clean_corpus_by_lang(spark, folder):
    """Flagship: noise -> clean -> length filter -> first-wins dedup -> counts per language.

    Instead of a join back to the bodies, the first row of each text carries the language along: a
    text keeps (smallest id, its language) and the copies are counted per language on the way.
    """
    from siftwell.operators.dedup import content_key

    cleaned = cleaned_documents(spark, folder)
    copies = (
        cleaned.select(
            content_key(F.col("clean_text")).alias("key"), "lang", "doc_id", F.length("clean_text").alias("n")
        )
        .groupBy("key", "lang")
        .agg(F.count("*").alias("docs"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    )
    # one row per text: its copies by language and the language of the first copy
    by_text = copies.groupBy("key").agg(
        F.collect_list(F.struct("lang", "docs")).alias("langs"), F.min_by("lang", "doc_id").alias("first"), F.max("n").alias("n")
    )
    return (
        by_text.select("first", "n", F.explode("langs").alias("l"))
        .groupBy(F.col("l.lang").alias("lang"))
        .agg(
            F.sum("l.docs").alias("docs"),
            F.count(F.when(F.col("l.lang") == F.col("first"), 1)).alias("unique_docs"),
            F.sum(F.when(F.col("l.lang") == F.col("first"), F.col("n")).otherwise(0)).alias("chars"),
        )
    )


@query(
    "dedup_clean_text",
    f"""WITH {CLEANED}, firsts AS (
        SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) AS rn FROM cleaned)
    SELECT doc_id, source, md5(clean_text) AS result FROM firsts WHERE rn = 1""",
)
def dedup_clean(spark, folder):
    cleaned = stage(cleaned_documents(spark, folder).select("doc_id", "source", "clean_text"), "cleaned")
    unique = dedup_clean_text(cleaned, "clean_text", "doc_id")
    return unique.select("doc_id", "source", digest(F.col("clean_text")).alias("result"))


@query("prune_columns", "SELECT doc_id, lang, source FROM documents")
def prune(spark, folder):
    return prune_columns(table(spark, folder, "documents"), ["doc_id", "lang", "source", "company"])


@query(
    "filter_body_present",
    "SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND text <> ''",
)
def body_present(spark, folder):
    """All documents, and as many again as two fifths of them, with ids of their own and no body or an empty one."""
    rows = table(spark, folder, "documents").select("doc_id", "n_chars", F.col("text").alias("body"))
    missing = F.when(F.col("doc_id") % 5 == 1, "")
    more = rows.filter("doc_id % 5 < 2").select((-1 - F.col("doc_id")).alias("doc_id"), "n_chars", missing.alias("body"))
    return rows.unionAll(more).filter(T.present(F.col("body"))).select("doc_id", "n_chars")


@query(
    "filter_success",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
)
def success(spark, folder):
    return filter_success(table(spark, folder, "events"), "event_type", "purchase").select("event_id", "user_id", "value")


@query(
    "filter_link_pattern",
    "SELECT page_id, url FROM (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'page ' || page_id END AS title "
    "FROM pages) WHERE title <> '' AND contains(url, '/en/')",
)
def link_pattern(spark, folder):
    title = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("page "), F.col("page_id")))
    links = table(spark, folder, "pages").select("page_id", "url", title.alias("title"))
    return filter_link_pattern(links, "/en/", "title", "url").select("page_id", "url")


_BROKEN_PROPS = (
    "CASE event_id % 10 WHEN 3 THEN props || chr(10) || props WHEN 5 THEN NULL "
    "WHEN 7 THEN substr(props, 1, length(props) - 1) WHEN 8 THEN '' WHEN 9 THEN '[' || props || ', null]' ELSE props END"
)


@query(
    "parse_json_ld",
    f"""SELECT event_id, coalesce(json_valid(doc), false) AS ok,
        CASE WHEN json_valid(doc) THEN CAST(json_extract_string(doc, '$.k') AS BIGINT) END AS k
    FROM (SELECT event_id, {_BROKEN_PROPS} AS doc FROM events)""",
)
def parse_json(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.expr(_BROKEN_PROPS).alias("doc"))
    doc = T.parse_json_ld(F.col("doc"))
    return rows.select("event_id", doc.alias("doc")).select(
        "event_id", F.col("doc").isNotNull().alias("ok"), F.try_variant_get("doc", "$.k", "long").alias("k")
    )


@query(
    "to_json_text",
    "SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_text(spark, folder):
    """Structs are written as JSON text and read back: the fields have to survive."""
    record = F.struct("event_type", "value", F.try_variant_get(T.parse_json_ld(F.col("props")), "$.k", "long").alias("k"))
    text = table(spark, folder, "events").select("event_id", T.to_json_text(record).alias("text"))
    back = F.from_json("text", "event_type string, value double, k long")
    return text.select("event_id", back.alias("r")).select("event_id", "r.event_type", "r.value", "r.k")


@query(
    "project_posting",
    "SELECT event_id AS ord, event_type AS company, CAST(user_id AS VARCHAR) AS url, CAST(value AS VARCHAR) AS body, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def posting_record(spark, folder):
    source = table(spark, folder, "events").select(
        F.col("event_id").alias("ord"), F.col("event_type").alias("company"), F.col("user_id").cast("string").alias("url"),
        F.col("value").alias("iframe_jd_text"), F.col("props").alias("json_ld"),
    )
    record = project_posting(source)
    return record.select(
        "ord", "company", "url", F.col("iframe_jd_text").alias("body"), F.try_variant_get("json_ld", "$.k", "long").alias("k")
    )


_ID, _CODE = r"/(?:en|fr|de|es)/(\d+)", r"ref=([^&#]+)"


@query(
    "extract_url_keys",
    f"SELECT page_id, nullif(regexp_extract(url, '{_ID}', 1), '') AS number, "
    f"coalesce(nullif(regexp_extract(url, '{_CODE}', 1), ''), 'C1') AS code FROM pages",
)
def url_keys(spark, folder):
    number, code = T.extract_url_keys(F.col("url"), _ID, _CODE)
    return table(spark, folder, "pages").select("page_id", number.alias("number"), code.alias("code"))


@query(
    "build_detail_url",
    f"SELECT page_id, 'https://www.jobkorea.co.kr/Recruit/GI_Read_Comt_Ifrm?Oem_Code=' || code || '&Gno=' || number || "
    f"'&isHiringCenter=false&hideMapView=false' AS detail_url FROM (SELECT page_id, "
    f"nullif(regexp_extract(url, '{_ID}', 1), '') AS number, "
    f"coalesce(nullif(regexp_extract(url, '{_CODE}', 1), ''), 'C1') AS code FROM pages)",
)
def detail_url(spark, folder):
    number, code = T.extract_url_keys(F.col("url"), _ID, _CODE)
    return table(spark, folder, "pages").select("page_id", T.build_detail_url(number, code).alias("detail_url"))


_HREF = (
    "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://[^/]+', '') "
    "ELSE regexp_replace(url, '^https?://[^/]+/', '') END"
)


@query(
    "absolutize_url",
    f"""SELECT page_id, CASE WHEN starts_with(href, '/') THEN 'https://site.example' || href
        WHEN NOT starts_with(href, 'http') THEN 'https://site.example/' || href ELSE href END AS absolute
    FROM (SELECT page_id, {_HREF} AS href FROM pages)""",
)
def absolute(spark, folder):
    links = table(spark, folder, "pages").select("page_id", F.expr(_HREF).alias("href"))
    return links.select("page_id", T.absolutize_url(F.col("href"), "https://site.example").alias("absolute"))


@query(
    "resolve_url",
    f"""SELECT page_id, CASE WHEN starts_with(href, '/') THEN 'https://site.example' || href
        WHEN NOT starts_with(href, 'http') THEN 'https://site.example/a/' || href ELSE href END AS absolute
    FROM (SELECT page_id, {_HREF} AS href FROM pages)""",
)
def resolved(spark, folder):
    links = table(spark, folder, "pages").select("page_id", F.expr(_HREF).alias("href"))
    return links.select("page_id", T.resolve_url(F.lit("https://site.example/a/b"), F.col("href")).alias("absolute"))


@query(
    "length_by_posting",
    "SELECT doc_id, coalesce(length(text), 0) AS text_length, coalesce(length(source), 0) AS source_length FROM documents",
)
def lengths(spark, folder):
    rows = text_lengths(text_table(spark, folder, "documents", "doc_id"), "text", "source")
    return rows.select("doc_id", "text_length", "source_length")
