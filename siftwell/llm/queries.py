"""Registered queries of the operators, each beside its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.collocations import collocations
from siftwell.llm.columns import LOWER, UPPER
from siftwell.llm.decontamination import EDIT_WORDS, find_leaks
from siftwell.llm.fingerprints import fingerprint_neighbours
from siftwell.llm.jaccard_join import jaccard_components
from siftwell.llm.language_id import in_fold, learn_profiles, predict_language
from siftwell.llm.license_scan import license_digest, scan_licenses
from siftwell.llm.line_dedup import drop_frequent_lines
from siftwell.llm.minhash_dedup import near_duplicates
from siftwell.llm.pieces import round_trip
from siftwell.llm.sharding import read_shards, write_shards
from siftwell.llm.token_files import read_token_files, write_token_files
from siftwell.llm.url_filter import judge_urls
from siftwell.llm.whitening import whiten
from siftwell.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return (
        find_leaks(docs, table(spark, folder, "benchmark"), edit_words=EDIT_WORDS)
        .select("doc_id", F.explode("leaks").alias("leak"))
        .select("doc_id", "leak.item_id", "leak.score", "leak.question", "leak.answer")
    )


@query
def op2_url_filter(spark, folder):
    judged = judge_urls(table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


@query
def op3_token_files(spark, folder):
    path = new_path(spark, "token_files")
    write_token_files(table(spark, folder, "documents"), path, end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_jaccard_join(spark, folder):
    return jaccard_components(table(spark, folder, "documents"), words=3, percent=90)


#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20


@query
def op5_sharding(spark, folder):
    path = new_path(spark, "shards")
    write_shards(table(spark, folder, "documents"), path, limit=SHARD_BYTES)
    return read_shards(spark, path).select("doc_id", "shard", "n_bytes", "shard_bytes", "shard_docs")


def sharding_sql(limit: int) -> str:
    return f"""
WITH keyed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS bits
  FROM documents),
depths AS (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS depth),
views AS (
  SELECT doc_id, n_bytes, bits, depth, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs
  FROM keyed, depths WINDOW w AS (PARTITION BY depth, bits >> (60 - depth)))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bits >> (60 - depth)), depth, '0') END AS shard,
       n_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs
FROM views WHERE shard_bytes <= {limit}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


ORACLES["op5_sharding"] = sharding_sql(SHARD_BYTES)


@query
def op6_sentencepiece(spark, folder):
    docs = round_trip(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.crc32(F.array_join("piece_ids", " ")).alias("pieces_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query
def op7_fingerprints(spark, folder):
    return fingerprint_neighbours(table(spark, folder, "documents"))


@query
def op8_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = in_fold(F.col("doc_id"))
    profiles = learn_profiles(docs.where(~held_out))
    return predict_language(docs.drop("lang"), profiles, out="guess").select(
        "doc_id", held_out.alias("held_out"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score")
    )


@query
def op9_license_scan(spark, folder):
    return license_digest(scan_licenses(table(spark, folder, "documents")))


@query
def op10_line_dedup(spark, folder):
    docs = drop_frequent_lines(table(spark, folder, "documents").select("doc_id", "text"), min_docs=10)
    return docs.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLES["op10_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) > 0 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY doc_id
"""


@query
def op11_whitening(spark, folder):
    return whiten(table(spark, folder, "embeddings"))


@query
def op12_collocations(spark, folder):
    return collocations(table(spark, folder, "documents"))


def collocations_sql(min_count: int = 30, top: int = 2000) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, w[i:i + {k - 1}] AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM words)"
        for k in (1, 2, 3, 4)
    )
    return f"""
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM ({grams}) GROUP BY ALL),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= {min_count}),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS c FROM cand),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:cuts.c] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[cuts.c + 1:cuts.k]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inside AS (
  SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer
  FROM (SELECT lang, g, a, k, m, unnest(range(1, k - m + 2)) AS i FROM cand, (VALUES (2), (3)) v(m) WHERE m < k)
  GROUP BY ALL),
kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {top}
"""


ORACLES["op12_collocations"] = collocations_sql()


@query
def op13_minhash_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "documents"), words=3, percent=85)
