"""Words, vocabularies, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.text import clean_text, flatten_newlines, strip
from siftwell.functions.tokens import SPECIAL_TOKENS, USER_TERMS, pretokenize, segment_forms
from siftwell.operators import chunking as C
from siftwell.operators import wordpiece as W
from siftwell.operators.profile import chunks_per_posting
from siftwell.operators.ranking import head_lines
from siftwell.queries import sql
from siftwell.queries.registry import NOISY, digest, noisy_documents, query, text_table
from siftwell.session import stage

_SORTED_TERMS = "|".join(sorted(USER_TERMS, key=lambda t: (-len(t), t)))
_FORMS = rf"{_SORTED_TERMS}|\p{{Hangul}}+|\p{{Han}}+|\p{{Latin}}+|\p{{L}}+|\p{{Nd}}+|[^\s]"

WORDS = f"words AS (SELECT unnest({sql.words(sql.nfkc('body'))}) AS word FROM noisy)"
COUNTS = "counts AS (SELECT word, count(*) AS freq FROM words GROUP BY word)"


def _bodies(spark, folder):
    """Noisy bodies under NFKC, so that both engines see the same whitespace."""
    from siftwell.functions.text import normalize_nfkc

    return noisy_documents(spark, folder).select("doc_id", normalize_nfkc(F.col("body")).alias("body"))


@query(
    "pretokenize",
    f"WITH {NOISY} SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words FROM "
    f"(SELECT doc_id, {sql.words(sql.nfkc('body'))} AS w FROM noisy)",
)
def words(spark, folder):
    rows = _bodies(spark, folder).select("doc_id", pretokenize(F.col("body")).alias("w"))
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n"), digest(F.array_join("w", " ")).alias("words")
    )


@query("word_counts", f"WITH {NOISY}, {WORDS} SELECT word, count(*) AS freq FROM words GROUP BY word")
def word_counts(spark, folder):
    return W.word_counts(_bodies(spark, folder), "body")


@query(
    "segment_morphemes",
    f"WITH {NOISY} SELECT doc_id, md5(array_to_string(regexp_extract_all({sql.nfkc('body')}, '{_FORMS}'), ' ')) AS forms FROM noisy",
)
def morphemes(spark, folder):
    rows = W.segment_morphemes(_bodies(spark, folder), "body")
    return rows.select("doc_id", digest(F.col("forms")).alias("forms"))


@query(
    "protect_user_terms",
    f"""WITH {NOISY}, forms AS (SELECT unnest(regexp_extract_all({sql.nfkc('body')}, '{_FORMS}')) AS form FROM noisy)
    SELECT form, count(*) AS n FROM forms WHERE form IN ({', '.join(map(sql.quoted, USER_TERMS))}) GROUP BY form""",
)
def user_terms(spark, folder):
    forms = _bodies(spark, folder).select(F.explode(segment_forms(F.col("body"))).alias("form"))
    return forms.filter(F.col("form").isin(*USER_TERMS)).groupBy("form").agg(F.count("*").alias("n"))


def _frequent(counts, minimum=3):
    return counts.filter(F.col("freq") >= minimum).select(F.col("word").alias("token"))


@query(
    "vocab_probe",
    f"""WITH {NOISY}, {WORDS}, {COUNTS},
    probes AS (SELECT DISTINCT unnest({sql.words('text')}) AS word FROM benchmark)
    SELECT word, word IN (SELECT word FROM counts WHERE freq >= 3) AS in_vocab FROM probes""",
)
def probe(spark, folder):
    vocab = _frequent(W.word_counts(_bodies(spark, folder), "body"))
    probes = text_table(spark, folder, "benchmark", "item_id").select(F.explode(pretokenize(F.col("text"))).alias("word"))
    return W.vocab_probe(probes.distinct(), vocab)


@query(
    "vocab_compare",
    f"""WITH {NOISY}, {WORDS}, {COUNTS},
    forms AS (SELECT unnest(regexp_extract_all({sql.nfkc('body')}, '{_FORMS}')) AS form FROM noisy),
    a AS (SELECT word AS token FROM counts WHERE freq >= 3),
    b AS (SELECT word AS token FROM (SELECT unnest({sql.words('form')}) AS word FROM forms) GROUP BY word HAVING count(*) >= 3)
    SELECT coalesce(a.token, b.token) AS token, a.token IS NOT NULL AS in_left, b.token IS NOT NULL AS in_right
    FROM a FULL OUTER JOIN b ON a.token = b.token""",
)
def compare(spark, folder):
    """Frequent words of the raw and of the morpheme-segmented corpus."""
    bodies = _bodies(spark, folder)
    return W.vocab_compare(_frequent(W.word_counts(bodies, "body")), _frequent(W.form_counts(bodies, "body")))


@query(
    "vocab_expansion_candidates",
    f"""WITH {NOISY}, {WORDS}, {COUNTS},
    base AS (SELECT DISTINCT unnest({sql.words('text')}) AS word FROM benchmark)
    SELECT word, freq FROM counts WHERE word NOT IN (SELECT word FROM base) ORDER BY freq DESC, word LIMIT 50""",
)
def expansion(spark, folder):
    base = text_table(spark, folder, "benchmark", "item_id").select(F.explode(pretokenize(F.col("text"))).alias("token"))
    return W.expansion_candidates(W.word_counts(_bodies(spark, folder), "body"), base.distinct(), 50)


def _clean_words(spark, folder):
    bodies = noisy_documents(spark, folder).select("doc_id", clean_text(F.col("body")).alias("body"))
    return W.word_counts(bodies, "body")


def _trained(spark, folder, size=W.VOCAB_SIZE):
    return W.train_wordpiece(_clean_words(spark, folder), vocab_size=size)


@query("train_wordpiece")
def train(spark, folder):
    """Exact training to the full size, or until no pair is frequent enough."""
    return W.train_wordpiece(_clean_words(spark, folder), vocab_size=W.VOCAB_SIZE)


@query("vocab_size")
def size(spark, folder):
    return W.vocab_size(_trained(spark, folder))


FIRST_ENTRIES = 215


def _first_merges_sql(steps: int) -> str:
    """Merging one pair at a time, a step for each; every symbol stands between two line ends."""
    sql_steps = [
        """alphabet AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM cleaned_counts),
    s0 AS MATERIALIZED (SELECT chr(10) || array_to_string(list_transform(string_split(word, ''),
        lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END), chr(10) || chr(10)) || chr(10) AS w, freq FROM cleaned_counts)"""
    ]
    for i in range(steps):
        sql_steps.append(
            f"""m{i + 1} AS MATERIALIZED (SELECT p[1] AS a, p[2] AS b, p[1] || substr(p[2], 3) AS token FROM (
        SELECT unnest(list_zip(l[:-2], l[2:])) AS p, freq FROM (SELECT string_split(w[2:-2], chr(10) || chr(10)) AS l, freq FROM s{i}))
        GROUP BY p HAVING sum(freq) >= {W.MIN_FREQUENCY} ORDER BY sum(freq) DESC, p[1], p[2] LIMIT 1),
    s{i + 1} AS MATERIALIZED (SELECT coalesce((SELECT replace(w, chr(10) || a || chr(10) || chr(10) || b || chr(10),
        chr(10) || token || chr(10)) FROM m{i + 1}), w) AS w, freq FROM s{i})"""
        )
    specials = " UNION ALL ".join(f"SELECT 0 AS part, {i} AS k, {sql.quoted(t)} AS token" for i, t in enumerate(SPECIAL_TOKENS))
    inner = "SELECT DISTINCT '##' || unnest(string_split(substr(word, 2), '')) AS c FROM cleaned_counts WHERE length(word) > 1"
    merged = " UNION ALL ".join(f"SELECT 3, {i}, token FROM m{i}" for i in range(1, steps + 1))
    return f"""WITH {NOISY}, cleaned_counts AS MATERIALIZED (
        SELECT word, count(*) AS freq FROM (SELECT unnest({sql.words(sql.clean('body'))}) AS word FROM noisy) GROUP BY word),
    {', '.join(sql_steps)},
    entries AS ({specials} UNION ALL SELECT 1, row_number() OVER (ORDER BY c), c FROM alphabet
        UNION ALL SELECT 2, row_number() OVER (ORDER BY c), c FROM ({inner}) UNION ALL {merged}),
    once AS (SELECT token, min((part, k)) AS place FROM entries GROUP BY token)
    SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS id, token FROM once ORDER BY place LIMIT {FIRST_ENTRIES}"""


@query("train_wordpiece_first", _first_merges_sql(24))
def train_first(spark, folder):
    """The first entries of the vocabulary, few enough for SQL to merge one pair at a time over the whole word table."""
    return W.train_wordpiece(_clean_words(spark, folder), vocab_size=FIRST_ENTRIES).filter(F.col("id") < FIRST_ENTRIES)


# A vocabulary that SQL can state: the control tokens, every character in both forms, every word
# prefix of up to 4 characters, and as continuations every word suffix of up to 4, if frequent.
_VOCAB_SQL = f"""vocab AS (
    SELECT '{SPECIAL_TOKENS[1]}' AS token
    UNION SELECT c FROM chars WHERE n >= 20 UNION SELECT '##' || c FROM chars WHERE n >= 20
    UNION SELECT left(word, i) FROM counts, range(2, 5) r(i) WHERE length(word) >= i GROUP BY 1 HAVING sum(freq) >= 50
    UNION SELECT '##' || right(word, i) FROM counts, range(2, 5) r(i) WHERE length(word) > i GROUP BY 1 HAVING sum(freq) >= 50)"""
_CHARS_SQL = "chars AS (SELECT c, sum(freq) AS n FROM (SELECT unnest(string_split(word, '')) AS c, freq FROM counts) GROUP BY c)"
# greedy longest match of every distinct word, one piece per step
_PIECES_SQL = f"""walk AS (
    SELECT word, 1 AS pos, CAST([] AS VARCHAR[]) AS pieces, false AS failed FROM counts
    UNION ALL
    SELECT word, pos + coalesce(n, 0), list_append(pieces, piece), n IS NULL FROM (
        SELECT w.word, w.pos, w.pieces, max(length(v.token) - CASE WHEN w.pos > 1 THEN 2 ELSE 0 END) AS n,
               arg_max(v.token, length(v.token)) AS piece
        FROM (SELECT word, pos, pieces, unnest(range(1, 7)) AS i FROM walk
              WHERE NOT failed AND pos <= length(word) AND length(word) <= 100) w
        LEFT JOIN vocab v ON v.token = CASE WHEN w.pos > 1 THEN '##' ELSE '' END || substr(w.word, w.pos, w.i)
             AND w.pos + w.i <= length(w.word) + 1
        GROUP BY w.word, w.pos, w.pieces)),
encoded AS (
    SELECT c.word, coalesce(w.pieces, ['{W.UNKNOWN}']) AS pieces FROM counts c
    LEFT JOIN (SELECT word, pieces FROM walk WHERE NOT failed AND pos > length(word)) w USING (word))"""


def _stated_vocab(words):
    counts = stage(words, "words")
    chars = counts.select(F.explode(F.split("word", "")).alias("c"), "freq").groupBy("c").agg(F.sum("freq").alias("n"))
    frequent = chars.filter("n >= 20")
    ends = counts.select("word", "freq", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("i"))
    head = ends.filter(F.length("word") >= F.col("i")).select(F.expr("left(word, i)").alias("token"), "freq")
    tail = ends.filter(F.length("word") > F.col("i")).select(F.expr("'##' || right(word, i)").alias("token"), "freq")
    pieces = head.unionAll(tail).groupBy("token").agg(F.sum("freq").alias("n")).filter("n >= 50").select("token")
    spark = counts.sparkSession
    return (
        spark.createDataFrame([(W.UNKNOWN,)], "token string")
        .unionAll(frequent.select(F.col("c").alias("token")))
        .unionAll(frequent.select(F.concat(F.lit("##"), "c").alias("token")))
        .unionAll(pieces)
        .distinct()
    )


@query(
    "encode_wordpiece",
    f"""WITH RECURSIVE {NOISY}, {WORDS}, {COUNTS}, {_CHARS_SQL}, {_VOCAB_SQL}, {_PIECES_SQL},
    placed AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, {sql.words(sql.nfkc('body'))} AS w FROM noisy) d,
        range(1, len(d.w) + 1) r(i))
    SELECT doc_id, CAST(coalesce(sum(len(pieces)), 0) AS BIGINT) AS n,
        md5(coalesce(string_agg(array_to_string(pieces, ' '), ' ' ORDER BY i), '')) AS tokens
    FROM noisy LEFT JOIN (placed JOIN encoded USING (word)) USING (doc_id) GROUP BY doc_id""",
)
def encode(spark, folder):
    bodies = _bodies(spark, folder)
    encoded = W.encode_wordpiece(bodies, "body", _stated_vocab(W.word_counts(bodies, "body")))
    return encoded.select(
        "doc_id", F.size("tokens").cast("long").alias("n"), digest(F.array_join("tokens", " ")).alias("tokens")
    )


@query(
    "oov_rate",
    f"""WITH RECURSIVE {NOISY}, {WORDS}, {COUNTS}, {_CHARS_SQL}, {_VOCAB_SQL}, {_PIECES_SQL},
    head AS (SELECT unnest({sql.words(sql.nfkc('body'))}) AS word FROM (SELECT body FROM noisy ORDER BY doc_id LIMIT 5000))
    SELECT CAST(sum(len(pieces)) AS BIGINT) AS n_tokens,
        CAST(sum(CASE WHEN pieces[1] = '{W.UNKNOWN}' THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown,
        round(sum(CASE WHEN pieces[1] = '{W.UNKNOWN}' THEN 1 ELSE 0 END) * 100.0 / sum(len(pieces)), 6) AS unknown_pct
    FROM head JOIN encoded USING (word)""",
)
def oov(spark, folder):
    bodies = _bodies(spark, folder).withColumn("body", flatten_newlines(F.col("body")))
    vocab = _stated_vocab(W.word_counts(bodies, "body"))
    encoded = W.encode_wordpiece(head_lines(bodies, "doc_id"), "body", vocab)
    return W.oov_rate(encoded).withColumn("unknown_pct", F.round("unknown_pct", 6))


def _chunks(spark, folder):
    return C.chunk_recursive(noisy_documents(spark, folder), "body", "doc_id")


@query("chunk_recursive")
def chunks(spark, folder):
    return _chunks(spark, folder).select(
        "doc_id", "chunk_index", F.length("chunk_text").alias("n"), digest(F.col("chunk_text")).alias("chunk")
    )


_STRIPPED = sql.strip("body")


@query(
    "chunk_checks",
    f"""WITH {NOISY} SELECT doc_id, true AS within_size, CAST(0 AS BIGINT) AS foreign_chunks, CAST(0 AS BIGINT) AS lost_words,
        CASE WHEN length({_STRIPPED}) < 1000 THEN md5({_STRIPPED}) END AS whole
    FROM noisy WHERE {_STRIPPED} <> ''""",
)
def chunk_checks(spark, folder):
    """What SQL can state of the chunks of every document: their size, that they come from its body, that no word is lost
    between them, and that a short body is one chunk."""
    bodies = noisy_documents(spark, folder).select("doc_id", "body", C.chunk_texts(F.col("body")).alias("chunks"))
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    held = F.flatten(F.transform("chunks", words))
    return bodies.filter(F.size("chunks") > 0).select(
        "doc_id",
        (F.array_max(F.transform("chunks", F.length)) <= C.CHUNK_SIZE).alias("within_size"),
        F.size(F.filter("chunks", lambda c: ~F.contains(F.col("body"), c))).cast("long").alias("foreign_chunks"),
        F.size(F.array_except(words(F.col("body")), held)).cast("long").alias("lost_words"),
        F.when(F.length(strip(F.col("body"))) < C.CHUNK_SIZE, F.md5(F.array_join("chunks", "|"))).alias("whole"),
    )


@query("chunks_per_posting")
def chunk_counts(spark, folder):
    """All postings, and as many again as a fifth of them, with ids of their own and without a body."""
    postings = noisy_documents(spark, folder).select("doc_id", "body")
    without = postings.filter("doc_id % 5 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("body"))
    rows = postings.unionAll(without)
    return chunks_per_posting(rows, C.chunk_recursive(rows, "body", "doc_id"), "doc_id")


_UUID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"


@query(
    "chunk_point_id",
    f"SELECT conv_id, turn, {_UUID} AS point_id FROM (SELECT conv_id, turn, md5(conv_id || ':' || turn) AS h FROM conversations)",
)
def point_id(spark, folder):
    rows = text_table(spark, folder, "conversations", "conv_id")
    return rows.select("conv_id", "turn", C.chunk_point_id(F.col("conv_id"), F.col("turn")).alias("point_id"))


def hashed_sql(source: str, key: str, dimension: int) -> str:
    """Unit vectors of hashed word counts in long form: (key, bucket, weight)."""
    return f"""SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM (
        SELECT {key}, ('0x' || left(md5(w), 8))::BIGINT % {dimension} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (
            SELECT {key}, unnest(regexp_extract_all(text, '\\S+')) AS w FROM {source}) GROUP BY ALL)"""


@query(
    "embed_chunks",
    f"SELECT conv_id, turn, CAST(bucket AS INTEGER) AS bucket, round(CAST(CAST(weight AS FLOAT) AS DOUBLE), 5) AS weight "
    f"FROM ({hashed_sql('conversations', 'conv_id, turn', 1536)})",
)
def embedded(spark, folder):
    """The non-zero components of every vector; turns stand for chunks."""
    rows = text_table(spark, folder, "conversations", "conv_id")
    vectors = C.embed_chunks(rows, "text").select("conv_id", "turn", F.posexplode("vector").alias("bucket", "weight"))
    return vectors.filter("weight <> 0").withColumn("weight", F.round(F.col("weight").cast("double"), 5))
