"""Postings -> posting table, chunk table and vector points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import is_json_document, parse_json_ld, present, to_json_text
from siftwell.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_point_id, chunk_recursive, embed_chunks
from siftwell.operators.dedup import content_key, new_postings_anti
from siftwell.operators.profile import outcome_counts
from siftwell.session import stage, unstage
from siftwell.sources.csv_parts import BODY_COLUMN
from siftwell.sources.sinks import posting_rows, sink_chunks, sink_postings, sink_vectors

MAX_COMPANY_CHARS = 255


def filter_success(df: DataFrame, status: str = "status", value: str = "success") -> DataFrame:
    return df.filter(F.col(status) == value)


def project_posting(df: DataFrame, body: str = BODY_COLUMN) -> DataFrame:
    """The posting record, with the JSON-LD parsed; ``ord`` is kept."""
    return df.select(
        "ord", "company", "url", F.col(body).cast("string").alias(BODY_COLUMN), parse_json_ld(F.col("json_ld")).alias("json_ld")
    )


def storable(company: Column, url: Column, json_ld: Column) -> Column:
    """True where the posting table would take the row."""
    fits = company.isNotNull() & (F.length(company) <= MAX_COMPANY_CHARS) & url.isNotNull()
    return F.coalesce(fits & is_json_document(json_ld), F.lit(False))


def posting_outcomes(df: DataFrame, existing: DataFrame, ord: str = "ord", url: str = "url", ok: str = "ok") -> DataFrame:
    """(ord, outcome) of every incoming row, as if rows were taken one by one in order.

    ``skip`` where the URL is stored already, by an earlier run or an earlier row; a row that fails
    does not stop a later one of the same URL. Only keys are shuffled. What is looked up is one written
    table with each URL once, joined once, so the skew join can split a hot URL. Rows without a URL are
    not looked up at all.
    """
    rows = df.select(ord, F.col(url), F.col(ok), content_key(F.col(url)).alias("_key"))
    keyed = rows.filter(F.col(url).isNotNull())
    found = keyed.filter(ok).select("_key", F.col(ord).alias("_first"), F.lit(False).alias("_known"))
    known = existing.select(content_key(F.col(url)).alias("_key"), F.lit(None).alias("_first"), F.lit(True).alias("_known"))
    lookup = found.unionByName(known).groupBy("_key").agg(F.min("_first").alias("_first"), F.max("_known").alias("_known"))
    joined = keyed.join(stage(lookup, "lookup"), "_key", "left")
    result = F.when(F.col(ok), "success").otherwise("fail")
    outcome = F.when(F.col("_known") | (F.col("_first") < F.col(ord)), "skip").otherwise(result)
    without = rows.filter(F.col(url).isNull()).select(ord, result.alias("outcome"))
    return joined.select(ord, outcome.alias("outcome")).unionAll(without)


def stored_postings(spark: SparkSession, folder: str) -> DataFrame:
    """(id, url) of the postings stored in ``folder`` so far; none if nothing has been written yet."""
    path = f"{folder}/job_posts"
    inner = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not inner.getFileSystem(spark._jsc.hadoopConfiguration()).exists(inner):
        return spark.createDataFrame([], "id long, url string")
    return spark.read.parquet(path).select("id", "url")


def index_postings(
    df: DataFrame,
    folder: str,
    existing: DataFrame | None = None,
    body: str = BODY_COLUMN,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    embedder=None,
    on_error: str = "quarantine",
) -> DataFrame:
    """Add the new postings of ``df`` to ``folder``; returns the outcome counts.

    ``df`` needs ``ord``, company, url, json_ld and the body, raw or clean. ``existing`` is the posting
    table so far, by default what ``folder`` holds. The checked input is written once. Rows that cannot be stored count as failed, or raise with ``on_error='fail'``.

    The posting rows are written last: until then their URLs are unknown, and a repeated run replaces
    what a failed one left in the same ``run`` folders.
    """
    spark = df.sparkSession
    if existing is None:
        existing = stored_postings(spark, folder)
    ok = storable(F.col("company"), F.col("url"), F.col("json_ld"))
    checked = stage(df.filter(present(F.col(body))).withColumn("ok", ok), "checked")
    if on_error == "fail" and not checked.filter("not ok").isEmpty():
        raise ValueError("a posting cannot be stored")
    outcomes = outcome_counts(posting_outcomes(checked, existing))
    counts = outcomes.collect()  # at most three rows, taken before the target grows
    fresh = new_postings_anti(checked.filter("ok"), existing)
    record = project_posting(fresh, body).withColumn("json_ld", to_json_text(F.col("json_ld")))
    posts = posting_rows(record, "ord", existing)
    run = posts.agg(F.min("id")).first()[0]
    if run is not None:
        keyed = posts.withColumnRenamed("id", "job_post_id")
        chunks = chunk_recursive(keyed, BODY_COLUMN, "job_post_id", "url", size=size, overlap=overlap)
        chunks = chunks.withColumn("point_id", chunk_point_id(F.col("url"), F.col("chunk_index")))
        sink_chunks(chunks, f"{folder}/job_post_chunks/run={run}")
        stored = spark.read.parquet(f"{folder}/job_post_chunks/run={run}")
        payload = F.struct("job_post_id", "chunk_index").alias("payload")
        points = embed_chunks(stored, "chunk_text", embedder).select(F.col("point_id").alias("id"), "vector", payload)
        sink_vectors(points, f"{folder}/points/run={run}")
        sink_postings(posts, f"{folder}/job_posts/run={run}")
    unstage(checked)
    return spark.createDataFrame(counts, outcomes.schema)
