"""Writers. Every one is a plain Spark write, so a lost executor only repeats its own files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import flatten_newlines
from siftwell.operators import html as H
from siftwell.operators.ranking import PART_SIZE, number_rows, part_of
from siftwell.session import TEXT_CODEC


def sink_corpus_text(df: DataFrame, path: str, text: str = "clean_text", ord: str | None = None, mode: str = "error") -> None:
    """One posting per line, inner newlines as blanks; with ``ord``, in its order over the files and within them."""
    if ord is not None:
        df = df.repartitionByRange(F.col(ord)).sortWithinPartitions(ord)
    df.select(flatten_newlines(F.col(text)).alias("value")).write.mode(mode).text(path)


#: Runs of files that are read one after the other where their rows are to keep their order.
RUNS = 4


def runs_in_order(spark: SparkSession, path: str, column: str, runs: int = RUNS) -> Iterator[DataFrame]:
    """One column of a written Parquet table in frames that follow each other in the order of its files.

    Rows of a file are one partition, in their order; its number is that of the file, over all frames. So what is appended frame
    by frame keeps the order by the names of its files, and only the rows of one frame are shuffled at a time.
    """
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]
    schema = spark.read.parquet(path).schema
    size = max(1, -(-len(files) // runs))
    for start in range(0, len(files), size):
        some = files[start : start + size]
        names = F.lit([name.rsplit("/", 1)[1] for name in some])
        rows = spark.read.schema(schema).parquet(*some).select(
            column,
            (F.array_position(names, F.col("_metadata.file_name")) + start - 1).cast("int").alias("_file"),
            F.col("_metadata.row_index").alias("_row"),
        )
        yield rows.repartitionById(start + len(some), "_file").sortWithinPartitions("_file", "_row").select(column)


def sink_clean_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", TEXT_CODEC).parquet(path)


def sink_csv_parts(df: DataFrame, path: str, ord: str, size: int = PART_SIZE) -> None:
    """CSV parts of ``size`` rows, numbered from 1 in the order of ``ord``; one folder per part."""
    parted = number_rows(df, ord).withColumn("part", part_of(F.col("idx"), size)).drop(ord)
    columns = [c for c in parted.columns if c not in ("idx", "part")]
    (
        parted.repartition("part")
        .sortWithinPartitions("part", "idx")
        .select(*columns, "part")
        .write.partitionBy("part")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def posting_rows(new: DataFrame, ord: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows of the posting table, with ids that follow the largest one in use.

    Ids come from the order of the input, so repeating a failed run gives the same ids.
    """
    largest = existing.agg(F.max("id")).first()[0] if existing is not None else None
    numbered = number_rows(new, ord, start=(largest or 0) + 1, name="id").drop(ord)
    missing = {c: F.lit(None).cast("string") for c in ("main_jd_text", "status", "error") if c not in new.columns}
    now = F.current_timestamp()
    return numbered.withColumns({**missing, "created_at": now, "updated_at": now})


def sink_postings(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def sink_chunks(chunks: DataFrame, path: str) -> None:
    """Rows (job_post_id, chunk_index, chunk_text, point_id, created_at), unique by posting and index: of several rows
    the one with the smallest text stays."""
    rows = chunks.select("job_post_id", "chunk_index", "chunk_text", "point_id")
    unique = rows.groupBy("job_post_id", "chunk_index").agg(F.min(F.struct("chunk_text", "point_id")).alias("c"))
    stamped = unique.select("job_post_id", "chunk_index", "c.chunk_text", "c.point_id", F.current_timestamp().alias("created_at"))
    stamped.write.mode("overwrite").parquet(path)


def sink_vectors(points: DataFrame, path: str) -> None:
    """Points (id, vector, payload); a repeated run replaces its own folder."""
    points.write.mode("overwrite").parquet(path)


def sink_vocab(vocab: DataFrame, path: str) -> None:
    """Tokens by id, one per line, in one file: a vocabulary has tens of thousands of entries."""
    vocab.coalesce(1).sortWithinPartitions("id").select("token").write.text(path)


def sink_page_parts(pages: DataFrame, path: str, page_id: str = "page_id", html: str = "html") -> None:
    """Headings, links, blocks and body text of every page as JSON, one folder per kind."""
    page_parts(pages, page_id, html).write.partitionBy("kind").json(path)


def page_parts(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, kind, part) rows; ``part`` is the JSON text of one heading, link, block or body."""
    tags = ("body", "a", *H.HEADING_TAGS, *H.BLOCK_TAGS)
    parsed = pages.select(page_id, H.parse_html(F.col(html), tags, outer_size=1500).alias("dom"))
    dom = F.col("dom")
    body = F.array(F.struct(H.collapse_blank_lines(H.body_text(dom, None), blanks=True).alias("text")))
    kinds = {"heading": H.headings(dom), "link": H.links(dom), "block": H.text_blocks(dom), "body": body}

    def labelled(kind: str, values: Column) -> Column:
        return F.transform(values, lambda p: F.struct(F.lit(kind).alias("kind"), F.to_json(p).alias("part")))

    parts = [labelled(kind, values) for kind, values in kinds.items()]
    return parsed.select(page_id, F.explode(F.concat(*parts)).alias("p")).select(page_id, "p.kind", "p.part")
