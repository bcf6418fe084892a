"""CSV parts of scraped postings and link candidates."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import present, strip

# The columns of a raw posting and of a link candidate.
RAW_COLUMNS = ("company", "url", "iframe_jd_text", "main_jd_text", "json_ld", "status", "error")
LINK_COLUMNS = ("text", "href", "className", "parentText", "outerHTML")
BODY_COLUMN = "iframe_jd_text"
KEPT_COLUMNS = ("company", "url", BODY_COLUMN)

# rows, and characters in them, handed from a task's reader to Spark at a time
_ROWS_AT_ONCE, _CHARS_AT_ONCE = 5000, 2_000_000


def file_order() -> Column:
    """Order key of a scanned row: path, block within the file, position within the block.

    The path is compared as it is spelled, not as its percent-encoded address. Positions are only compared inside one
    block, which is always read by one task.
    """
    return F.struct(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _why_unusable(rows: Iterator[list[str]], required: str) -> str | None:
    """What makes a parsed file unusable as a whole, or None."""
    header = next(rows, None)
    if not header:
        return "no header"
    if required not in header:
        return f"no column {required}"
    for number, row in enumerate(rows, 1):
        if len(row) > len(header):
            return f"too many fields in row {number}"
    return None


def _text(content: pa.Buffer) -> io.TextIOWrapper:
    """The characters of a file, decoded as they are read."""
    return io.TextIOWrapper(pa.BufferReader(content), encoding="utf-8-sig", newline="")


def _bad_byte(content: pa.Buffer) -> int:
    """Where the text of a file that is not UTF-8 breaks off."""
    try:
        str(memoryview(content), "utf-8-sig")
    except UnicodeDecodeError as error:
        return error.start
    raise AssertionError("the file is UTF-8")


def _parse(path: str, content: pa.Buffer, required: str, keep: Sequence[str]) -> Iterator[tuple]:
    """(path, 0, reason) for the file, then (path, number, None, *fields) for its rows if it is usable.

    The file is read a buffer of characters at a time; besides its bytes no copy of it is held.
    """
    blank = (None,) * len(keep)
    csv.field_size_limit(2**31 - 1)
    try:
        text = _text(content)
        while text.read(1 << 20):
            pass
        reason = _why_unusable(csv.reader(_text(content)), required)
    except UnicodeDecodeError:
        reason = f"not UTF-8 at byte {_bad_byte(content)}"
    except csv.Error as error:
        reason = f"not CSV: {error}"
    yield (path, 0, reason, *blank)
    if reason:
        return
    rows = csv.reader(_text(content))
    header = next(rows)
    # of a repeated name the first column counts
    at = [header.index(c) if c in header else len(header) for c in keep]
    for number, row in enumerate((r for r in rows if r), 1):
        row += [""] * (len(header) + 1 - len(row))
        yield (path, number, None, *(row[i] or None for i in at))


def _some(parsed: Iterator[tuple]) -> list[tuple]:
    """The next rows: at most ``_ROWS_AT_ONCE``, and no more once they hold ``_CHARS_AT_ONCE`` characters."""
    rows, chars = [], 0
    for row in islice(parsed, _ROWS_AT_ONCE):
        rows.append(row)
        chars += sum(len(field) for field in row[3:] if field)
        if chars >= _CHARS_AT_ONCE:
            break
    return rows


def read_csv_files(spark: SparkSession, paths: str | Sequence[str], required: str, keep: Sequence[str]) -> DataFrame:
    """(path, row, reason, *keep): a row 0 for each file, with the reason if it is skipped, and the rows of the others.

    Spark opens the files, so every store and every name it can list works, and a read error fails the task. Each file
    is parsed whole, in one task, under the same rules whatever its size.
    """
    files = spark.read.format("binaryFile").load(paths)
    return parse_csv_files(files, required, keep)


def parse_csv_files(files: DataFrame, required: str, keep: Sequence[str]) -> DataFrame:
    """The same for a frame of files (path, content), as Spark's reader and stream of whole files give it."""
    names = ["path", "row", "reason", *(f"_{i}" for i in range(len(keep)))]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * (len(keep) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                parsed = _parse(path.as_py(), content.as_buffer(), required, keep)
                while rows := _some(parsed):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = ", ".join(f"`{n}` {'long' if n == 'row' else 'string'}" for n in names)
    return files.select("path", "content").mapInArrow(run, schema).toDF(*names[:3], *keep)


def skipped_csv_files(spark: SparkSession, paths: str | Sequence[str], required: str = BODY_COLUMN) -> DataFrame:
    """(path, reason) of the files that a scan leaves out. Spark doesn't list files without a byte: they hold nothing."""
    return read_csv_files(spark, paths, required, []).filter("reason IS NOT NULL").select("path", "reason")


def scan_csv_parts(
    spark: SparkSession,
    paths: str | Sequence[str],
    required: str = BODY_COLUMN,
    keep: Sequence[str] = KEPT_COLUMNS,
    na_values: Sequence[str] = (),
    ord: bool = True,
) -> DataFrame:
    """All CSV files of a pattern as one frame of string columns, read once.

    Files that are not UTF-8, without a header, without the ``required`` column, or with a row of too many fields are
    skipped whole; ``skipped_csv_files`` tells which and why. Columns may come in any order in each file, a repeated
    name stands for its first column, and of ``keep`` what a file lacks is null. An empty field is null, as are
    ``na_values``. Quoted newlines are allowed, so a file is not split: have many files rather than a huge one.
    """
    found = read_csv_files(spark, paths, required, keep)
    if found.filter("row = 0 AND reason IS NULL").isEmpty():
        raise ValueError(f"no usable CSV file in {paths}")
    order = [F.struct("path", "row").alias("ord")] if ord else []
    rows = found.filter("row > 0").select(*keep, *order)
    if na_values:
        rows = rows.withColumns({c: F.when(~F.col(c).isin(*na_values), F.col(c)) for c in keep})
    return rows


def scan_csv_single(spark: SparkSession, path: str, ord: bool = True) -> DataFrame:
    """One raw-posting file with all its columns."""
    return scan_csv_parts(spark, path, keep=RAW_COLUMNS, ord=ord)


def scan_link_csv(spark: SparkSession, paths: str | Sequence[str], ord: bool = True) -> DataFrame:
    """Link candidates: a missing field is the empty string; title and address are stripped."""
    links = scan_csv_parts(spark, paths, required="href", keep=LINK_COLUMNS, ord=ord)
    fill = {c: F.coalesce(F.col(c), F.lit("")) for c in links.columns if c != "ord"}
    fill.update({c: strip(fill[c]) for c in ("text", "href") if c in fill})
    return links.withColumns(fill)


POSTING_PATH = "/Recruit/GI_Read/"


def filter_link_pattern(links: DataFrame, path: str = POSTING_PATH, title: str = "text", url: str = "href") -> DataFrame:
    """Links with a title whose address holds ``path``."""
    return links.filter(present(F.col(title)) & F.col(url).contains(path))


def prune_columns(df: DataFrame, keep: Sequence[str] = KEPT_COLUMNS) -> DataFrame:
    """Of ``keep``, the columns the frame has."""
    return df.select(*[c for c in keep if c in df.columns])
