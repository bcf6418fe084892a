"""Frequent lines by bounded summaries: what is shuffled are summaries and the lines they leave, not all distinct lines.

Each task keeps at most m counters (Misra-Gries). Whenever it has more, it takes the (m+1)-th largest count off all of them,
drops what falls to zero, and adds that count to its error. So for every line, held or not,

    estimate <= occurrences <= estimate + error,

in the task, and for the sums over all tasks as well; the error of a task is at most its lines / (m + 1). Lines that may be
asked for by these bounds are then counted exactly in a second pass. Where the bounds leave too much open, all lines are
counted, so the result is exact whatever the data.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import stripped_lines
from siftwell.operators.profile import exploded_lines
from siftwell.session import stage, unstage

#: Counters of a task.
COUNTERS = 20_000


def _summarise(most: int):
    """(line, n) of a task's counters, and its error as the row without a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        error = 0
        for batch in batches:
            for found in pc.value_counts(batch.column("line")).to_pylist():
                held[found["values"]] += found["counts"]
            if len(held) > most:
                cut = heapq.nlargest(most + 1, held.values())[-1]
                error += cut
                held = Counter({line: n - cut for line, n in held.items() if n > cut})
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *held], pa.string()), pa.array([error, *held.values()], pa.int64())], names=["line", "n"]
        )

    return run


def _estimates(lines: DataFrame, counters: int) -> tuple[DataFrame, DataFrame, int]:
    """(summaries, estimates (line, least), error) over a column of lines."""
    summaries = stage(lines.select("line").mapInArrow(_summarise(counters), "line string, n long"), "summaries")
    error = summaries.where("line IS NULL").agg(F.sum("n")).first()[0] or 0
    return summaries, summaries.where("line IS NOT NULL").groupBy("line").agg(F.sum("n").alias("least")), error


def _counted(lines: DataFrame, estimates: DataFrame | None, floor: int, error: int, name: str) -> DataFrame:
    """Exact counts of the lines that may occur ``floor`` times; of all lines if nothing is known."""
    if estimates is not None:
        asked = stage(estimates.where(F.col("least") + error >= floor).select("line"), "asked_lines")
        lines = lines.join(asked, "line", "left_semi")
    return lines.groupBy("line").agg(F.count("*").alias(name))


def top_lines(df: DataFrame, text: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """The same rows as ``top_repeated_lines``: (line, n) of the ``k`` most frequent lines, ties by text.

    The k-th largest estimate is a count that k lines reach, so the k-th largest count is no smaller. A line whose estimate
    and error together stay below it is none of the first k; one that no summary holds occurs at most as often as the
    errors allow, so it is none either if they stay below. Otherwise all lines are counted.
    """
    lines = exploded_lines(df, text).select("line")
    summaries, estimates, error = _estimates(lines, counters)
    best = [r["least"] for r in estimates.orderBy(F.desc("least")).limit(k).collect()]
    proven = len(best) == k and best[-1] > error
    counts = _counted(lines, estimates if proven else None, best[-1] if proven else 0, error, "n")
    found = stage(counts.orderBy(F.desc("n"), "line").limit(k), "top_lines")
    unstage(summaries)
    return found.orderBy(F.desc("n"), "line")


def lines_in_share(df: DataFrame, text: str, share: float, counters: int = COUNTERS) -> DataFrame:
    """The same rows as ``profile.lines_in_share``: lines found in at least ``share`` of the documents.

    A line of that many documents has an estimate of at least that number less the error; if the error reaches the
    number, all lines are counted.
    """
    lines = df.select(F.explode(F.array_distinct(stripped_lines(F.col(text)))).alias("line")).filter("line <> ''")
    total = df.count()
    summaries, estimates, error = _estimates(lines, counters)
    floor = total * share
    counts = _counted(lines, estimates if error < floor else None, floor, error, "n_docs")
    found = stage(counts.filter(F.col("n_docs") >= F.lit(floor)), "frequent_lines")
    unstage(summaries)
    return found
