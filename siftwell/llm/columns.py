"""Column helpers shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The bytes of [\x20\x09-\x0D].
BLANKS = "".join(map(chr, (0x20, *range(0x09, 0x0E))))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; a text without wide characters takes the fast path."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The columns an operator needs, under its own names; other columns, clashing or not, stay behind."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


#: Bytes of a table of narrow rows that may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def sent_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df``, marked for broadcasting if its rows, of at most ``row_bytes`` each, are few; else the join shuffles it.

    ``rows`` is a bound on their number; without it the rows are counted, so ``df`` should be a written table.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
