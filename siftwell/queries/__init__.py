"""Registered queries: each pairs a Spark query over the given tables with its SQL counterpart."""

from siftwell.queries.registry import ORACLES, QUERIES  # noqa: F401
from siftwell.queries import (  # noqa: F401  (importing fills the registry)
    html_queries,
    io_queries,
    search_queries,
    table_queries,
    text_queries,
    token_queries,
)
