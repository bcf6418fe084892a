"""Incremental form of the indexing job."""
