"""Overlapping chunks, their ids and their vectors."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.batches import text_slices

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
# Tried from the coarsest to the finest; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separators: Sequence[str]) -> tuple[list[str], Sequence[str]]:
    """Cut at the first separator present; it opens the piece after it, so no character is lost.

    Also returns the separators left for pieces that are still too long.
    """
    at = next(i for i, separator in enumerate(separators) if separator in text)
    separator = separators[at]
    if not separator:
        return list(text), ()
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + part for part in rest)) if p], separators[at + 1 :]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy windows over neighbouring pieces, each carrying the tail of the one before."""
    window, length = deque(), 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window)
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.popleft())
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window)


def split_recursive(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, stripped, blank ones left out."""
    chunks, run = [], []
    pieces, finer = _pieces(text, separators)
    for piece in pieces:
        if len(piece) < size or not finer:
            run.append(piece)
            continue
        chunks.extend(_pack(run, size, overlap))
        run = []
        chunks.extend(split_recursive(piece, size, overlap, finer))
    chunks.extend(_pack(run, size, overlap))
    return [c for c in map(str.strip, chunks) if c]


def chunk_texts(col: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of the chunks of a body; null for a null body."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be smaller than the chunk size")

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for bodies in text_slices(batch):
                chunks = [None if b is None else split_recursive(b, size, overlap) for b in bodies.to_pylist()]
                yield pa.array(chunks, pa.list_(pa.string()))

    return split(col)


def chunk_recursive(
    df: DataFrame, text: str, *keep: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk: the kept columns, ``chunk_index`` from 0 and ``chunk_text``."""
    chunks = F.posexplode(chunk_texts(F.col(text), size, overlap)).alias("chunk_index", "chunk_text")
    return df.select(*keep, chunks)


def chunk_point_id(key: Column, chunk_index: Column) -> Column:
    """UUID-shaped id that depends on posting and position only, so a re-run writes the same ids."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), chunk_index.cast("string")))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


EMBEDDING_DIMENSION = 1536
# texts that are embedded at a time
EMBED_ROWS = 500
# words whose buckets a task remembers
BUCKET_CACHE = 200_000

Embedder = Callable[[Sequence[str]], np.ndarray]


def hashing_embedder(dimension: int = EMBEDDING_DIMENSION) -> Callable[[], Embedder]:
    """Factory of the bundled embedder: counts of whitespace words hashed to buckets, unit length.

    It stands in for an outside embedding model; a text without words gets the zero vector.
    """

    def factory() -> Embedder:
        buckets: dict[str, int] = {}

        def bucket(word: str) -> int:
            at = buckets.get(word)
            if at is None:
                if len(buckets) >= BUCKET_CACHE:
                    buckets.clear()
                at = buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension
            return at

        def embed(texts: Sequence[str]) -> np.ndarray:
            words = [text.split() for text in texts]
            flat = [w for some in words for w in some]
            # a word is hashed once per call, and counts are added up for all texts together
            known = {w: bucket(w) for w in set(flat)}
            cells = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            cells += np.repeat(np.arange(len(texts)), list(map(len, words))) * dimension
            out = np.bincount(cells, minlength=len(texts) * dimension).astype(float).reshape(len(texts), dimension)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, norms, out=out, where=norms > 0)

        return embed

    return factory


def embed_chunks(
    df: DataFrame,
    text: str,
    factory: Callable[[], Embedder] | None = None,
    output: str = "vector",
    dtype: str = "float",
) -> DataFrame:
    """Adds a vector per text. The factory runs once per task, the embedder once per ``EMBED_ROWS`` texts, whose vectors then leave the task."""
    build = factory or hashing_embedder()

    @F.arrow_udf(f"array<{dtype}>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = build()
        for batch in batches:
            for at in range(0, len(batch), EMBED_ROWS):
                found = np.asarray(embedder(batch.slice(at, EMBED_ROWS).fill_null("").to_pylist()))
                found = found.astype(np.float64 if dtype == "double" else np.float32)
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                yield pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    return df.withColumn(output, embed(F.col(text)))
