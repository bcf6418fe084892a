"""SentencePiece encoding and decoding of columns, by the transducer of ``piece_model``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from siftwell.llm.columns import free_name
from siftwell.llm.piece_model import PieceDecoder, PieceModel, PieceTransducer

#: Rows that are encoded or decoded before they are handed on.
ROWS_AT_ONCE = 500


def read_model(path: str | None = None) -> bytes:
    """Bytes of a model file (by default the public 32,000-piece one): a fixed file of half a megabyte, sent to tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def transducer(model: bytes) -> PieceTransducer:
    return PieceTransducer(PieceModel.parse(model))


@lru_cache(maxsize=2)
def _decoder(model: bytes) -> PieceDecoder:
    return PieceDecoder(PieceModel.parse(model))


def _pieces_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows of all batches, ``ROWS_AT_ONCE`` at a time."""
    for batch in batches:
        for start in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


@contextmanager
def _machine(model: bytes) -> Iterator[PieceTransducer]:
    """The worker's transducer, for one task: the worker lives longer, so its units and Arrow's spare memory are given back."""
    machine = transducer(model)
    try:
        yield machine
    finally:
        machine.forget()
        pa.default_memory_pool().release_unused()


def _encoded(batches: Iterator[pa.Array], model: bytes) -> Iterator[pa.Array]:
    with _machine(model) as machine:
        for texts in _pieces_of(batches):
            found = [machine.encode_array(t or "") for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))


def _encoded_and_decoded(batches: Iterator[pa.Array], model: bytes) -> Iterator[pa.Array]:
    with _machine(model) as machine:
        for texts in _pieces_of(batches):
            found, decoded = [], []
            for t in texts.to_pylist():
                ids = machine.encode_array(t or "")
                found.append(ids)
                decoded.append(machine.decode(ids.tolist()))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = pa.array(np.concatenate([*found, np.empty(0, np.int32)]))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], ["ids", "decoded"])


def encode_pieces(text: Column, model: bytes) -> Column:
    """array<int> of the ids of a text; null counts as empty, and an empty text has no ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _encoded(batches, model)

    # said to be nondeterministic so that the optimiser doesn't encode again for every use of the column
    return arrow_udf(run, "array<int>", ArrowUDFType.SCALAR_ITER).asNondeterministic()(text)


def decode_pieces(ids: Column, model: bytes) -> Column:
    """The text of an array of ids; null for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = _decoder(model).decode
        for rows in _pieces_of(batches):
            ends, ids, known = rows.offsets.to_numpy(), rows.values.to_numpy(), rows.is_valid().to_pylist()
            # ids become Python numbers one row at a time
            texts = (decode(ids[ends[i] : ends[i + 1]].tolist()) if ok else None for i, ok in enumerate(known))
            yield pa.array(texts, pa.string())

    return arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(ids)


def encode_and_decode(text: Column, model: bytes) -> Column:
    """struct<ids, decoded>: the ids of a text and the text that they give, in one pass through Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _encoded_and_decoded(batches, model)

    return arrow_udf(run, "struct<ids: array<int>, decoded: string>", ArrowUDFType.SCALAR_ITER).asNondeterministic()(text)


def tokenize(docs: DataFrame, text: str = "text", model: bytes | None = None, out: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each text in ``out``, which is replaced if there; rows stay as they are, repeated or not."""
    return docs.withColumn(out, encode_pieces(F.col(f"`{text}`"), read_model() if model is None else model))


def round_trip(
    docs: DataFrame, text: str = "text", model: bytes | None = None, ids: str = "piece_ids", decoded: str = "decoded"
) -> DataFrame:
    """``docs`` with both: the ids of each text, and what they decode to. Columns of these names are replaced."""
    both = free_name(docs, "pieces_and_text")
    pair = encode_and_decode(F.col(f"`{text}`"), read_model() if model is None else model)
    return docs.withColumn(both, pair).withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["decoded"]}).drop(both)


def detokenize(docs: DataFrame, ids: str = "piece_ids", model: bytes | None = None, out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``out``: the normalised text, which here is the text itself."""
    return docs.withColumn(out, decode_pieces(F.col(f"`{ids}`"), read_model() if model is None else model))
