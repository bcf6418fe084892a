"""Token ids of a corpus as Huffman-coded files in document order."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.columns import only
from siftwell.llm.huffman import HuffmanCode, code_lengths
from siftwell.llm.ordering import in_order
from siftwell.llm.wordhash import slices
from siftwell.session import stage, unstage

#: Ids in a block: whole documents, until there are so many.
BLOCK_IDS = 1 << 19
#: Units whose ids a task remembers, and as many again from before.
CACHED_UNITS = 500_000


class CachedTokenizer:
    """A byte-level tokenizer of the ``tokenizers`` library that encodes repeated words once.

    Such a tokenizer splits a text in front of every blank that a visible character follows, and between letters or
    digits and a full stop or comma; no id lies across. So the ids of a text are those of its units. A text that holds a
    special token's string is encoded as a whole, and so is every text if the file describes another kind of tokenizer.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        description = json.loads(data)
        splitter = description.get("pre_tokenizer") or {}
        self.by_units = (
            description.get("normalizer") is None and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True)
        )
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile(r"(?= \S)")
        self.old: _Units = _Units()
        self.now: _Units = _Units()

    def _word(self, letters: str, blank: str) -> list[int]:
        """Ids of letters, with or without a blank in front: the tokenizer does not split them any further."""
        if not letters.isascii():
            letters = "".join(map(_BYTES.__getitem__, letters.encode()))
        return [t.id for t in self.model.tokenize(blank + letters)]

    def _learn(self, keys: list[str]) -> None:
        ids: list[list[int] | None] = []
        flags = []
        for key in keys:
            known = [] if key in ("", _TEXT) else self.old.get(key)
            blank, letters = (_BLANK_BYTE, key[1:]) if key[:1] == " " else ("", key)
            word = letters.isalpha()
            if known is None and word and self.by_units:
                known = self._word(letters, blank)
            ids.append(known)
            flags.append(_ALNUM_LAST if word else _flags(key))
        rest = [i for i, known in enumerate(ids) if known is None]
        for lo in range(0, len(rest), 1000):
            some = rest[lo : lo + 1000]
            for i, encoding in zip(some, self.tokenizer.encode_batch_fast([keys[i] for i in some], add_special_tokens=False)):
                ids[i] = encoding.ids
        self.now.add(keys, ids, flags)

    def _places(self, units: list[str]) -> np.ndarray:
        """Where the units' ids are, after those not known yet have been learned."""
        which = self.now.find(units)
        missing = np.flatnonzero(which < 0)
        if not len(missing):
            return which
        unknown = [units[i] for i in missing.tolist()]
        new = list(dict.fromkeys(unknown))
        if len(self.now.at) + len(new) > CACHED_UNITS:
            self.old, self.now = self.now, _Units()
            self._learn(list(dict.fromkeys(units)))
            return self.now.find(units)
        self._learn(new)
        which[missing] = self.now.find(unknown)
        return which

    def _slowly(self, text: str) -> np.ndarray:
        """Ids of one text, cut by an expression that knows all blanks."""
        whole = not self.by_units or any(x in text for x in self.special)
        which = self._places([text] if whole else [u for u in self.cut.split(text) if u])  # may begin a new cache
        return self.now.take(which)[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text.

        All texts are cut at once, in front of every blank, full stop and comma. Where that was not right, which shows
        in the units themselves, a text is encoded again by ``_slowly``.
        """
        odd = [not self.by_units or _CUT in t or _TEXT in t or any(x in t for x in self.special) for t in texts]
        joined = _TEXT.join("" if skip else t for t, skip in zip(texts, odd))
        marked = joined.replace(" ", _CUT + " ").replace(".", _CUT + ".").replace(",", _CUT + ",")
        units = marked.replace(_TEXT, _CUT + _TEXT + _CUT).split(_CUT)
        which = self._places(units)
        flags = self.now.flags[which]
        of = np.cumsum(flags & _IS_TEXT > 0)  # the text that a unit belongs to
        wrong = flags & _BAD_BLANK > 0
        wrong[1:] |= (flags[1:] & _STOP_FIRST > 0) & (flags[:-1] & _ALNUM_LAST == 0)
        wrong[0] |= flags[0] & _STOP_FIRST > 0
        ids, n = self.now.take(which)
        counts = np.bincount(of, n, minlength=len(texts)).astype(np.int64)
        found = np.split(ids, np.cumsum(counts)[:-1])
        again = {*np.unique(of[wrong]).tolist(), *np.flatnonzero(odd).tolist()}
        for i in again:
            found[i] = self._slowly(texts[i])
        return found


#: Mark the cuts and the ends of texts while texts are split; a text that holds one of them is encoded by itself.
_CUT, _TEXT = "\x1f", "\x1e"
#: What a unit says about cuts: it is the end of a text; its blank belongs to what follows; it begins with a stop; it ends
#: with a letter or digit.
_IS_TEXT, _BAD_BLANK, _STOP_FIRST, _ALNUM_LAST = 1, 2, 4, 8


def _flags(unit: str) -> int:
    if unit == _TEXT:
        return _IS_TEXT
    bad_blank = unit[:1] == " " and (len(unit) == 1 or unit[1].isspace())
    return bad_blank * _BAD_BLANK + (unit[:1] in (".", ",")) * _STOP_FIRST + unit[-1:].isalnum() * _ALNUM_LAST


def _byte_letters() -> list[str]:
    """The characters that byte-level tokenizers write for the 256 bytes: printable ones stand for themselves, the
    others are numbered from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return letters


_BYTES = _byte_letters()
_BLANK_BYTE = _BYTES[0x20]


class _Units:
    """Ids of units, in one flat array."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.flags = np.empty(1 << 14, np.uint8)
        self.used = 0

    def get(self, key: str) -> list[int] | None:
        i = self.at.get(key)
        return None if i is None else self.flat[self.start[i] : self.start[i] + self.length[i]].tolist()

    def add(self, keys: list[str], ids: list[list[int]], flags: list[int]) -> None:
        at, n = len(self.at), np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        while at + len(keys) > len(self.start):
            self.start, self.length, self.flags = (
                np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length, self.flags)
            )
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.start[at : at + len(keys)] = self.used + np.cumsum(n) - n
        self.length[at : at + len(keys)] = n
        self.flags[at : at + len(keys)] = flags
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used += total
        self.at.update(zip(keys, range(at, at + len(keys))))

    def find(self, keys: list[str]) -> np.ndarray:
        """The places of units; -1 for those that are not here."""
        return np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.length[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[which] - (ends - n), n) + np.arange(total)], n


@lru_cache(maxsize=2)
def _tokenizer(data: bytes) -> CachedTokenizer:
    return CachedTokenizer(data)


def read_tokenizer(path: str | None = None) -> bytes:
    """Bytes of a tokenizer file (by default the public byte-level one): a fixed file, sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        return file.read()


def _encode(data: bytes, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = _tokenizer(data), zstandard.ZstdCompressor(level=3)
        narrow = max(tokenizer.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, packed = [], []
            for start, end in slices(list(map(len, texts))):
                for own in tokenizer.encode(texts[start:end]):
                    own = np.append(own, np.uint32(end_id)).astype("<u2" if narrow else "<u4")
                    counts.append(len(own))
                    packed.append(packer.compress(own.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("tie"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()),
                    pa.array([2 if narrow else 4] * len(counts), pa.int32()),
                ],
                names=["doc_id", "tie", "n_tokens", "packed", "width"],
            )

    return run


def _unpack(packed: bytes, width: int, unpacker=zstandard.ZstdDecompressor()) -> np.ndarray:
    return np.frombuffer(unpacker.decompress(packed), dtype=f"<u{width}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of ids: one row for each id it has seen."""
    total, held = np.zeros(1, np.int64), []

    def counted() -> np.ndarray:
        new = np.bincount(np.concatenate(held))
        sums = np.zeros(max(len(total), len(new)), np.int64)
        sums[: len(total)] = total
        sums[: len(new)] += new
        return sums

    for batch in batches:
        for packed, width in zip(batch.column("packed").to_pylist(), batch.column("width").to_pylist()):
            held.append(_unpack(packed, width))
            if len(held) >= 500:
                total, held = counted(), []
    if held:
        total = counted()
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])


def _write_blocks(lengths: np.ndarray, id_type: pa.DataType):
    names = ["part", "first_id", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "stream"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = HuffmanCode(lengths)
        part, before, held, docs, n_held = None, 0, [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            stream, checkpoints = code.encode(ids)
            row = [part, before, len(ids), [d for d, _ in docs], [n for _, n in docs], checkpoints.tolist(), stream]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for bucket, doc, packed, width in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "packed", "width"))):
                if held and (bucket != part or n_held >= BLOCK_IDS):
                    yield block()
                    before += n_held
                    held, docs, n_held = [], [], 0
                if bucket != part:
                    part, before = bucket, 0
                held.append(_unpack(packed, width))
                docs.append((doc, len(held[-1])))
                n_held += len(held[-1])
        if held:
            yield block()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: bytes | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encodes every whole text, appends ``end_id``, and writes all ids below ``path`` in ascending order of documents.

    ``path/codes`` has the code length of each id that occurs, from the counts of the whole corpus. ``path/blocks`` has
    one row per block: its part and place in it, the documents with their numbers of ids, the bit offsets of its
    checkpoints and the stream. Blocks are decoded independently of each other, as are stretches between checkpoints.

    A null text counts as empty and has only the end id. A null doc_id comes first; rows of equal ids are ordered by a
    hash of their texts, so repeated rows are written as often as they occur. An empty table gives files without rows.
    """
    data = read_tokenizer() if tokenizer is None else tokenizer
    rows = only(docs, doc_id=doc_id, text=text).withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType
    ids = stage(
        rows.mapInArrow(
            _encode(data, end_id), f"doc_id {kind.simpleString()}, tie long, n_tokens long, packed binary, width int"
        ),
        "token_ids",
    )
    spark = docs.sparkSession
    counted = ids.select("packed", "width").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted(map(tuple, counted.collect()))  # at most the vocabulary
    counts = np.zeros(found[-1][0] + 1 if found else 0, np.int64)
    for i, n in found:
        counts[i] = n
    lengths = code_lengths(counts)
    codes = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(codes, "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = (
        f"part int, first_id long, n_ids long, doc_ids array<{kind.simpleString()}>, doc_lengths array<long>, "
        "checkpoints array<long>, stream binary"
    )
    ordered = in_order(ids, "doc_id", "tie").select("bucket", "doc_id", "packed", "width")
    ordered.mapInArrow(_write_blocks(lengths, to_arrow_type(kind)), schema).write.parquet(f"{path}/blocks")
    unstage(ids)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents: ``start`` counts the ids of all documents before, ``ids`` are
    unsigned 32-bit integers, little-endian."""
    codes = spark.read.parquet(f"{path}/codes").collect()  # at most the vocabulary
    lengths = np.zeros(max((row.id for row in codes), default=-1) + 1, np.uint8)
    for row in codes:
        lengths[row.id] = row.bits
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # one number per part
    parts = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect()))
    before, total = {}, 0
    for part, n in parts:
        before[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = HuffmanCode(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1)
                part, first, n, _, doc_lengths, checkpoints, stream = (block.column(c)[0].as_py() for c in _BLOCK)
                ids = code.decode(stream, np.array(checkpoints), n).astype("<u4")
                ends = np.cumsum(doc_lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_ids").flatten(), pa.array(before[part] + first + ends - doc_lengths, pa.int64()),
                        pa.array(doc_lengths, pa.int64()),
                        pa.array([own.tobytes() for own in np.split(ids, ends[:-1])], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


_BLOCK = ["part", "first_id", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "stream"]
