"""64-bit hashes of the words of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; the tables of powers have as many entries.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: True for the bytes between words: the blanks \x20 and \x09-\x0D, or all ASCII but digits and letters.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALPHANUMERIC = np.zeros(256, dtype=bool)
NOT_ALPHANUMERIC[:128] = True
NOT_ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to ``n``."""
    if not _powers or len(_powers[0]) != n + 1:
        up, down = np.full(n + 1, _BASE, dtype=np.uint64), np.full(n + 1, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def word_spans(joined: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, bytes) of all words of some UTF-8, in order, with A-Z lower-cased; ``between`` marks the bytes between words.

    A word's bytes are summed with powers of a base by their place in it. Bytes are taken ``SEGMENT`` at a time; a word that
    goes on in the next segments is put together from its sums in each.
    """
    up, down = _tables(SEGMENT)
    values, sizes, places = [], [], []
    before = True
    for start in range(0, len(joined), SEGMENT):
        piece = joined[start : start + SEGMENT]
        gap = between[piece]
        inside = np.zeros(len(piece) + 2, dtype=np.int8)
        inside[1:-1] = ~gap
        step = np.diff(inside)
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        goes_on, before = not before, gap[-1]
        if not len(first):
            continue
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        value, size = (total[last] - total[first]) * down[first], last - first
        if goes_on and first[0] == 0:
            with np.errstate(over="ignore"):
                values[-1][-1] += value[0] * _power(int(sizes[-1][-1]))
            sizes[-1][-1] += size[0]
            value, size, first = value[1:], size[1:], first[1:]
        if len(first):
            values.append(value)
            sizes.append(size)
            places.append(first + start)
    if not values:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    size = np.concatenate(sizes)
    return mix(np.concatenate(values) + size.astype(np.uint64)), np.concatenate(places), size


def hash_words(texts: Sequence[bytes], between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, with A-Z lower-cased, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    hashes, places, _ = word_spans(joined, between)
    return hashes, np.diff(np.searchsorted(places, begins))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of fewer words, of the whole sequence."""
    if not len(words):
        return words
    width = min(size, len(words))
    value = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        value = mix(value + words[i : len(words) - width + 1 + i])
    return np.unique(value)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(lengths: Sequence[int], limit: int = 2 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one row."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
