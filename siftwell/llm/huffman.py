"""Canonical Huffman codes of limited length over integer ids, and bit streams that are decoded by table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Longest code; the decoding table has two to this power entries. More symbols than fit get a longer limit.
MAX_BITS = 18
#: Ids between two checkpoints of a stream.
CHECKPOINT_IDS = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of the best code with no length above ``limit``; 0 for ids that don't occur.

    Package-merge: at every level the symbols and the pairs of the level below are merged by weight. Of the top level
    the 2n - 2 lightest entries are taken; a symbol is as long as the number of levels in which it is among those taken.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, levels = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2]
        both = np.concatenate([weights, pairs[::2] + pairs[1::2]])
        sequence = np.argsort(both, kind="stable")
        level = both[sequence]
        levels.append(sequence < n)
    taken = 2 * n - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:taken].sum())
        lengths[order[:symbols]] += 1
        taken = 2 * (taken - symbols)
    return lengths


@dataclass
class HuffmanCode:
    """The canonical code of some lengths: codes of equal length follow each other in the order of ids."""

    lengths: np.ndarray

    @cached_property
    def _order(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.argsort(self.lengths[used], kind="stable")]

    @cached_property
    def bits(self) -> int:
        return max(1, int(self.lengths.max(initial=0)))

    @cached_property
    def codes(self) -> np.ndarray:
        # a code begins where the table entries of the codes before it end
        span = np.uint64(1) << (self.bits - self.lengths[self._order]).astype(np.uint64)
        begin = np.cumsum(span) - span
        codes = np.zeros(len(self.lengths), np.uint64)
        codes[self._order] = begin >> (self.bits - self.lengths[self._order]).astype(np.uint64)
        return codes

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each value of the next ``bits`` bits, the id and the length of its code."""
        span = 1 << (self.bits - self.lengths[self._order]).astype(np.int64)
        ids = np.zeros(1 << self.bits, np.uint32)
        ids[: span.sum()] = np.repeat(self._order, span)
        return ids, self.lengths[ids].astype(np.int64)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream (most significant bit first) and the bit offsets of every ``CHECKPOINT_IDS``-th id."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        length = self.lengths[ids].astype(np.int64)
        end = np.cumsum(length)
        begin = end - length
        value = self.codes[ids] << (64 - length - (begin & 31)).astype(np.uint64)
        # codes that begin in the same 32 bits are joined; what goes beyond is joined to the 32 bits after
        word = begin >> 5
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        joined, word = np.bitwise_or.reduceat(value, first), word[first]
        words = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
        words[word] = joined >> np.uint64(32)
        words[word + 1] |= joined & np.uint64(0xFFFFFFFF)
        stream = words.astype(">u4").tobytes()
        return stream[: -(-int(end[-1]) // 8)], begin[::CHECKPOINT_IDS]

    def decode(self, stream: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a stream: all stretches between checkpoints at once, one id of each per step."""
        if not n:
            return np.empty(0, np.uint32)
        words = np.frombuffer(stream + b"\0" * (12 - len(stream) % 4), dtype=">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        ids, length = self.table
        out = np.zeros((CHECKPOINT_IDS, len(checkpoints)), np.uint32)
        at, shift = np.asarray(checkpoints, dtype=np.int64).copy(), np.uint64(64 - self.bits)
        last = n - (len(checkpoints) - 1) * CHECKPOINT_IDS
        for step in range(min(n, CHECKPOINT_IDS)):
            if step == last:
                at = at[:-1]
            next_bits = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> shift
            out[step, : len(at)] = ids[next_bits]
            at += length[next_bits]
        return out.T.reshape(-1)[:n]
