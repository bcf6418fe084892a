"""Exact similarity join on word shingles by T-occurrence search."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from siftwell.llm.near_sets import Method, components_of, one_per_component
from siftwell.llm.wordhash import mix

#: A step of a binary search as a share of a step of the heap, in the choice of the lists that are probed.
PROBE_WEIGHT = 0.01
#: Long lists that are probed at a time.
PROBED_AT_ONCE = 8


@cache
def _class_starts(percent: int) -> np.ndarray:
    """Smallest sizes of the size classes: two sets that link are in the same or in neighbouring classes."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts)


@cache
def _scheme(j: int, percent: int) -> tuple[int, int]:
    """(parts, largest difference) for pairs whose smaller set is in class ``j``.

    Linked sets differ in at most ``d`` shingles, so of more than ``d`` parts of the shingle space at least one holds
    the same shingles in both. A few parts more make up for those that are empty in both.
    """
    starts = _class_starts(percent)
    small = int(starts[j + 1]) - 1
    d = (100 - percent) * (small + small * 100 // percent) // (100 + percent)
    parts = d + 1
    return parts + math.ceil(1.5 * parts * math.exp(-int(starts[j]) / parts)) * (d > 0), d


def signatures(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the parts of a set (sorted). Two different sets that reach ``percent`` share at least one of them."""
    if not len(tokens):
        return tokens
    own = int(np.searchsorted(_class_starts(percent), len(tokens), side="right")) - 1
    found = []
    for j in (own, own - 1):
        if j < 0:
            continue
        parts, d = _scheme(j, percent)
        if d == 0:  # only equal sets link
            continue
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        which, value = part[first], np.add.reduceat(tokens, first)
        if parts - len(first) >= parts - d:  # too many empty parts to leave them out
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), which)
            which, value = np.concatenate([which, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
        found.append(mix(value + mix(which + np.uint64((j + 1) << 32))))
    return np.concatenate(found) if found else tokens[:0]


def _sign(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    found = [signatures(tokens, percent) for tokens in sets]
    return np.concatenate(found), np.array([len(f) for f in found])


class InvertedLists:
    """Inverted lists over the shingles of some sets, searched by dividing them into short and long ones."""

    def __init__(self, sets: list[np.ndarray], indexed: list[int], percent: int):
        self.sizes = np.array([len(s) for s in sets])
        self.percent = percent
        tokens = np.concatenate([sets[i] for i in indexed])
        owners = np.repeat(np.array(indexed), [len(sets[i]) for i in indexed])
        order = np.lexsort((owners, tokens))
        owners, tokens = owners[order], tokens[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        self.starts = np.flatnonzero(new)
        self.tokens = tokens[self.starts]
        self.ends = np.append(self.starts[1:], len(tokens))
        self.owners = owners.tolist()
        # list and owner as one number: all lists, one after the other, are a single sorted array
        self.entries = (np.cumsum(new) - 1) * len(sets) + owners

    def _aside(self, lengths: np.ndarray, need: int) -> int:
        """How many of the lists (by rising length) are better probed than merged."""
        n = len(lengths)
        aside = np.arange(min(need, n))
        merged = np.cumsum(lengths)[n - 1 - aside]
        candidates = merged / (need - aside)
        cost = merged * np.log2(n - aside + 1) + PROBE_WEIGHT * candidates * aside * math.log2(int(lengths[-1]) + 1)
        return int(np.argmin(cost))

    def search(self, tokens: np.ndarray) -> Iterator[int]:
        """Positions of all indexed sets that link with ``tokens``, in order.

        A set that links holds at least T of the tokens. With L long lists put aside it stands in at least T - L short
        ones: those are merged by a heap, and what occurs often enough is looked up in the long ones by binary search.
        """
        need = -(-self.percent * len(tokens) // 100)
        at = np.searchsorted(self.tokens, tokens)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == tokens]
        if len(at) < need or not need:
            return
        lengths = self.ends[at] - self.starts[at]
        order = np.argsort(lengths, kind="stable")
        aside = self._aside(lengths[order], need)
        short, long = at[order[: len(at) - aside]], at[order[len(at) - aside :]]
        found, counts = [], []
        last, count = -1, 0
        lists = [self.owners[a:b] for a, b in zip(self.starts[short].tolist(), self.ends[short].tolist())]
        for i in heapq.merge(*lists, [len(self.sizes)]):
            if i == last:
                count += 1
                continue
            if last >= 0 and count >= need - aside:
                found.append(last)
                counts.append(count)
            last, count = i, 1
        if found:
            yield from self._reaching(np.array(found), np.array(counts), len(tokens), long)

    def _reaching(self, found: np.ndarray, counts: np.ndarray, size: int, long: np.ndarray) -> list[int]:
        """Those that link: looked up in a few long lists at a time, the shortest first, until they can't reach the overlap."""
        want = -(-self.percent * (size + self.sizes[found]) // (100 + self.percent))
        for start in range(0, len(long), PROBED_AT_ONCE):
            alive = counts + len(long) - start >= want
            found, counts, want = found[alive], counts[alive], want[alive]
            if not len(found):
                return []
            asked = (long[start : start + PROBED_AT_ONCE, None] * len(self.sizes) + found).ravel()
            at = np.searchsorted(self.entries, asked)
            hit = self.entries[np.minimum(at, len(self.entries) - 1)] == asked
            counts = counts + hit.reshape(-1, len(found)).sum(axis=0)
        sizes = self.sizes[found]
        return found[100 * counts >= self.percent * (size + sizes - counts)].tolist()


def _search(sets: list[np.ndarray], indexed: list[int], percent: int) -> Callable[[int], Iterator[int]]:
    lists = InvertedLists(sets, indexed, percent)
    return lambda i: lists.search(sets[i])


T_OCCURRENCE = Method(_sign, _search)


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id): which documents are connected by links.

    A-Z is lower-cased; words are what blanks separate; a document's set holds its distinct runs of ``words`` words, or
    its whole sequence if that is shorter. Two documents link when 100 * intersection >= percent * union. The component
    is named by its smallest doc_id. Documents without words (null, empty or blank texts) link with nothing and keep
    their own id. Rows with equal ids or repeated rows are documents of their own; a null id counts as none when the
    smallest is taken. Texts are read whole, however long. An empty table gives an empty one; other columns are left out.
    """
    return components_of(docs, T_OCCURRENCE, doc_id, text, words, percent)


def keep_one_per_component(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id (of equal ids, the smallest hash).

    Documents without words are kept. Of repeated rows (same id, same text) one stays. Texts are read whole, however long;
    an empty table gives an empty one; all columns are kept as they are, whatever they are called.
    """
    return one_per_component(docs, T_OCCURRENCE, doc_id, text, words, percent)
