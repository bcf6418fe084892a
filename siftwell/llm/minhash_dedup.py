"""Near duplicates by MinHash with tensored banding."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.near_sets import Method, components_of, one_per_component
from siftwell.llm.wordhash import mix

#: Minhashes in each of the two parts of a table key, and the share of links that no table finds.
ROWS = 3
MISSED = 1e-4


def collection_size(percent: int) -> int:
    """How many parts each of the two collections has.

    A table key is a part of the first collection with a part of the second, so two sets meet if they agree on any part of
    both: with m parts of r minhashes each and similarity s the chance is (1 - (1 - s^r)^m)^2. That gives m * m tables of
    2 r minhashes from 2 m r minhashes in all, where tables of their own would need 2 m m r.
    """
    agree = (percent / 100) ** ROWS
    return 1 if agree >= 1 else math.ceil(math.log(MISSED / 2) / math.log(1 - agree))


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(sets, n): the least value of each of ``n`` hash functions over each set; no set is empty."""
    tokens = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    found = np.empty((len(sets), n), dtype=np.uint64)
    for k in range(n):
        found[:, k] = np.minimum.reduceat((tokens ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), starts)
    return found


def collections(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The two collections of parts, each (sets, m)."""
    m = collection_size(percent)
    hashes = minhashes(sets, 2 * m * ROWS).reshape(len(sets), 2 * m, ROWS)
    parts = np.broadcast_to(np.arange(2 * m, dtype=np.uint64), hashes.shape[:2])
    for r in range(ROWS):
        parts = mix(parts + hashes[:, :, r])
    return parts[:, :m], parts[:, m:]


def _table_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = collections(sets, percent)
    keys = mix(one[:, :, None] + mix(two)[:, None, :]).reshape(len(sets), -1)
    return keys.ravel(), np.full(len(sets), keys.shape[1])


def _confirmed(sets: list[np.ndarray], indexed: list[int], percent: int) -> Callable[[int], Iterator[int]]:
    """Sets of ``indexed`` that link with set i, by the number of shingles they share: those of i are looked up at once."""
    tokens = np.concatenate([sets[j] for j in indexed])
    owner = np.repeat(np.arange(len(indexed)), [len(sets[j]) for j in indexed])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(sets[j]) for j in indexed])

    def found(i: int) -> Iterator[int]:
        start, end = np.searchsorted(tokens, sets[i]), np.searchsorted(tokens, sets[i], side="right")
        n = end - start
        at = np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(indexed))
        for j in np.flatnonzero(100 * shared >= percent * (len(sets[i]) + sizes - shared)).tolist():
            yield indexed[j]

    return found


TENSORED_MINHASH = Method(_table_keys, _confirmed)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): which documents are near duplicates, and which of them stays.

    A-Z is lower-cased; words are what blanks separate; a document's set holds its distinct runs of ``words`` words, or
    its whole sequence if that is shorter. Two documents link when 100 * intersection >= percent * union, found through a
    shared table key and confirmed on their whole sets; of the pairs just at the threshold a share of at most ``MISSED``
    has no table in common (fewer, the more alike they are), and they are still joined if others connect them. The
    component is named by its smallest doc_id, and that document is kept.

    Documents without words (null, empty or blank texts) link with nothing and are kept. Rows with equal ids or repeated
    rows are documents of their own and all of them are kept if their id names the component; a null id counts as none
    when the smallest is taken, and its row is kept only if it is alone. Texts are read whole, however long. An empty table
    gives an empty one; other columns are left out, whatever they are called.
    """
    found = components_of(docs, TENSORED_MINHASH, doc_id, text, words, percent)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id (of equal ids, the smallest hash).

    Documents without words are kept. Of repeated rows (same id, same text) one stays. Texts are read whole, however long;
    an empty table gives an empty one; all columns are kept as they are, whatever they are called.
    """
    return one_per_component(docs, TENSORED_MINHASH, doc_id, text, words, percent)
