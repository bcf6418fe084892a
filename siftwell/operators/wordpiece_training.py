"""Exact training of a subword vocabulary, many merges per pass over the words.

The definition merges one pair at a time: the most frequent neighbouring pair of symbols, of equal ones the first by
text, in all words from left to right. Here each round counts the pairs on all executors, sends the most frequent ones
out and brings back only the runs of symbols in which these pairs can act on each other, summed over all words. On
those runs the driver plays the definition forward as long as what it was not sent cannot matter; then the executors
apply the merges to the words.

Why playing forward is exact. Let ``chosen`` hold every pair counted more than ``floor`` times, and cut each word
between two neighbours that are not such a pair; what is left are the runs. A token made in this round that was no
entry before has one derivation, so it always begins and ends with the same original symbols, and any pair that holds
one stands over one kind of original neighbours. If those are chosen, all places of the pair lie inside runs and its
count there is its count. If not, it occurs at most ``floor`` times, as do all pairs of old symbols that are not
chosen. So as long as the best pair in the runs is counted more than ``floor`` times it is the best of all. A merge
that makes an entry once more breaks the premise: it is still right itself, and the round ends with it.

If so many pairs tie for the best count that no floor separates few of them, the first ones by text are taken, and all
words that hold one are sent whole: nothing is cut, so counts are exact, and the round ends where the first pair that
was left out would be next.

On the executors symbols are numbers, and a batch of words is one array of them: pairs are counted and words are cut
without a step for each word, and what is the same in many words is merged once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import stage, unstage

#: Pairs that one round looks at.
ROUND_PAIRS = 4_096
#: What the driver is sent in a round at most: distinct runs, and symbols in them.
ROUND_RUNS = 50_000
ROUND_SYMBOLS = 500_000

Pair = tuple[str, str]


def merged_token(left: str, right: str, prefix: str) -> str:
    return left + right.removeprefix(prefix)


def split_words(words: DataFrame, alphabet: Sequence[str], prefix: str) -> DataFrame:
    """(symbols, freq): first character plain, the others prefixed; characters outside the alphabet are left out."""
    symbols = F.transform(
        F.split("word", ""),
        lambda c, i: F.when(c.isin(*alphabet), F.when(i == 0, c).otherwise(F.concat(F.lit(prefix), c))),
    )
    return words.select(F.array_compact(symbols).alias("symbols"), "freq")


@dataclass(frozen=True)
class Words:
    """A table of words or runs (symbols, freq), and the symbols by their numbers."""

    table: DataFrame
    symbols: list[str]


#: Counted pairs that a task holds before it adds them up, and merged runs that it remembers.
HELD_PAIRS, HELD_RUNS = 1_000_000, 200_000

_STATE = "symbols array<int>, freq long"
_RUNS = "symbols binary, freq long"


def _batch(symbols: pa.Array, freq: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([symbols, pa.array(freq, pa.int64())], names=["symbols", "freq"])


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def numbered(state: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """(symbols, freq) with the number of each symbol instead of it; words of one symbol, which take no part, are left out."""
    sent = state.sparkSession.sparkContext.broadcast({s: i for i, s in enumerate(symbols)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("symbols").flatten().dictionary_encode()
            known = np.array([sent.value[s] for s in found.dictionary.to_pylist()], np.int32)
            flat = known[found.indices.to_numpy()] if len(found) else known
            yield _batch(_lists(flat, np.diff(batch.column("symbols").offsets.to_numpy())), batch.column("freq").to_numpy())

    return state.filter(F.size("symbols") > 1).mapInArrow(run, _STATE)


class _Flat:
    """The words of a batch as one array of symbols."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("symbols")
        self.freq, self.flat = batch.column("freq").to_numpy(), lists.flatten().to_numpy()
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        #: the neighbours at each place as one number; -1 between two words
        self.pairs = np.where(self.word[1:] == self.word[:-1], _codes(self.flat[:-1], self.flat[1:]), -1)

    def runs(self, chosen: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the longest runs of which all neighbours are among the sorted ``chosen``, or of all words that
        hold one (``whole``)."""
        at = np.minimum(np.searchsorted(chosen, self.pairs), len(chosen) - 1)
        hit = np.concatenate([[False], chosen[at] == self.pairs if len(chosen) else np.zeros(len(self.pairs), bool), [False]])
        if whole:
            words = np.unique(self.word[np.flatnonzero(hit) - 1])
            return (np.cumsum(self.sizes) - self.sizes)[words], self.sizes[words]
        start, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
        return start, end - start + 1

    def texts(self, start: np.ndarray, size: np.ndarray) -> pa.DictionaryArray:
        """The runs as strings of bytes, each distinct one once."""
        data = self.flat[_spread(start, size)].astype("<i4")
        offsets = np.concatenate([[0], np.cumsum(size) * 4]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of stretches, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _summed(codes: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Each code once, and the sums of its values."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return [codes[start], *(np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values)]


def pair_counts(state: Words) -> DataFrame:
    """How often two symbols are neighbours (n), and in how many places of the table (places); symbols (a, b) as their
    places in the order of all symbols by text."""
    place = np.empty(len(state.symbols), np.int64)
    place[sorted(range(len(state.symbols)), key=state.symbols.__getitem__)] = np.arange(len(state.symbols))
    sent = state.table.sparkSession.sparkContext.broadcast(place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        total, held, n_held = [none] * 3, [[none] * 3], 0
        for batch in batches:
            words = _Flat(batch)
            inside = words.pairs >= 0
            freq = words.freq[words.word[:-1][inside]]
            held.append(_summed(words.pairs[inside], freq, np.ones(len(freq), np.int64)))
            n_held += len(held[-1][0])
            if n_held >= HELD_PAIRS:
                total, held, n_held = _summed(*map(np.concatenate, zip(total, *held))), [[none] * 3], 0
        codes, n, places = _summed(*map(np.concatenate, zip(total, *held)))
        a, b = sent.value[codes >> 32], sent.value[codes & 0xFFFFFFFF]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n, places)], names=["a", "b", "n", "places"])

    counted = state.table.mapInArrow(count, "a long, b long, n long, places long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


def runs_of(symbols: Sequence[str], chosen: frozenset[Pair], whole: bool) -> list[list[str]]:
    """The word, if it holds a chosen pair (``whole``), or its longest runs of which all neighbours are chosen pairs."""
    found = [pair in chosen for pair in zip(symbols, symbols[1:])]
    if whole:
        return [list(symbols)] if any(found) else []
    runs, start = [], 0
    for i, hit in enumerate([*found, False]):
        if not hit:
            if i > start:
                runs.append(list(symbols[start : i + 1]))
            start = i + 1
    return runs


def _chosen_codes(chosen: Sequence[Pair], symbols: Sequence[str]) -> np.ndarray:
    number = {s: i for i, s in enumerate(symbols)}
    return np.sort(np.array([number[a] << 32 | number[b] for a, b in chosen], np.int64))


def _runs(state: Words, chosen: Sequence[Pair], whole: bool) -> Words:
    """What ``runs_of`` cuts out of each word, added up; symbols as bytes."""
    sent = state.table.sparkSession.sparkContext.broadcast(_chosen_codes(chosen, state.symbols))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Flat(batch)
            start, size = words.runs(sent.value, whole)
            texts = words.texts(start, size)
            _, freq = _summed(texts.indices.to_numpy().astype(np.int64), words.freq[words.word[start]])
            yield _batch(texts.dictionary, freq)

    found = state.table.mapInArrow(cut, _RUNS).groupBy("symbols").agg(F.sum("freq").alias("freq"))
    return Words(found, state.symbols)


def merge_word(symbols: Sequence[str], ranks: dict[Pair, int], prefix: str) -> list[str]:
    """The merges applied one after the other in the order of ``ranks``, each from left to right, in n log n steps."""
    token: list[str | None] = list(symbols)
    n = len(token)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i) for i in range(n - 1) if (r := ranks.get((token[i], token[i + 1]))) is not None]
    heapq.heapify(queue)
    while queue:
        r, i = heapq.heappop(queue)
        j = after[i]
        if token[i] is None or j >= n or ranks.get((token[i], token[j])) != r:
            continue
        token[i] = merged_token(token[i], token[j], prefix)
        token[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            # a pair that an earlier merge was about is not merged again
            if left >= 0 and right < n and (s := ranks.get((token[left], token[right]), -1)) > r:
                heapq.heappush(queue, (s, left))
    return [t for t in token if t is not None]


def _joints(merges: Sequence[Pair], symbols: Sequence[str], prefix: str) -> list[Pair]:
    """The neighbours, as they are before the merges, between which one of these may join.

    A token that is made here and used by a later merge is made in one way (a merge that makes an entry again is the
    last, and pairs that don't touch don't use each other's tokens), so it ends in the same old symbols everywhere.
    """
    ends: dict[str, Pair] = {}
    known, found = set(symbols), {}
    for a, b in merges:
        (first, left), (right, last) = ends.get(a, (a, a)), ends.get(b, (b, b))
        found[left, right] = None
        token = merged_token(a, b, prefix)
        if token not in known:
            ends.setdefault(token, (first, last))
    return list(found)


def apply_merges(state: Words, merges: Sequence[Pair], prefix: str) -> Words:
    """The words with the merges applied; words of one symbol, which take no further part, are left out.

    Words are cut where nothing can be joined; each distinct run that is left is merged once in a task.
    """
    symbols = list(dict.fromkeys([*state.symbols, *(merged_token(a, b, prefix) for a, b in merges)]))
    joints = _chosen_codes(_joints(merges, state.symbols, prefix), state.symbols)
    sent = state.table.sparkSession.sparkContext.broadcast((symbols, joints, {pair: i for i, pair in enumerate(merges)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, joints, ranks = sent.value
        number = {s: i for i, s in enumerate(symbols)}
        merged: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            known = merged.get(text)
            if known is None:
                tokens = merge_word([symbols[i] for i in np.frombuffer(text, "<i4").tolist()], ranks, prefix)
                known = np.array([number[t] for t in tokens], np.int32)
                if len(merged) >= HELD_RUNS:
                    merged.clear()
                merged[text] = known
            return known

        for batch in batches:
            words = _Flat(batch)
            start, size = words.runs(joints)
            flat, kept = words.flat.copy(), np.ones(len(words.flat), bool)
            if len(start):
                texts = words.texts(start, size)
                made, which = [of(text) for text in texts.dictionary.to_pylist()], texts.indices.to_numpy()
                n = np.array(list(map(len, made)))
                begin = (np.cumsum(n) - n)[which]
                kept[_spread(start, size)] = False
                at = _spread(start, n[which])
                flat[at], kept[at] = np.concatenate(made)[_spread(begin, n[which])], True
            sizes = np.bincount(words.word[kept], minlength=len(words.sizes))
            long = sizes > 1
            yield _batch(_lists(flat[kept & long[words.word]], sizes[long]), words.freq[long])

    return Words(state.table.mapInArrow(run, _STATE), symbols)


def play_forward(
    runs: Sequence[tuple[list[str], int]], last: tuple[int, str, str], taken: set[str], room: int, prefix: str
) -> list[Pair]:
    """Merges one pair at a time in the runs, while the best one ranks before ``last`` (-count, a, b).

    Ends when ``room`` new entries are made, or after a merge that makes an entry of ``taken`` or of this round again.
    """
    words = [list(symbols) for symbols, _ in runs]
    freqs = [n for _, n in runs]
    counts: dict[Pair, int] = defaultdict(int)
    places: dict[Pair, set[int]] = defaultdict(set)
    for i, word in enumerate(words):
        for pair in zip(word, word[1:]):
            counts[pair] += freqs[i]
            places[pair].add(i)
    queue = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(queue)
    merges: list[Pair] = []
    made: set[str] = set()
    while queue and len(made) < room:
        n, a, b = heapq.heappop(queue)
        if counts.get((a, b), 0) != -n:
            continue
        if (n, a, b) >= last:
            break
        merges.append((a, b))
        token = merged_token(a, b, prefix)
        if token in taken or token in made:
            break
        made.add(token)
        changed: set[Pair] = set()
        for i in places.pop((a, b)):
            old, new, j = words[i], [], 0
            while j < len(old):
                if old[j] == a and j + 1 < len(old) and old[j + 1] == b:
                    new.append(token)
                    j += 2
                else:
                    new.append(old[j])
                    j += 1
            if len(new) == len(old):
                continue
            for pair in zip(old, old[1:]):
                counts[pair] -= freqs[i]
                changed.add(pair)
            for pair in zip(new, new[1:]):
                counts[pair] += freqs[i]
                places[pair].add(i)
                changed.add(pair)
            words[i] = new
        for pair in changed:
            if counts[pair] > 0:
                heapq.heappush(queue, (-counts[pair], *pair))
    return merges


def _collected(runs: Words) -> list[tuple[list[str], int]] | None:
    """The runs, or None if they are more than a round may send."""
    table = stage(runs.table, "runs")
    size = table.agg(F.count("*").alias("n"), (F.sum(F.octet_length("symbols")) / 4).alias("symbols")).first()
    fits = size["n"] <= ROUND_RUNS and (size["symbols"] or 0) <= ROUND_SYMBOLS
    rows = table.collect() if fits else []
    unstage(table)
    return [([runs.symbols[i] for i in np.frombuffer(r["symbols"], "<i4")], r["freq"]) for r in rows] if fits else None


def look_ahead(
    state: Words, ranked: Sequence[tuple[str, str, int, int]], floor: int, n_pairs: int, taken: set[str], room: int, prefix: str
) -> tuple[list[Pair], int]:
    """(merges, pairs to look at next time) of one round, from the ranking (a, b, n, places) of its best pairs.

    ``floor`` is a count that no pair outside the ranking exceeds. Fewer pairs are looked at until what has to be sent
    keeps within the bounds; a single pair needs nothing to be sent.
    """
    while True:
        at = ranked[n_pairs][2] if n_pairs < len(ranked) else floor
        chosen = [(a, b) for a, b, n, _ in ranked[:n_pairs] if n > at]
        if not chosen:
            break
        runs = _collected(_runs(state, chosen, False))
        if runs is not None:
            more = 2 * n_pairs if 2 * len(runs) < ROUND_RUNS else n_pairs
            return play_forward(runs, (-at, "", ""), taken, room, prefix), min(more, ROUND_PAIRS)
        n_pairs //= 4
        if not n_pairs:
            return [ranked[0][:2]], 1
    # a tie at the top that is larger than the round
    held = first = 0
    while first < len(ranked) - 1 and ranked[first][2] == ranked[0][2] and held + ranked[first][3] <= ROUND_RUNS:
        held += ranked[first][3]
        first += 1
    runs = _collected(_runs(state, [r[:2] for r in ranked[:first]], True)) if first else None
    if runs is None:
        return [ranked[0][:2]], max(1, n_pairs)
    a, b, n, _ = ranked[first]
    return play_forward(runs, (-n, a, b), taken, room, prefix), n_pairs


def apart(ranked: Sequence[tuple[str, str, int, int]], limit: int, prefix: str) -> list[Pair]:
    """Up to ``limit`` pairs of a ranking that don't touch: none starts where another ends or uses a token it makes."""
    chosen: list[Pair] = []
    lefts: set[str] = set()
    rights: set[str] = set()
    made: set[str] = set()
    for a, b, *_ in ranked:
        token = merged_token(a, b, prefix)
        free = a not in rights and b not in lefts and token not in lefts and token not in rights
        if free and made.isdisjoint((a, b, token)):
            chosen.append((a, b))
            lefts.add(a)
            rights.add(b)
            made.add(token)
            if len(chosen) == limit:
                break
    return chosen


def learn_merges(
    state: DataFrame, vocab: list[str], size: int, min_frequency: int, prefix: str, merges_per_round: int | None = None
) -> list[str]:
    """``vocab`` with the tokens of the merges learned from ``state`` (symbols, freq), until it has ``size`` entries.

    Each round is a pass over the written words, which are then written anew and the old ones deleted.
    """
    vocab, taken = list(vocab), set(vocab)
    fetch = ROUND_PAIRS if merges_per_round is None else 4 * merges_per_round
    n_pairs = max(1, fetch // 64)
    # dealt evenly, since a word list may come as one file; larger files are split when read
    dealt = state.repartition(state.sparkSession.sparkContext.defaultParallelism, "symbols")
    words = Words(stage(numbered(dealt, vocab), "symbols"), list(vocab))
    while len(vocab) < size:
        frequent = pair_counts(words).filter(F.col("n") >= min_frequency)
        best = frequent.orderBy(F.desc("n"), "a", "b").limit(fetch + 1).collect()
        if not best:
            break
        by_text = sorted(words.symbols)
        ranked = [(by_text[r["a"]], by_text[r["b"]], r["n"], r["places"]) for r in best]
        room = size - len(vocab)
        if merges_per_round is None:
            floor = min_frequency - 1 if len(ranked) <= fetch else ranked[-1][2]
            merges, n_pairs = look_ahead(words, ranked, floor, n_pairs, taken, room, prefix)
        else:
            merges = apart(ranked, merges_per_round, prefix)[:room]
        for a, b in merges:
            token = merged_token(a, b, prefix)
            if token not in taken:
                taken.add(token)
                vocab.append(token)
        before, after = words.table, apply_merges(words, merges, prefix)
        words = Words(stage(after.table, "symbols"), after.symbols)
        unstage(before)
    unstage(words.table)
    return vocab
