"""Subword vocabulary: word counts, training, encoding and checks.

Training works on the table of distinct words with their counts; how merges are found is in
``wordpiece_training``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.batches import list_slices
from siftwell.functions.tokens import SPECIAL_TOKENS, USER_TERMS, pretokenize, segment_forms
from siftwell.operators.wordpiece_training import learn_merges, split_words
from siftwell.session import stage, unstage

VOCAB_SIZE = 32_000
MIN_FREQUENCY = 3
PREFIX = "##"
UNKNOWN = "[UNK]"
#: Entries of a vocabulary that are sent to the tasks.
MOST_ENTRIES = 2_000_000
#: Words that a task encodes at a time, and distinct words whose pieces it remembers.
ENCODED_WORDS, REMEMBERED_WORDS = 200_000, 200_000

VOCAB_SCHEMA = "id int, token string"


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Frequency of every word of a corpus."""
    words = df.select(F.explode(pretokenize(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def form_counts(df: DataFrame, text: str, terms: Sequence[str] = USER_TERMS) -> DataFrame:
    """Frequency of every word of the morpheme-segmented corpus."""
    forms = F.array_join(segment_forms(F.col(text), terms), " ")
    return word_counts(df.select(forms.alias("forms")), "forms")


def alphabet_of(words: DataFrame, limit: int | None = None) -> list[str]:
    """All characters, or the ``limit`` most frequent ones, in code point order."""
    chars = words.select(F.explode(F.split("word", "")).alias("char"), "freq").filter("char <> ''")
    counts = chars.groupBy("char").agg(F.sum("freq").alias("n"))
    if limit is not None:
        counts = counts.orderBy(F.desc("n"), "char").limit(limit)
    return sorted(row["char"] for row in counts.collect())


def train_wordpiece(
    words: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    specials: Sequence[str] = SPECIAL_TOKENS,
    prefix: str = PREFIX,
    limit_alphabet: int | None = None,
    merges_per_round: int | None = None,
) -> DataFrame:
    """Learn a vocabulary from (word, freq): specials, alphabet, then merged pieces by rank.

    Pairs are ranked by count, ties by text, and learned while they occur ``min_frequency`` times. The result equals
    merging one pair at a time; a round of Spark jobs learns hundreds of merges (see ``wordpiece_training``).
    ``merges_per_round`` takes that many pairs which don't touch each other in each round instead, which gives another
    vocabulary.
    """
    spark = words.sparkSession
    words = stage(words.select("word", "freq"), "words")
    alphabet = alphabet_of(words, limit_alphabet)
    state = split_words(words, alphabet, prefix)
    symbols = state.select(F.explode("symbols").alias("s"))
    inner = symbols.filter(F.startswith("s", F.lit(prefix)) & (F.length("s") == len(prefix) + 1)).distinct()
    # at most one entry per alphabet character
    vocab = list(dict.fromkeys([*specials, *alphabet, *sorted(r["s"] for r in inner.collect())]))
    vocab = learn_merges(state, vocab, vocab_size, min_frequency, prefix, merges_per_round)
    unstage(words)
    return spark.createDataFrame(list(enumerate(vocab)), VOCAB_SCHEMA)


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("*").alias("vocab_size"))


class LongestMatch:
    """Greedy longest pieces of a word in one pass over its characters.

    A trie of the entries, and another of what follows the prefix, with failure links: a node knows which pieces the
    greedy match cuts off when its text can't be continued (``pops``), and the node of the text that is then left
    (``fail``; -1 where no entry matches). So no character is read twice, however long the word or the entries are.
    """

    def __init__(self, vocab: Iterable[str], prefix: str, unknown: str):
        self.unknown = unknown
        self.next: list[dict[str, int]] = [{}, {}]  # the starts of words and of rests
        self.fail, self.pops = [-1, -1], [(), ()]
        entry: dict[int, str] = {}
        for token in vocab:
            if token:
                entry[self._add(0, token)] = token
            if token.startswith(prefix) and len(token) > len(prefix):
                entry[self._add(1, token.removeprefix(prefix))] = token
        level = [(node, c, u) for u in (0, 1) for c, node in self.next[u].items()]
        while level:
            for node, c, above in level:
                if node in entry:
                    self.fail[node], self.pops[node] = 1, (entry[node],)
                    continue
                left, pops = self.fail[above], self.pops[above]
                while left >= 0 and c not in self.next[left]:
                    left, pops = self.fail[left], pops + self.pops[left]
                if left >= 0:
                    self.fail[node], self.pops[node] = self.next[left][c], pops
            level = [(node, c, u) for u, _, _ in level for c, node in self.next[u].items()]

    def _add(self, node: int, text: str) -> int:
        for c in text:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.fail.append(-1)
                self.pops.append(())
            node = self.next[node][c]
        return node

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word, or the unknown token where a rest matches nothing."""
        node, found = 0, []
        for c in word:
            while c not in self.next[node]:
                if self.fail[node] < 0:
                    return [self.unknown]
                found += self.pops[node]
                node = self.fail[node]
            node = self.next[node][c]
        while node > 1:
            if self.fail[node] < 0:
                return [self.unknown]
            found += self.pops[node]
            node = self.fail[node]
        return found


def encode_wordpiece(
    df: DataFrame,
    text: str,
    vocab: DataFrame,
    output: str = "tokens",
    prefix: str = PREFIX,
    unknown: str = UNKNOWN,
    specials: Sequence[str] = SPECIAL_TOKENS,
    max_word_chars: int | None = None,
) -> DataFrame:
    """Adds the token array of a text.

    Words are split natively; each task encodes a word once, in time linear in its length, and remembers it, so no row is
    shuffled. The vocabulary travels to the tasks; one of more than ``MOST_ENTRIES`` is refused. Words of more than
    ``max_word_chars`` are unknown, if that is given.
    """
    tokens = [r["token"] for r in vocab.select("token").limit(MOST_ENTRIES + 1).collect()]
    if len(tokens) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of more than {MOST_ENTRIES} entries")
    shared = df.sparkSession.sparkContext.broadcast(LongestMatch(tokens, prefix, unknown))
    whole = frozenset(specials)

    @F.arrow_udf("array<string>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match, memo = shared.value.pieces, {}

        def pieces(word: str) -> list[str]:
            found = memo.get(word)
            if found is None:
                if len(memo) >= REMEMBERED_WORDS:
                    memo.clear()
                if word in whole:
                    found = [word]
                elif max_word_chars is not None and len(word) > max_word_chars:
                    found = [unknown]
                else:
                    found = match(word)
                memo[word] = found
            return found

        for rows in (part for batch in batches for part in list_slices(batch, ENCODED_WORDS)):
            # distinct words of the slice are looked up, then laid out again by position
            words = rows.flatten().dictionary_encode()
            found = pa.array([pieces(w) for w in words.dictionary.to_pylist()], pa.list_(pa.string()))
            placed = found.take(words.indices)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(placed).to_numpy(zero_copy_only=False))])
            starts = rows.offsets.to_numpy()
            offsets = pa.array(ends[starts - starts[0]], pa.int32())
            yield pa.ListArray.from_arrays(offsets, placed.flatten())

    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(output, encode(pretokenize(body, specials)))


def oov_rate(encoded: DataFrame, tokens: str = "tokens", unknown: str = UNKNOWN) -> DataFrame:
    """Tokens, unknown tokens and their percentage; no row where there is no token."""
    missing = F.filter(F.col(tokens), lambda t: t == unknown)
    counts = encoded.agg(
        F.sum(F.size(tokens)).alias("n_tokens"), F.sum(F.size(missing)).alias("n_unknown")
    ).filter("n_tokens > 0")
    return counts.withColumn("unknown_pct", F.col("n_unknown") * 100.0 / F.col("n_tokens"))


def vocab_probe(probes: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Adds ``in_vocab`` to every probe word."""
    entries = vocab.select(F.col("token").alias(word)).distinct().withColumn("_hit", F.lit(True))
    return probes.join(entries, word, "left").withColumn("in_vocab", F.col("_hit").isNotNull()).drop("_hit")


def vocab_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every token of either vocabulary and where it occurs."""
    a = left.select("token").distinct().withColumn("in_left", F.lit(True))
    b = right.select("token").distinct().withColumn("in_right", F.lit(True))
    found = a.join(b, "token", "full_outer")
    return found.select(
        "token",
        F.coalesce("in_left", F.lit(False)).alias("in_left"),
        F.coalesce("in_right", F.lit(False)).alias("in_right"),
    )


def segment_morphemes(
    df: DataFrame, text: str, output: str = "forms", terms: Sequence[str] = USER_TERMS, factory=None
) -> DataFrame:
    """Adds the blank-joined surface forms of a text.

    ``factory`` builds an analyzer once per task: a callable from a list of texts to one list of
    forms per text. Without one the native segmentation is used.
    """
    if factory is None:
        return df.withColumn(output, F.array_join(segment_forms(F.col(text), terms), " "))

    @F.pandas_udf("string")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyze = factory()
        for texts in batches:
            forms = analyze(texts.fillna("").tolist())
            yield pd.Series([" ".join(f for f in row if f.strip()) for row in forms])

    return df.withColumn(output, segment(F.col(text)))


def expansion_candidates(words: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words that a base vocabulary lacks."""
    missing = words.join(base.select(F.col("token").alias("word")), "word", "left_anti")
    return missing.orderBy(F.desc("freq"), "word").limit(k)
