"""Corpus -> vocabulary file and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.ranking import HEAD_LINES, head_lines
from siftwell.operators.wordpiece import (
    MIN_FREQUENCY,
    VOCAB_SIZE,
    encode_wordpiece,
    oov_rate,
    segment_morphemes,
    train_wordpiece,
    word_counts,
)
from siftwell.session import stage
from siftwell.sources.sinks import sink_vocab
from siftwell.sources.text_lines import scan_corpus_lines


def train_vocab(
    spark: SparkSession,
    corpus_path: str,
    vocab_path: str,
    morphemes: bool = False,
    size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    merges_per_round: int | None = None,
    analyzer=None,
    segmented_path: str | None = None,
) -> DataFrame:
    """Train on a text corpus, write the vocabulary, and return the unknown-token rate of its head.

    With ``morphemes`` the lines are segmented first, by ``analyzer`` or by the built-in patterns; the segmented corpus
    is written once, to ``segmented_path`` if that is given, and all that follows reads it.
    """
    lines = scan_corpus_lines(spark, corpus_path)
    if morphemes:
        lines = segment_morphemes(lines, "value", "value", factory=analyzer)
        if segmented_path is None:
            lines = stage(lines, "segmented")
        else:
            lines.write.parquet(segmented_path)
            lines = spark.read.parquet(segmented_path)
    if lines.isEmpty():
        raise ValueError(f"no corpus line in {corpus_path}: build the corpus first")
    vocab = train_wordpiece(
        word_counts(lines, "value"), size, min_frequency, merges_per_round=merges_per_round
    )
    sink_vocab(vocab, vocab_path)
    head = head_lines(lines, "ord", HEAD_LINES)
    return oov_rate(encode_wordpiece(head, "value", vocab))
