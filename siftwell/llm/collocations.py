"""Phrases whose words stand together more often than apart, by set-oriented relational mining (SETM).

The occurrence relation of a length holds every place of every frequent phrase of that length, sorted by document, piece
and position, and is written to the shared folder. Merging it with itself at adjacent positions gives the places of phrases
one word longer; they are grouped and counted over all documents, and a semi-join with the frequent ones leaves the next
relation. A row holds the places of some whole pieces in order, so a merge never leaves its row and only counts are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.wordhash import mix, slices, text_bytes, word_spans
from siftwell.session import stage, unstage

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: A phrase falls if a longer one that holds it occurs at least this often, in percent of its own occurrences.
CONTAINED = 80
#: Scores are whole numbers; a phrase whose parts never stand apart has half of this.
SCALE = 2_000_000
#: Texts that a task counts at a time, in bytes, and places of a relation.
COUNT_BYTES, COUNT_PLACES = 4 << 20, 1_500_000
#: Words in a row of the first relation: whole pieces, so a longer piece is a row of its own.
ROW_WORDS = 64
#: Bytes of the set of frequent phrases that goes to every task: their ids, or if these are more, a bitmap of them.
KEPT_BYTES = 64 << 20

#: Bytes that end a piece, .,;:!? and \x0A-\x0D, and all bytes that end a word.
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[0x20, 0x09]] = True

_GRAMS = "id long, left long, right long, n long"
_RELATION = "place array<int>, gram array<long>"


# ---- words and their places ----------------------------------------------------------------------------------------


@dataclass
class _Words:
    """All words of some texts: ids (of word and language), first byte and bytes in ``joined``, place and text number.

    Places of neighbours in a piece follow each other; between pieces and texts one is left out.
    """

    joined: bytes
    ids: np.ndarray
    first: np.ndarray
    size: np.ndarray
    place: np.ndarray
    text: np.ndarray


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _words(texts: list[bytes], langs: list[str]) -> _Words:
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    hashes, first, size = word_spans(data, _ENDS_WORD)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, first, side="right")
    piece = np.searchsorted(np.flatnonzero(_ENDS_PIECE[data]), first)
    place = np.arange(len(first)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    salts = {lang: _salt(lang) for lang in set(langs)}
    salt = np.array([salts[lang] for lang in langs], dtype=np.uint64)
    return _Words(joined, mix(hashes + salt[text]).view(np.int64), first, size, place, text)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    for batch in batches:
        texts, langs = text_bytes(batch.column("text")), batch.column("lang").to_pylist()
        for start, end in slices(list(map(len, texts)), COUNT_BYTES):
            yield _words(texts[start:end], langs[start:end]), langs[start:end]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, langs in _batches(batches):
        ids, at, n = np.unique(words.ids, return_index=True, return_counts=True)
        spans = zip(words.first[at].tolist(), (words.first[at] + words.size[at]).tolist())
        spelled = [words.joined[a:b].lower().decode() for a, b in spans]
        lang = pa.array(langs, pa.string()).take(pa.array(words.text[at]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), lang, pa.array(spelled, pa.string()), pa.array(n)], names=["id", "lang", "word", "n"]
        )


# ---- the frequent ones, sent to all tasks --------------------------------------------------------------------------


class Kept:
    """A set of ids in at most ``KEPT_BYTES``: the ids themselves, or a bitmap that holds all of them and some others."""

    def __init__(self, ids: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.ids, self.bits = ids, bits

    def holds(self, ids: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            at = ids.view(np.uint64) % np.uint64(64 * len(self.bits))
            return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        if not len(self.ids):
            return np.zeros(len(ids), dtype=bool)
        return self.ids[np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)] == ids


def kept(frequent: DataFrame) -> Broadcast:
    """The semi-join's side. A phrase that only the bitmap lets through is counted too and found infrequent."""
    n = frequent.count()
    if 8 * n <= KEPT_BYTES:
        ids = np.sort(frequent.select("id").toArrow()["id"].combine_chunks().to_numpy())
        found = Kept(ids=ids)
    else:
        # the id as an unsigned number modulo the bits, which are a power of two
        at = F.col("id").bitwiseAND(F.lit(8 * KEPT_BYTES - 1))
        blocks = frequent.select(F.shiftright(at, 6).alias("block"), F.expr("shiftleft(1L, cast(id & 63 AS int))").alias("bit"))
        table = blocks.groupBy("block").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(KEPT_BYTES // 8, dtype=np.uint64)
        bits[table["block"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        found = Kept(bits=bits)
    return frequent.sparkSession.sparkContext.broadcast(found)


# ---- relations -----------------------------------------------------------------------------------------------------


def _relation_rows(row: np.ndarray, n_rows: int, place: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
    """Places and grams, in order, as one array per row; rows with fewer than two places can hold no longer phrase."""
    size = np.bincount(row, minlength=n_rows)
    some = size > 1
    chosen = some[row]
    offsets = pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32))
    arrays = [
        pa.ListArray.from_arrays(offsets, pa.array(place[chosen].astype(np.int32))),
        pa.ListArray.from_arrays(offsets, pa.array(gram[chosen])),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["place", "gram"])


def _word_places(sent: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _batches(batches):
            if not len(words.ids):
                continue
            # a row holds whole pieces, about ROW_WORDS words, so that a batch of rows is small
            begins = np.concatenate([[True], np.diff(words.place) > 1])
            at = np.arange(len(begins))
            chunk = np.maximum.accumulate(np.where(begins, at, 0)) // ROW_WORDS
            new = np.concatenate([[True], chunk[1:] != chunk[:-1]])
            row = np.cumsum(new) - 1
            place = words.place - words.place[new][row]
            hit = sent.value.holds(words.ids)
            yield _relation_rows(row[hit], int(row[-1]) + 1, place[hit], words.ids[hit])

    return run


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(row of each place, rows, places, grams) of a relation, a bounded number of places at a time."""
    for batch in batches:
        lengths = batch.column("place").value_lengths().to_numpy(zero_copy_only=False)
        for start, end in slices(lengths.tolist(), COUNT_PLACES):
            part = batch.slice(start, end - start)
            place, gram = part.column("place").flatten().to_numpy(), part.column("gram").flatten().to_numpy()
            yield np.repeat(np.arange(end - start), lengths[start:end]), end - start, place, gram


def _adjacent(row: np.ndarray, place: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The merge: positions i whose next place in the same row is the next word of the same piece."""
    return np.flatnonzero((row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1))


def pair_id(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Id of the phrase that begins with ``left`` and ends with ``right``, which overlap in all but one word each."""
    return mix(mix(left.view(np.uint64)) + right.view(np.uint64)).view(np.int64)


def _count_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, _, place, gram in _stored(batches):
        at = _adjacent(row, place, gram)
        left, right = gram[at], gram[at + 1]
        _, first, n = np.unique(pair_id(left, right), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left[first]), pa.array(right[first]), pa.array(n)], names=["left", "right", "n"]
        )


def _with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        ids = pair_id(left.to_numpy(), right.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids), left, right, batch.column("n")], names=["id", "left", "right", "n"])


def _longer_places(sent: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, n_rows, place, gram in _stored(batches):
            at = _adjacent(row, place, gram)
            longer = pair_id(gram[at], gram[at + 1])
            hit = sent.value.holds(longer)
            at = at[hit]
            yield _relation_rows(row[at], n_rows, place[at], longer[hit])

    return run


# ---- phrases -------------------------------------------------------------------------------------------------------


def _extended(grams: DataFrame, shorter: DataFrame) -> DataFrame:
    """Longer phrases (id, left, right, n) with their words, the counts of their heads and tails, and the phrases inside."""
    side = lambda name: shorter.select(F.col("id").alias(name), F.struct(*shorter.columns).alias(f"_{name}"))
    both = grams.join(side("left"), "left").join(side("right"), "right")
    inside = F.when(F.size("_left.words") > 1, F.concat(F.array("left", "right"), "_left.inside", "_right.inside"))
    n = F.array("n")
    return both.select(
        "id", F.col("_left.lang").alias("lang"), "n",
        F.concat("_left.words", F.slice("_right.words", -1, 1)).alias("words"),
        F.concat("_left.heads", n).alias("heads"),
        F.concat("_right.tails", n).alias("tails"),
        F.coalesce(F.array_distinct(inside), F.array().cast("array<long>")).alias("inside"),
    )


def _scored(phrases: DataFrame) -> DataFrame:
    """Adds the lowest-scoring cut: score, l and r. Heads and tails hold the counts of the first and the last k words."""
    words = F.size("words")

    def cut(k: Column) -> Column:
        left, right = F.element_at("heads", k), F.element_at("tails", words - k)
        # whole numbers of up to 38 digits
        product = F.lit(SCALE).cast("decimal(7,0)") * F.col("n").cast("decimal(19,0)")
        total = left.cast("decimal(19,0)") + right.cast("decimal(19,0)")
        return F.struct(F.call_function("div", product, total).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    lowest = F.array_min(F.transform(F.sequence(F.lit(1), words - 1), cut))
    return phrases.withColumn("cut", lowest).select(
        "id", "lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score"
    )


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    contained: int = CONTAINED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to ``longest`` words of each language.

    A-Z is lower-cased; the marks .,;:!? and line ends cut a text into pieces, blanks and tabs a piece into words. ``n`` is
    the number of words of the language, ``a`` that of the phrase's occurrences inside pieces, overlapping ones included; a
    candidate has ``min_count`` of them. Of all cuts in two, with l and r occurrences of the parts, that of least
    floor(SCALE * a / (l + r)) gives the score (the first of equal ones). A candidate falls if a longer candidate that holds
    its words in a row occurs in at least ``contained`` percent of the cases. Ranked by score, a (both falling) and the
    phrase's bytes.

    A null language counts as ``und``, a null or empty text has no word; repeated rows count as often as they occur. Texts
    are read whole, however long. An empty table, or one without candidates, gives no row. Other columns are not read, so
    their names may be anything. Words and phrases are told apart by 64 bits of their hashes.
    """
    own = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    own = own.where("text IS NOT NULL")
    counted = own.mapInArrow(_count_words, "id long, lang string, word string, n long")
    # tasks have already counted their own; a second map-side count would only hold all of it in memory once more
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = counted.repartition(n, "id").groupBy("id").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"))
    counted = stage(counted, "word_counts")
    totals = stage(counted.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    one = F.array("n")
    phrases = counted.where(F.col("n") >= min_count).select(
        "id", "lang", "n", F.array("word").alias("words"), one.alias("heads"), one.alias("tails"),
        F.array().cast("array<long>").alias("inside"),
    )
    phrases = stage(phrases, "phrases_1")
    relation = stage(own.mapInArrow(_word_places(kept(phrases)), _RELATION), "places_1")
    unstage(counted)
    lengths = [phrases]
    for k in range(2, longest + 1):
        counts = relation.mapInArrow(_count_longer, "left long, right long, n long")
        frequent = counts.repartition(n, "left", "right").groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        grams = stage(frequent.mapInArrow(_with_id, _GRAMS), f"grams_{k}")
        lengths.append(stage(_extended(grams, lengths[-1]), f"phrases_{k}"))
        if k < longest:
            longer = stage(relation.mapInArrow(_longer_places(kept(grams)), _RELATION), f"places_{k}")
            unstage(relation)
            relation = longer
        unstage(grams)
    unstage(relation)
    candidates = lengths[1]
    for more in lengths[2:]:
        candidates = candidates.unionByName(more)
    held = candidates.select(F.explode("inside").alias("id"), "n").groupBy("id").agg(F.max("n").alias("longer"))
    scored = _scored(candidates).join(held, "id", "left")
    left = scored.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(19,0)") < contained * F.col("a").cast("decimal(19,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    found = stage(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "collocations")
    unstage(totals, *lengths)
    return found
