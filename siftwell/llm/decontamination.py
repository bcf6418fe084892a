"""Benchmark decontamination: BM25 over an inverted index of test items, pruned by block maxima, then verified."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from siftwell.llm.columns import free_name, only
from siftwell.llm.wordhash import NOT_ALPHANUMERIC, hash_words, mix, shingles, slices, text_bytes
from siftwell.session import stage, unstage

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage has to reach, and of its word triples that both halves have to share.
MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.6, 0.6, 0.6
#: An item is also leaked if the passage holds it with at most one edited word, or one for each so many of its words.
EDIT_WORDS = 20
#: The last part of an item that is taken as its answer.
ANSWER_SHARE = 0.25
#: Items with fewer words are leaked only by all their words in a row.
MIN_ITEM_WORDS = 5
NGRAM = 3
#: Passages are windows of twice so many words, half overlapping, for items of at most so many; doubled for longer items.
SHORTEST_STEP = 16
#: Words in one index that is sent to the tasks, or one item; a larger benchmark is searched in several.
INDEX_WORDS = 1_000_000
#: Most blocks of an index, and the fewest items in one.
BLOCKS, BLOCK_ITEMS = 64, 8
#: (passage, term) pairs whose bounds are summed at a time.
PAIRS_AT_ONCE = 1 << 17

LEAKS = "array<struct<item_id: {}, score: double, question: double, answer: double>>"


#: Scripts that put no blanks between words: Thai, Lao, Burmese, Khmer, kana and Han. Each character is a word of its own.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_MAY_BE_UNSPACED = re.compile(b"[\xe0\xe1\xe3-\xe9\xef\xf0]")


def spaced(text: bytes) -> bytes:
    """The text with blanks around every character that is a word of its own."""
    if not _MAY_BE_UNSPACED.search(text):
        return text
    return _UNSPACED.sub(r" \1 ", text.decode()).encode()


def _words(text: str) -> np.ndarray:
    return hash_words([spaced(text.encode())], NOT_ALPHANUMERIC)[0]


def step_for(n_words: int) -> int:
    """Half the width of the passages that are searched for an item: it depends on the item's own length alone."""
    step = SHORTEST_STEP
    while step < n_words:
        step *= 2
    return step


def _edits(n_words: int, edit_words: int | None) -> int:
    """Words of an item that may be replaced, left out or put in."""
    return max(1, n_words // edit_words) if edit_words else 0


def within_edits(words: np.ndarray, passage: np.ndarray, most: int) -> bool:
    """Whether the passage holds the words, in their order, with at most ``most`` edits."""
    if np.isin(words, passage).sum() < len(words) - most:
        return False
    place = np.arange(len(passage) + 1)
    row = np.zeros(len(place), np.int64)  # the run may begin anywhere
    for word in words:
        step = np.minimum(row + 1, np.append(row[0] + 1, row[:-1] + (passage != word)))
        row = np.minimum.accumulate(step - place) + place
        if row.min() > most:
            return False
    return True


Found = dict[int, tuple[float, float, float]]


@dataclass
class PhraseIndex:
    """Short items, by the hash of all their words in a row."""

    item_ids: list
    phrases: dict[int, tuple[np.ndarray, list[list[int]]]]  # by number of words: sorted hashes, items of each

    @classmethod
    def build(cls, items: list[tuple[object, np.ndarray]]) -> PhraseIndex:
        by_length: dict[int, dict[int, list[int]]] = {}
        for i, (_, words) in enumerate(items):
            by_length.setdefault(len(words), {}).setdefault(int(_runs(words, len(words))[0]), []).append(i)
        phrases = {}
        for n, found in by_length.items():
            hashes = sorted(found)
            phrases[n] = np.array(hashes, dtype=np.uint64), [found[h] for h in hashes]
        return cls([x for x, _ in items], phrases)

    def search(self, hashes: np.ndarray, counts: np.ndarray) -> list[Found]:
        out: list[Found] = [{} for _ in counts]
        ends = np.cumsum(counts)
        for n, (known, items) in self.phrases.items():
            if len(hashes) < n:
                continue
            run = _runs(hashes, n)
            at = np.searchsorted(known, run)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == run)
            text = np.searchsorted(ends, hit, side="right")
            inside = hit + n <= ends[text]
            for t, k in zip(text[inside].tolist(), at[hit[inside]].tolist()):
                for item in items[k]:
                    out[t][item] = (1.0, 1.0, 1.0)
        return out


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    value = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        value = mix(value + words[i : len(words) - n + 1 + i])
    return value


@dataclass
class ItemIndex:
    """Inverted lists of items, each weight being the share of the item's own BM25 score that the term brings."""

    item_ids: list
    words: list[np.ndarray]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    step: int
    terms: np.ndarray
    starts: np.ndarray  # by term: its postings are items[starts[t] : starts[t + 1]], in the order of the items
    items: np.ndarray
    weights: np.ndarray
    term_max: np.ndarray
    block_max: np.ndarray  # (term, block): the largest weight in the block
    block_items: int
    needs: np.ndarray  # by item: the score that an occurrence within the allowed edits keeps, at most MIN_SCORE
    block_need: np.ndarray
    edits: list[int]

    @classmethod
    def build(
        cls, items: list[tuple[object, np.ndarray]], df: dict[int, int], n_items: int, mean_length: float, step: int,
        edit_words: int | None = None,
    ) -> ItemIndex:
        terms = np.unique(np.concatenate([w for _, w in items]))
        size = max(BLOCK_ITEMS, -(-len(items) // BLOCKS))
        block_max = np.zeros((len(terms), -(-len(items) // size)), np.float32)
        postings, questions, answers, needs = [], [], [], []
        edits = [_edits(len(words), edit_words) for _, words in items]
        for i, (_, words) in enumerate(items):
            own, tf = np.unique(words, return_counts=True)
            n = np.array([df[t] for t in own.tolist()])
            idf = np.log(1 + (n_items - n + 0.5) / (n + 0.5))
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            weight = (weight / weight.sum()).astype(np.float32)
            kept = 1 - np.sort(weight)[len(weight) - edits[i] :].sum() - 1e-4
            needs.append(min(MIN_SCORE, kept))
            at = np.searchsorted(terms, own)
            block_max[at, i // size] = np.maximum(block_max[at, i // size], weight)
            postings.append((at, np.full(len(at), i), weight))
            tail = max(1, int(len(words) * ANSWER_SHARE))
            questions.append(shingles(words[:-tail], NGRAM))
            answers.append(shingles(words[-max(tail, min(NGRAM, len(words))) :], NGRAM))
        term, item, weight = (np.concatenate(column) for column in zip(*postings))
        order = np.argsort(term, kind="stable")
        need = np.array(needs)
        return cls(
            [x for x, _ in items], [w for _, w in items], questions, answers, step, terms,
            np.searchsorted(term[order], np.arange(len(terms) + 1)), item[order], weight[order], block_max.max(axis=1),
            block_max, size, need, np.minimum.reduceat(need, np.arange(0, len(items), size)), edits,
        )

    def search(self, hashes: np.ndarray, counts: np.ndarray) -> list[Found]:
        """For each text, the items that a passage of it leaks: item -> (score, question, answer), the best passage counts.

        Passages are windows of twice the step, half overlapping, so each occurrence lies in one as a whole.
        """
        out: list[Found] = [{} for _ in counts]
        step = self.step
        begins = np.concatenate([[0], np.cumsum(counts)])
        windows = np.maximum(1, -(-counts // step) - 1)
        first_window = np.concatenate([[0], np.cumsum(windows)])
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[at] == hashes)
        if not len(hit):
            return out
        text = np.searchsorted(begins, hit, side="right") - 1
        part = (hit - begins[text]) // step
        window = first_window[text] + np.minimum(part, windows[text] - 1)
        twice = part > 0
        key = np.concatenate([window, first_window[text[twice]] + part[twice] - 1]) * len(self.terms)
        key = np.unique(key + np.concatenate([at[hit], at[hit[twice]]]))
        window, term = key // len(self.terms), key % len(self.terms)
        start = 0
        while start < len(window):
            end = min(start + PAIRS_AT_ONCE, len(window))
            if end < len(window):  # not inside a window
                cut = np.searchsorted(window, window[end - 1])
                end = cut if cut > start else int(np.searchsorted(window, window[end - 1], side="right"))
            for w, terms, blocks in self._pivots(window[start:end], term[start:end]):
                i = int(np.searchsorted(first_window, w, side="right") - 1)
                lo = begins[i] + (w - first_window[i]) * step
                passage = None
                for item, score in self._wand(terms, blocks):
                    if passage is None:
                        passage = shingles(hashes[lo : min(lo + 2 * step, begins[i + 1])], NGRAM)
                    question = float(np.isin(self.questions[item], passage).mean())
                    answer = float(np.isin(self.answers[item], passage).mean())
                    alike = score >= MIN_SCORE and question >= MIN_QUESTION and answer >= MIN_ANSWER
                    most = self.edits[item]  # words put in may reach over the end of the window
                    if not alike and most:
                        alike = within_edits(self.words[item], hashes[lo : min(lo + 2 * step + most, begins[i + 1])], most)
                    if alike:
                        out[i][item] = max(out[i].get(item, (0.0, 0.0, 0.0)), (score, question, answer))
            start = end
        return out

    def _pivots(self, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Passages with an item that could reach the threshold, and which blocks it may be in; for all passages at once.

        The terms' largest weights rule out most passages, the block maxima then most blocks of the others.
        """
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        last = np.append(first[1:], len(window))
        able = np.add.reduceat(self.term_max[term], first) >= self.block_need.min() - 1e-4
        if not able.any():
            return
        first, last = first[able], last[able]
        own = np.repeat(able, np.diff(np.append(np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])), len(window))))
        window, term = window[own], term[own]
        size = last - first
        first = np.cumsum(size) - size
        reaching = np.add.reduceat(self.block_max[term], first, axis=0) >= self.block_need - 1e-4
        for k in np.flatnonzero(reaching.any(axis=1)):
            yield int(window[first[k]]), term[first[k] : first[k] + size[k]], np.flatnonzero(reaching[k])

    def _wand(self, terms: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, float]]:
        """(item, score) of all items that reach their threshold, by block-max WAND.

        Every term has a cursor in its list, which is in the order of the items. The pivot is the first item at which the
        largest weights of the cursors up to it add up to the threshold: no earlier item can reach it. If the pivot lies in a
        block that its maxima rule out, the cursors go to the next block that is left; if all of them stand on the pivot,
        it is scored; else those behind it are moved up to it.
        """
        need = float(self.block_need.min()) - 1e-4
        left = blocks.tolist()
        cursors = []  # [item, position, items, weights, largest weight]
        for t in terms.tolist():
            a, b = self.starts[t], self.starts[t + 1]
            items = self.items[a:b].tolist()
            cursors.append([items[0], 0, items, self.weights[a:b], float(self.term_max[t])])

        def move(cursor: list, item: int) -> None:
            cursor[1] = at = bisect_left(cursor[2], item, cursor[1])
            cursor[0] = cursor[2][at] if at < len(cursor[2]) else -1

        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for cursor in cursors:
                bound += cursor[4]
                if bound >= need:
                    pivot = cursor[0]
                    break
            if pivot < 0:
                return
            block = pivot // self.block_items
            while left and left[0] < block:
                left.pop(0)
            if not left:
                return
            target = max(pivot, left[0] * self.block_items)
            if target == pivot == cursors[0][0]:
                here = [c for c in cursors if c[0] == pivot]
                score = float(sum(c[3][c[1]] for c in here))
                if score >= self.needs[pivot]:
                    yield pivot, score
                target += 1
            for cursor in cursors:
                if cursor[0] >= target:
                    break
                move(cursor, target)
            cursors = [c for c in cursors if c[0] >= 0]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [hash_words([spaced(t)], NOT_ALPHANUMERIC)[0].view(np.int64) for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])


def build_indexes(
    benchmark: DataFrame, item_id: str = "item_id", text: str = "text", edit_words: int | None = None
) -> list[ItemIndex | PhraseIndex]:
    """Indexes of all items: short ones by their phrase, the others by the width of their passages, ``INDEX_WORDS`` in each.

    Words, document frequencies and lengths are taken on the executors. The driver sees the items, a stated query set, one
    by one, with the frequencies of their words; what it holds and sends at a time is an index, bounded by its words.
    """
    kind = benchmark.schema[item_id].dataType.simpleString()
    rows = only(benchmark, item_id=item_id, text=text).where("text IS NOT NULL").distinct()
    items = stage(rows.mapInArrow(_item_words, f"item_id {kind}, words array<long>").where("size(words) > 0"), "items")
    scored = items.where(F.size("words") >= MIN_ITEM_WORDS)
    sizes = scored.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    df = scored.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    known = scored.select("item_id", "words", F.explode(F.array_distinct("words")).alias("term")).join(df, "term")
    known = known.groupBy("item_id", "words").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("df"))
    short = items.where(F.size("words") < MIN_ITEM_WORDS).select("item_id", "words", F.lit(None).cast("map<bigint,bigint>").alias("df"))
    steps = F.array(*(F.lit(SHORTEST_STEP << i) for i in range(24)))
    step = F.when(F.col("df").isNotNull(), F.array_min(F.filter(steps, lambda s: s >= F.size("words")))).otherwise(0)
    found: list[ItemIndex | PhraseIndex] = []
    held: list[tuple[object, np.ndarray]] = []
    counts: dict[int, int] = {}

    def close(step: int) -> None:
        if held and step:
            found.append(ItemIndex.build(held, counts, sizes["n"], sizes["mean"], step, edit_words))
        elif held:
            found.append(PhraseIndex.build(held))
        held.clear()
        counts.clear()

    at = None
    for row in known.unionByName(short).withColumn("step", step).orderBy("step", "item_id", "words").toLocalIterator():
        if row["step"] != at or sum(len(w) for _, w in held) + len(row["words"]) > INDEX_WORDS:
            close(at)
        at = row["step"]
        held.append((row["item_id"], np.array(row["words"], dtype=np.int64).view(np.uint64)))
        counts.update({t % (1 << 64): n for t, n in (row["df"] or {}).items()})
    close(at)
    unstage(items)
    return found


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    out: str = "leaks", edit_words: int | None = None,
) -> DataFrame:
    """``docs`` with ``out``: an array of (item_id, score, question, answer), one entry per leaked benchmark item.

    Words are runs of digits, letters and wide characters with A-Z lower-cased; in scripts without blanks each character is
    a word. Every passage of every text, read whole however long it is, is a query against the index of the items. An item
    is retrieved if the passage reaches ``MIN_SCORE`` of the BM25 score that the item itself would have, and reported if at
    least ``MIN_QUESTION`` and ``MIN_ANSWER`` of the word triples of its question (the front) and of its answer (the last
    quarter) occur in the passage as well. With ``edit_words`` it is also reported if the passage holds it with at most one
    word replaced, left out or put in, or one for each ``edit_words`` of its words; such an occurrence is always retrieved.
    An item of fewer than ``MIN_ITEM_WORDS`` words is reported where all its words stand in a row. Passages are as wide as
    the item's own length asks for, so no other item, nor the size of an index, changes what is found.

    Items of the same text are all reported, repeated rows of the benchmark once; items without a word are none. A null,
    empty or wordless text leaks nothing; an empty benchmark finds nothing and an empty table of documents stays empty;
    repeated documents are judged alike; a column named ``out`` is replaced, others stay. No document is shuffled.
    """
    kind = LEAKS.format(benchmark.schema[item_id].dataType.simpleString())
    spark = docs.sparkSession
    indexes = [spark.sparkContext.broadcast(index) for index in build_indexes(benchmark, item_id, item_text, edit_words)]
    empty = F.from_json(F.lit("[]"), kind)
    if not indexes:
        return docs.withColumn(out, empty)
    entry = _entry_type(benchmark, item_id)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts, rows = [spaced(t) for t in text_bytes(column)], []
            for start, end in slices(list(map(len, texts))):
                words = hash_words(texts[start:end], NOT_ALPHANUMERIC)
                leaks: list[list[dict]] = [[] for _ in range(end - start)]
                for index in indexes:
                    for own, found in zip(leaks, index.value.search(*words)):
                        own += [
                            {"item_id": index.value.item_ids[i], "score": s, "question": q, "answer": a}
                            for i, (s, q, a) in sorted(found.items())
                        ]
                rows += leaks
            yield pa.array(rows, pa.list_(entry))

    find = arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return docs.withColumn(out, find(F.col(f"`{text}`")))


def _entry_type(benchmark: DataFrame, item_id: str) -> pa.DataType:
    kind = to_arrow_type(benchmark.schema[item_id].dataType)
    return pa.struct([("item_id", kind), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that leak a benchmark item; all others, and all columns, stay.

    Judged by ``find_leaks`` with one edited word in ``EDIT_WORDS``: whole texts however long; null, empty and wordless texts
    stay, of repeated rows all stay or all go, an empty benchmark drops nothing, and columns may have any names.
    """
    leaks = free_name(docs, "benchmark_leaks")
    return find_leaks(docs, benchmark, text, out=leaks, edit_words=EDIT_WORDS).where(F.size(leaks) == 0).drop(leaks)
