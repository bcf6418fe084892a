"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.columns import free_name, only

#: n-grams of up to so many characters; entries of a profile, and of a document's list.
MAX_N = 3
PROFILE_SIZE = 400
#: Code points handled at a time while the n-grams of a text are counted.
PIECE = 1 << 20
#: n-grams of a language held by a task before equal ones are merged.
MERGE_AT = 500_000
UNDETERMINED = "und"
_BITS = np.uint64(21)  # of a code point


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents held out of training: crc32 of the id, as text, is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _letters(text: str) -> str:
    """Lower-cased words, letters only, with one blank in front of, between and behind them."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


_TABLE = {c: chr(c + 32) if 65 <= c <= 90 else chr(c) if 97 <= c <= 122 else " " for c in range(128)}


def _clean(text: str) -> str:
    if text.isascii():
        return " ".join(text.translate(_TABLE).split())
    return _letters(text)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams, by code. Blanks mark the ends of words; a blank alone does not count."""
    total_codes, total_counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    clean = _clean(text) if text else ""
    clean = f" {clean} " if clean else ""
    for start in range(0, len(clean), PIECE):
        # a piece knows the characters in front of it, and only n-grams that end in it are its own
        skip = min(start, MAX_N - 1)
        piece = clean[start - skip : start + PIECE]
        points = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        grams = []
        for n in range(1, MAX_N + 1):
            if len(points) < n:
                break
            code = points[: len(points) - n + 1]
            for i in range(1, n):
                code = (code << _BITS) | points[i : len(points) - n + 1 + i]
            grams.append(code[max(0, skip - n + 1) :])
        codes, counts = np.unique(np.concatenate(grams), return_counts=True)
        if len(total_codes):
            codes, back = np.unique(np.concatenate([total_codes, codes]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([total_counts, counts])).astype(np.int64)
        total_codes, total_counts = codes, counts
    keep = total_codes != np.uint64(32)
    return total_codes[keep], total_counts[keep]


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in the order of their ranks; ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        chosen = counts >= least
        codes, counts = codes[chosen], counts[chosen]
    return codes[np.lexsort((codes, -counts))][:size]


@dataclass
class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray  # (n-gram, language); an n-gram that a profile lacks has the rank ``size``
    size: int

    @classmethod
    def build(cls, ranks: dict[str, list[int]], size: int = PROFILE_SIZE) -> Profiles:
        languages = sorted(ranks)
        lists = [np.array(ranks[x], dtype=np.int64).astype(np.uint64) for x in languages]
        codes = np.unique(np.concatenate([*lists, np.empty(0, np.uint64)]))
        table = np.full((len(codes) + 1, len(languages)), size, dtype=np.int32)
        for column, entries in enumerate(lists):
            table[np.searchsorted(codes, entries), column] = np.arange(len(entries))
        return cls(languages, codes, table, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the smallest out-of-place distance (ties: the first by name) and how near it is, 0 to 1."""
        entries = ranked(*ngram_counts(text), self.size)
        if not len(entries) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, entries)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == entries[known]
        rows = self.ranks[np.where(known, at, len(self.codes))]
        places = np.abs(rows - np.arange(len(entries), dtype=np.int32)[:, None])
        places[rows == self.size] = self.size
        distance = places.sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(entries))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's n-gram counts by language. Counts are merged as they come and handed on when there are too many."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[str, int] = {}

    def frame(lang: str) -> pd.DataFrame:
        codes, counts = _merged(held.pop(lang))
        return pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": counts})

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            found = ngram_counts(text)
            held.setdefault(lang, []).append(found)
            size[lang] = size.get(lang, 0) + len(found[0])
            if size[lang] > MERGE_AT:
                held[lang] = [_merged(held[lang])]
                size[lang] = len(held[lang][0][0])
                if size[lang] > MERGE_AT // 2:
                    yield frame(lang)
                    size[lang] = 0
    for lang in list(held):
        yield frame(lang)


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of all languages named in ``lang``, from all rows with a text and a language.

    Counts are taken over whole texts, combined in every task and summed by Spark. What reaches the driver is ``size``
    entries for each language: the number of languages, not of documents, bounds it.
    """
    rows = only(labelled, lang=lang, text=text).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInPandas(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    ranks: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "rank", "code").collect()):
        ranks.setdefault(row.lang, []).append(row.code)
    return Profiles.build(ranks, size)


def predict_language(docs: DataFrame, profiles: Profiles, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a column ``out``: struct<lang, score>. A column of that name is replaced.

    A text that is null or has no letter is ``und`` with score 0. A repeated row gets the same answer again.
    """

    @F.pandas_udf("struct<lang: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn(out, predict(F.col(text)))


def accept_languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.1
) -> DataFrame:
    """``docs`` without the documents whose language can't be told: no letter, or nearer to nothing than ``min_score``.

    Profiles are learned from the labelled documents outside the held-out fold.
    """
    profiles = learn_profiles(docs.where(~in_fold(F.col(doc_id))), text, lang)
    guess = free_name(docs, "language_guess")
    scored = predict_language(docs, profiles, text, guess)
    known = (F.col(guess)["lang"] != UNDETERMINED) & (F.col(guess)["score"] >= min_score)
    return scored.where(known).drop(guess)


def crc_fold(doc_id) -> bool:
    """``in_fold`` for one id, for tests and single documents."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
