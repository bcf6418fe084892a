"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.columns import only
from siftwell.llm.ordering import in_order
from siftwell.llm.wordhash import mix

SAMPLES = 64
#: Terms whose draws a task remembers, and terms of one text that are sampled at a time.
CACHED_TERMS = 1 << 16
TERMS_AT_ONCE = 1 << 13


class WeightedSampler:
    """Signatures of weighted term sets: two signatures agree in a place with the probability that is their generalised
    Jaccard similarity, the sum of the smaller weights over the sum of the larger.

    For each term and place, r and c are drawn from Gamma(2, 1) and b from the unit interval, all from the term's hash.
    With t = floor(ln w / r + b), the term with the smallest ln c - r (t - b) - r is the sample, together with its t.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 1):
        self.samples = samples
        self.streams = mix(np.arange(1, 5 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.hash = np.empty(CACHED_TERMS, np.uint64)
        self.r, self.b, self.one = (np.empty((CACHED_TERMS, self.samples), np.float32) for _ in range(3))

    def _draw(self, terms: list[str]) -> None:
        start = len(self.known)
        for lo in range(0, len(terms), 1024):
            some = terms[lo : lo + 1024]
            h = np.array([xxhash.xxh64_intdigest(t.encode()) for t in some], dtype=np.uint64)
            u = ((mix(h[:, None] + self.streams) >> np.uint64(11)) + 0.5) * 2.0**-53
            u = u.reshape(len(some), 5, self.samples)
            r, c, b = -np.log(u[:, 0] * u[:, 1]), -np.log(u[:, 2] * u[:, 3]), u[:, 4]
            at = slice(start + lo, start + lo + len(some))
            self.hash[at], self.r[at], self.b[at] = h, r, b
            self.one[at] = np.log(c) + r * b - r  # of weight 1, where t is 0
        self.known.update(zip(terms, range(start, start + len(terms))))

    def signature(self, weights: dict[str, int]) -> np.ndarray:
        """16 bits for each place; no place at all if there is no term."""
        best = np.full(self.samples, np.inf, np.float32)
        code = np.zeros(self.samples, np.uint64)
        terms, counts = list(weights), np.fromiter(weights.values(), dtype=np.int64, count=len(weights))
        for lo in range(0, len(terms), TERMS_AT_ONCE):
            some = terms[lo : lo + TERMS_AT_ONCE]
            new = [t for t in some if t not in self.known]
            if len(self.known) + len(new) > CACHED_TERMS:
                self._clear()
                new = some
            self._draw(new)
            row = np.fromiter(map(self.known.__getitem__, some), dtype=np.int64, count=len(some))
            value, step = self.one[row], np.zeros((len(some), self.samples), np.int16)
            heavy = np.flatnonzero(counts[lo : lo + len(some)] > 1)
            if len(heavy):
                r = self.r[row[heavy]]
                t = np.floor(np.log(counts[lo + heavy]).astype(np.float32)[:, None] / r + self.b[row[heavy]])
                value[heavy] -= r * t
                step[heavy] = np.clip(t, -32768, 32767)
            chosen = value.argmin(axis=0)
            places = np.arange(self.samples)
            smaller = value[chosen, places] < best
            best = np.where(smaller, value[chosen, places], best)
            found = mix(self.hash[row[chosen]] + mix(step[chosen, places].astype(np.uint64) + self.streams[: self.samples]))
            code = np.where(smaller, found, code)
        return (code & np.uint64(0xFFFF)).astype(np.uint16) if terms else np.empty(0, np.uint16)


def fingerprint(sampler: WeightedSampler, text: str) -> np.ndarray:
    """Signature of a text: its terms are what white space separates, weighted by how often they occur."""
    return sampler.signature(Counter(text.split()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the places in which two signatures agree; two without places are alike."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text as a hex string in ``out`` (replaced if there).

    A null, empty or blank text has no terms and the empty fingerprint; equal texts have equal fingerprints.
    """

    def sign(batches: Iterator) -> Iterator:
        sampler = WeightedSampler()
        for texts in batches:
            yield texts.map(lambda t: _hex(fingerprint(sampler, t or "")))

    # the annotation that tells Spark which kind of function this is
    import pandas as pd

    sign.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(sign, "string")(F.col(text)))


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = WeightedSampler()
    waiting = None  # a row, until the next one is known
    for batch in batches:
        done = []
        for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
            text = text or ""
            signature = fingerprint(sampler, text)
            if waiting:
                own_id, own, own_signature = waiting
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                edited_signature = fingerprint(sampler, edited)
                done.append(
                    (
                        own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), _hex(own_signature),
                        _hex(edited_signature), likeness(own_signature, edited_signature), likeness(own_signature, signature),
                    )
                )
            waiting = None if guest else (doc_id, text, signature)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in done], kind) for i, kind in enumerate([batch.schema.field("doc_id").type, *_KINDS])],
            names=["doc_id", *_NAMES],
        )


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprint_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and how alike they and the next document are.

    The edited form has its last floor(n/2) code points replaced by as many (or all) of the first of the next document
    in ascending order of ids; after the last comes the first, and an only document follows itself. A null id comes
    before all others; rows of equal ids are ordered by a hash of their texts. A null text counts as empty. An empty
    table gives an empty one; other columns are left out.

    Texts are shuffled once, in the order of ids; each partition also gets the first row of the next one.
    """
    rows = only(docs, doc_id=doc_id, text=text).withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string"
    return (
        in_order(rows, "doc_id", "tie", first_of_next=True)
        .select("doc_id", "text", "guest")
        .mapInArrow(_pair_up, f"{schema}, near_edited double, near_next double")
    )
