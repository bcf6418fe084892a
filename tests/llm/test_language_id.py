from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import language_id as L
from siftwell.llm.queries import QUERIES


def grams(text):
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    counts = Counter(clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1))
    return {g: c for g, c in counts.items() if g.strip()}


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_counts_equal_a_plain_count(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    for text in ["The cat sat.", "a", "Été  naïve\tÖl 12 x1y", "😛 wide 中文字 text", "aaaa aaaa aaa"]:
        codes, counts = L.ngram_counts(text)
        assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in grams(text).items()}


def test_distance_equals_a_plain_sum():
    texts = {"x": "the cat and the hat and the mat", "y": "der hut und die katze und das bett", "z": "zzz"}
    ranks = {k: L.ranked(*L.ngram_counts(t), 20).astype(np.int64).tolist() for k, t in texts.items()}
    profiles = L.Profiles.build(ranks, 20)
    for text in ["the bat", "das und", "zz", "q", "cat und hat"]:
        order = sorted(grams(text).items(), key=lambda g: (-g[1], code(g[0])))[:20]
        distance = {
            k: sum(abs(own.index(code(g)) - i) if code(g) in own else 20 for i, (g, _) in enumerate(order))
            for k, own in ranks.items()
        }
        best = min(sorted(distance), key=distance.get)
        assert profiles.predict(text) == (best, 1 - distance[best] / (20 * len(order)))


def test_held_out_accuracy_and_fold(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_language_id"](spark, data).join(docs, "doc_id").toPandas()
    assert len(got) == docs.count()
    assert [L.crc_fold(i) for i in got.doc_id] == got.held_out.tolist()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_counts_handed_on_early_give_the_same_profiles(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    want = L.learn_profiles(docs)
    monkeypatch.setattr(L, "MERGE_AT", 50)
    got = L.learn_profiles(docs)
    assert (got.ranks == want.ranks).all() and (got.codes == want.codes).all()


def test_odd_rows(odd_docs, no_docs):
    profiles = L.learn_profiles(odd_docs)
    assert profiles.languages == ["x", "y"]
    got = L.predict_language(odd_docs, profiles, out="score")
    assert got.columns == odd_docs.columns
    und = {r.doc_id for r in got.collect() if r.score.lang == "und"}
    assert und == {3, 4, 5}
    kept = L.accept_languages(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where(F.col("doc_id").isin(3, 4, 5)).count() == 0
    assert L.accept_languages(no_docs).collect() == []
    none = L.predict_language(odd_docs, L.learn_profiles(no_docs))
    assert {tuple(r.language) for r in none.collect()} == {("und", 0.0)}
