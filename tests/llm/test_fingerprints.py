import hashlib
from collections import Counter

import numpy as np

from siftwell.llm import fingerprints as C


def test_collisions_follow_generalised_jaccard():
    sampler = C.WeightedSampler(4096)
    rng = np.random.default_rng(0)
    for _ in range(6):
        a = {f"t{i}": int(rng.integers(1, 6)) for i in rng.integers(0, 40, 30)}
        b = {f"t{i}": int(rng.integers(1, 6)) for i in rng.integers(0, 40, 30)}
        terms = a.keys() | b.keys()
        want = sum(min(a.get(t, 0), b.get(t, 0)) for t in terms) / sum(max(a.get(t, 0), b.get(t, 0)) for t in terms)
        assert abs(C.likeness(sampler.signature(a), sampler.signature(b)) - want) < 0.035


def test_caches_do_not_matter(monkeypatch):
    texts = [" ".join(f"x{i * j % 97}" for i in range(200)) for j in range(1, 9)]
    want = [C.fingerprint(C.WeightedSampler(), t).tolist() for t in texts]
    monkeypatch.setattr(C, "CACHED_TERMS", 70)
    monkeypatch.setattr(C, "TERMS_AT_ONCE", 13)
    sampler = C.WeightedSampler()
    assert [C.fingerprint(sampler, t).tolist() for t in texts] == want


def brute_force(rows):
    sampler, out = C.WeightedSampler(), []
    rows = [(i, t or "") for i, t in sorted(rows)]
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (sampler.signature(Counter(t.split())) for t in (text, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), sha, C._hex(a), C._hex(b), C.likeness(a, b), C.likeness(a, c)))
    return out


def test_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = [tuple(r) for r in C.fingerprint_neighbours(docs).orderBy("doc_id").collect()]
    assert got == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_few_rows(spark):
    for n in (1, 2, 3):
        rows = [(i, f"text number {i} 😛 " * i) for i in range(n)]
        got = C.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string"))
        assert [tuple(r) for r in got.orderBy("doc_id").collect()] == brute_force(rows)


def test_odd_rows(odd_docs, no_docs):
    got = C.fingerprint_neighbours(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (7, 8)}) == 1
    assert C.fingerprint_neighbours(no_docs).collect() == []
    plain = C.fingerprints(odd_docs, out="lang")
    assert plain.columns == odd_docs.columns
    assert {r.lang for r in plain.collect()} == {r.fingerprint for r in got}
