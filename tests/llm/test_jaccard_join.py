import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import jaccard_join as J
from siftwell.llm import near_sets as N


def brute_force(docs, size, percent):
    sets = {}
    for i, text in docs:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {(i, len(sets[i]), root(i)) for i in ids}


def corpus(seed=0, bases=25, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.choice([2, 5, 12, 40, 120]))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words[: rng.choice([None, None, -1])]) + (" " + shared if rng.random() < 0.3 else ""))
    return list(enumerate(texts + ["", None, "  ", "X", "x"]))


def near_threshold(families, copies, edits, seed=1):
    """Chains of near copies around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        words = rng.choices(vocabulary, k=60)
        for _ in range(copies):
            words = list(words)
            for _ in range(rng.choice(edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


def small_pieces(monkeypatch):
    """Pieces of a few texts, rows of a few nodes, and every block searched in parts."""
    monkeypatch.setattr(N, "COMBINE_BYTES", 2000)
    monkeypatch.setattr(N, "LIST_NODES", 3)
    monkeypatch.setattr(N, "INDEX_SHINGLES", 300)
    monkeypatch.setattr(N, "PROBE_SHINGLES", 500)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_equals_brute_force(spark, size, percent, monkeypatch):
    small_pieces(monkeypatch)
    docs = corpus(size)
    got = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words=size, percent=percent)
    assert {tuple(r) for r in got.collect()} == brute_force(docs, size, percent)


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_around_the_threshold(spark, monkeypatch, small):
    """A thousand texts in chains: most links are between members that don't link with the head of their block."""
    if small:
        small_pieces(monkeypatch)
    docs = near_threshold(4, 250, [0, 1, 2])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = J.jaccard_components(frame, words=3, percent=90)
    assert {tuple(r) for r in got.collect()} == brute_force(docs, 3, 90)


def test_joins_shuffle_what_is_too_large_to_send(spark, monkeypatch):
    from siftwell.llm import columns

    monkeypatch.setattr(columns, "BROADCAST_BYTES", 0)
    docs = corpus(4, 8, 9)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in J.jaccard_components(frame, words=3, percent=80).collect()} == brute_force(docs, 3, 80)
    kept = {r["doc_id"] for r in J.keep_one_per_component(frame, words=3, percent=80).collect()}
    assert kept == {c for _, _, c in brute_force(docs, 3, 80)}


def test_tasks_hold_few_texts_at_a_time(spark, monkeypatch):
    """Batches of whole texts end at some bytes, not only at a number of rows, and the session keeps its own setting."""
    from siftwell import session

    monkeypatch.setattr(session, "BATCH_BYTES", 2000)
    before = spark.conf.get(session.ARROW_BATCH)

    def sign(sets, percent):
        assert len(sets) <= 20, "too many texts at a time"
        return J.T_OCCURRENCE.sign(sets, percent)

    docs = [(i, f"{i} " + "word " * 40) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows, _ = N.similar_sets(frame, N.Method(sign, J.T_OCCURRENCE.search), 3, 90)
    assert rows.count() == 200 and spark.conf.get(session.ARROW_BATCH) == before


def test_a_block_is_searched_until_all_is_connected(monkeypatch):
    """Members known to be connected are not compared again."""
    sets = [np.arange(i, i + 40).astype(np.uint64) for i in range(12)]
    asked = []

    def search(sets, indexed, percent):
        found = J.T_OCCURRENCE.search(sets, indexed, percent)
        return lambda i: (asked.append(i), found(i))[1]

    method = N.Method(J.T_OCCURRENCE.sign, search)
    links = N.search_block(sets, [b"x"] * 10 + [b"y", b"z"], [10, 11], list(range(12)), method, 90)
    assert len(links) == 2 and len(asked) < 12
    assert N.search_block(sets, [b"x"] * 12, [10, 11], list(range(12)), method, 90) == []


@pytest.mark.parametrize("list_nodes", [1, 2, 64])
def test_everybody_under_a_signature_is_tied_to_the_smallest(monkeypatch, list_nodes):
    monkeypatch.setattr(N, "LIST_NODES", list_nodes)
    rng = np.random.default_rng(2)
    pieces = [[(rng.integers(0, 9, 4), int(n)) for n in rng.integers(0, 30, 12)] for _ in range(5)]
    rows = pa.Table.from_batches(
        [N.combined(np.concatenate([k for k, _ in piece]), np.repeat([n for _, n in piece], 4)) for piece in pieces]
    )
    batches = rows.sort_by([("key", "ascending"), ("node", "ascending")]).combine_chunks().to_batches(max_chunksize=3)
    got = {(r["node"], r["head"]) for b in N.tie(iter(batches)) for r in b.to_pylist()}
    under = {}
    for keys, node in (pair for piece in pieces for pair in piece):
        for key in keys.tolist():
            under.setdefault(key, set()).add(node)
    assert got == {(n, min(nodes)) for nodes in under.values() for n in nodes if n != min(nodes)}


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(0)
    for percent in (50, 80, 90):
        for n in [*range(2, 40), 100, 333]:
            for _ in range(20):
                pool = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
                a = np.unique(pool[:n])
                change = rng.integers(1, max(2, n * (100 - percent) // 100 + 1))
                b = np.unique(np.concatenate([a[change:], pool[n : n + rng.integers(0, change + 1)]]))
                if N.links_up(len(np.intersect1d(a, b)), len(a), len(b), percent) and len(np.setxor1d(a, b)):
                    assert np.intersect1d(J.signatures(a, percent), J.signatures(b, percent)).size


@pytest.mark.parametrize("weight", [0.0001, 0.05, 100])
def test_divided_lists_find_what_a_scan_finds(monkeypatch, weight):
    monkeypatch.setattr(J, "PROBE_WEIGHT", weight)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(80)]
    indexed = [i for i in range(80) if i % 3]
    index = J.InvertedLists(sets, indexed, 60)
    for s in sets:
        want = [i for i in indexed if N.links_up(len(np.intersect1d(s, sets[i])), len(s), len(sets[i]), 60)]
        assert list(index.search(s)) == want


def test_odd_rows(odd_docs, no_docs):
    got = J.jaccard_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by_id[(2, 4)] == 1 and by_id[(8, 1)] == 7 and by_id[(5, 0)] == 5 and by_id[(6, 2)] == 6
    assert J.jaccard_components(no_docs).collect() == []
    kept = J.keep_one_per_component(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == ["1", "2", "3", "4", "5", "6", "7", "9", "None"]
    assert J.keep_one_per_component(no_docs).collect() == []
