import numpy as np
import pytest
from test_jaccard_join import brute_force, corpus, near_threshold, small_pieces

from siftwell.llm import minhash_dedup as M
from siftwell.llm import near_sets as N


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, size, percent, small, monkeypatch):
    if small:
        small_pieces(monkeypatch)
    docs = corpus(size)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = M.near_duplicates(frame, words=size, percent=percent).collect()
    assert {tuple(r)[:3] for r in got} == brute_force(docs, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_copies_around_the_threshold(spark, monkeypatch):
    small_pieces(monkeypatch)
    docs = near_threshold(4, 200, [0, 1, 2])
    got = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), words=3, percent=85)
    want = brute_force(docs, 3, 85)
    differ = {tuple(r)[:3] for r in got.collect()} ^ want
    assert len(differ) <= len(want) * 0.01  # links at the threshold that no table has


def test_minhashes_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.85):
        agreed, n = 0, 0
        for _ in range(40):
            pool = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
            rng.shuffle(pool)
            both = int(400 * share)
            a, b = np.sort(pool[: (400 + both) // 2]), np.sort(pool[(400 - both) // 2 : 400])
            found = M.minhashes([a, b], 66)
            agreed += (found[0] == found[1]).sum()
            n += 66
        assert abs(agreed / n - both / 400) < 0.03


def test_share_of_links_at_the_threshold_that_meet():
    rng = np.random.default_rng(3)
    met, n = 0, 1500
    for _ in range(n):
        pool = rng.integers(0, 2**64, 120, dtype=np.uint64)
        a, b = np.unique(pool[:111]), np.unique(pool[9:])  # 102 of 120 in both: 85 %
        keys, counts = M._table_keys([a, b], 85)
        assert counts.tolist() == [M.collection_size(85) ** 2] * 2
        met += len(np.intersect1d(*np.split(keys, 2))) > 0
    assert met >= n * (1 - M.MISSED) - 3


def test_search_finds_what_links():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in range(0, 40, 2)]
    indexed = list(range(0, 20, 2))
    found = M._confirmed(sets, indexed, 85)
    for i in range(20):
        want = [j for j in indexed if N.links_up(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)]
        assert list(found(i)) == want


def test_odd_rows(odd_docs, no_docs):
    got = M.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    assert by_id[(2, 4)] == (1, False) and by_id[(8, 1)] == (7, False) and by_id[(5, 0)] == (5, True)
    assert by_id[(6, 2)] == (6, True) and by_id[(1, 4)] == (1, True) and by_id[(3, 0)] == (3, True)
    assert M.near_duplicates(no_docs).collect() == []
    kept = M.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "9", "None"]
    assert M.drop_near_duplicates(no_docs).collect() == []
