import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwell.llm import collocations as C


def brute_force(docs, min_count, longest, top, contained):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        kept = []
        for g, a in candidates.items():
            cuts = [(2_000_000 * a // (f[g[:c]] + f[g[c:]]), c) for c in range(1, len(g))]
            score, c = min(cuts)
            holds = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))  # noqa: E731, B023
            if not any(len(h) > len(g) and 100 * b >= contained * a and holds(h) for h, b in candidates.items()):
                kept.append((-score, -a, " ".join(g).encode(), f[g[:c]], f[g[c:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["new", "York", "stock", "exchange", "of", "the", "a", "é", "ÄB", "x", "日本", "of\u00a0x"]
    phrases = ["New York", "new york stock exchange", "the of the", "a a a a", "ÄB é, x", "日本 x! y"]
    marks = [" ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "; ", "\x0b", "?"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(phrases if rng.random() < 0.4 else words) for _ in range(rng.randint(0, 40))]
        texts.append(("".join(p + rng.choice(marks) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    return texts + [(None, "en"), ("", "de"), (" \t ", None)] + [texts[0]] * 5


def rows_of(df):
    assert [c for c, _ in df.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    "seed, min_count, longest, top, contained", [(1, 5, 4, 2000, 80), (2, 2, 3, 10, 50), (3, 3, 6, 50, 100), (4, 30, 2, 5, 80)]
)
def test_equals_brute_force(spark, seed, min_count, longest, top, contained, monkeypatch):
    monkeypatch.setattr(C, "COUNT_BYTES", 700)
    monkeypatch.setattr(C, "COUNT_PLACES", 90)
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    want = brute_force(docs, min_count, longest, top, contained)
    assert want
    assert rows_of(C.collocations(frame, min_count=min_count, longest=longest, top=top, contained=contained)) == want


def test_more_frequent_phrases_than_can_be_sent(spark, monkeypatch):
    monkeypatch.setattr(C, "KEPT_BYTES", 32)  # a bitmap of 256 bits, so many that are not frequent pass
    docs = corpus(5)
    frame = spark.createDataFrame(docs, "text string, lang string")
    assert rows_of(C.collocations(frame, min_count=4)) == brute_force(docs, 4, 4, 2000, 80)


def test_large_counts_are_exact(spark):
    rows = [(1, "en", 9 * 10**18, ["a", "b"], [9 * 10**18, 9 * 10**18], [9 * 10**18, 9 * 10**18])]
    rows.append((2, "en", 7 * 10**18 + 1, ["a", "c"], [9 * 10**18, 1], [7 * 10**18 + 3, 1]))
    frame = spark.createDataFrame(rows, "id long, lang string, n long, words array<string>, heads array<long>, tails array<long>")
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in C._scored(frame).collect()}
    assert got["a b"] == (10**6, 9 * 10**18, 9 * 10**18)
    assert got["a c"][0] == 2_000_000 * (7 * 10**18 + 1) // (16 * 10**18 + 3)


def test_a_long_text_is_one_document(spark):
    text = "alpha beta gamma " * 30_000
    got = rows_of(C.collocations(spark.createDataFrame([(text, "en")], "text string, lang string")))
    # all phrases of one length occur equally often, so those of four words are left
    assert [r[2] for r in got] == ["alpha beta gamma alpha", "beta gamma alpha beta", "gamma alpha beta gamma"]
    assert [r[3] for r in got] == [29_999, 29_999, 29_999] and got[0][6] == 90_000


def test_bitmap_holds_all_ids():
    rng = np.random.default_rng(0)
    ids = rng.integers(-(2**63), 2**63, 500)
    bits = np.zeros(64, dtype=np.uint64)
    at = ids.view(np.uint64) % np.uint64(64 * 64)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    assert C.Kept(bits=bits).holds(ids).all()
    assert 0.05 < C.Kept(bits=bits).holds(rng.integers(-(2**63), 2**63, 5000)).mean() < 0.2
    exact = C.Kept(ids=np.sort(ids))
    assert exact.holds(ids).all() and not exact.holds(ids + 1).any() and not C.Kept(ids=ids[:0]).holds(ids).any()


def test_odd_rows(spark, odd_docs, no_docs):
    want = brute_force([(r["text"], r["lang"]) for r in odd_docs.select("text", "lang").collect()], 2, 4, 2000, 80)
    assert rows_of(C.collocations(odd_docs, min_count=2)) == want
    assert C.collocations(no_docs).collect() == []
    assert C.collocations(odd_docs.where("doc_id = 3")).collect() == []


def test_query_equals_sql(spark, data, tmp_path):
    """Over the smallest tables, with a bar that more phrases reach."""
    from oracle import connect, rows_of as sorted_rows

    from siftwell.llm.queries import collocations_sql, table

    got = C.collocations(table(spark, data, "documents"), min_count=4, top=500).toArrow()
    want = connect(data).sql(collocations_sql(4, 500)).to_arrow_table()
    assert got.num_rows > 300 and sorted_rows(got) == sorted_rows(want)
