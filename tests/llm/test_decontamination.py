import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest

from siftwell.llm import decontamination as D


def split(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[\u3040-\u30ff\u3400-\u9fff]|[0-9a-z\x80-\u303f\u3100-\u33ff\ua000-\U0010ffff]+", low)


def grams(words):
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def edits_to_hold(words, passage):
    """Fewest words to replace, leave out or put in so that the words stand in the passage, by the table of all prefixes."""
    row = [0] * (len(passage) + 1)
    for i, word in enumerate(words, 1):
        above, row = row, [i]
        for j, other in enumerate(passage, 1):
            row.append(min(above[j - 1] + (word != other), above[j] + 1, row[j - 1] + 1))
    return min(row)


def brute_force(docs, items, edit_words=None):
    """Scores every item for every passage; with ``edit_words``, also looks for it with few edits."""
    short = [(i, split(t)) for i, t in items if 0 < len(split(t)) < 5]
    items = [(i, split(t)) for i, t in items if len(split(t)) >= 5]
    df = Counter(t for _, w in items for t in set(w))
    mean = sum(len(w) for _, w in items) / len(items)

    def weight(t, words):
        tf, n = words.count(t), df[t]
        return log(1 + (len(items) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))

    found = set()
    for d, text in docs:
        words = split(text)
        found |= {(d, i) for i, own in short if any(words[k : k + len(own)] == own for k in range(len(words)))}
        for i, own in items:
            step = next(16 << c for c in range(20) if 16 << c >= len(own))
            for k in range(max(1, -(-len(words) // step) - 1)):
                passage = words[k * step : (k + 2) * step]
                total = sum(weight(t, own) for t in set(own))
                score = sum(weight(t, own) for t in set(own) & set(passage)) / total
                tail = max(1, len(own) // 4)
                question, answer = grams(own[:-tail]), grams(own[-max(tail, min(3, len(own))) :])
                seen = grams(passage)
                share = lambda part: len(part & seen) / len(part)
                if score >= 0.6 and share(question) >= 0.6 and share(answer) >= 0.6:
                    found.add((d, i))
                elif edit_words:
                    most = max(1, len(own) // edit_words)
                    wider = words[k * step : (k + 2) * step + most]
                    if len(own) - sum(w in wider for w in own) <= most and edits_to_hold(own, wider) <= most:
                        found.add((d, i))
    return found


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(2, 40)))) for i in range(60)]
    items += [(60, " ".join(rng.choices(vocabulary, k=90))), (61, "東京は日本の首都"), (62, "何処"), (63, "Capital of w1? w2")]
    docs = []
    for d in range(150):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 10, 60, 300]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            own = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).upper() if d % 3 else " ".join(words)))
    docs += [(150, "x 一二三東京は日本の首都です"), (151, "一何処か"), (152, "the capital of w1, w2!"), (153, "capital of w1 or w2"), (154, "何 処")]
    return docs, items


@pytest.mark.parametrize("edit_words", [None, 20, 6])
@pytest.mark.parametrize("index_words, pairs", [(1_000_000, 1 << 17), (150, 50)])
def test_equals_brute_force(spark, monkeypatch, index_words, pairs, edit_words):
    """Whether the benchmark is one index or many, and however long its other items are."""
    monkeypatch.setattr(D, "INDEX_WORDS", index_words)
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", pairs)
    docs, items = corpus()
    got = D.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
        edit_words=edit_words,
    ).collect()
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == brute_force(docs, items, edit_words)
    planted = {(d, i) for d, t in docs for i, own in items if f" {' '.join(split(own))} " in f" {' '.join(split(t))} "}
    assert planted and planted <= {(r.doc_id, x.item_id) for r in got for x in r.leaks}


def test_blocks_bound_their_items():
    docs, items = corpus(5)
    own = [(i, D._words(t)) for i, t in items if len(t.split()) >= 5]
    df = Counter(t for _, w in own for t in set(w.tolist()))
    index = D.ItemIndex.build(own, df, len(own), 20.0, 64)
    term = np.repeat(np.arange(len(index.terms)), np.diff(index.starts))
    assert (index.block_max[term, index.items // index.block_items] >= index.weights).all()
    assert (index.term_max[term] >= index.weights).all()
    assert np.allclose(np.bincount(index.items, index.weights), 1, atol=1e-5)


def test_wand_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    own = [(i, rng.integers(1, 80, rng.integers(5, 30)).astype(np.uint64)) for i in range(300)]
    df = Counter(t for _, w in own for t in set(w.tolist()))
    index = D.ItemIndex.build(own, df, len(own), 17.0, 32)
    term = np.repeat(np.arange(len(index.terms)), np.diff(index.starts))
    some = 0
    for size in (3, 10, 25, 60):
        for _ in range(30):
            asked = np.sort(rng.choice(len(index.terms), size, replace=False))
            score = np.bincount(index.items, index.weights * np.isin(term, asked), minlength=len(own))
            sums = index.block_max[asked].sum(axis=0)
            got = dict(index._wand(asked, np.flatnonzero(sums >= index.block_need - 1e-4)))
            want = set(np.flatnonzero(score >= index.needs + 1e-6).tolist())
            assert want <= set(got) <= set(np.flatnonzero(score >= index.needs - 1e-6).tolist())
            assert all(abs(score[i] - s) < 1e-5 for i, s in got.items())
            some += len(got)
    assert some > 100


def test_one_edit_hides_no_item():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    items = [(n, rng.choices(vocabulary, k=n)) for n in range(D.MIN_ITEM_WORDS, 45)]
    own = [(n, D._words(" ".join(words))) for n, words in items]
    df = Counter(t for _, w in own for t in set(w.tolist()))
    index = D.ItemIndex.build(own, df, len(own), 20.0, 64, D.EDIT_WORDS)
    around = [f"x{i}" for i in range(100)]
    for item, (n, words) in enumerate(items):
        for at in range(n):
            for edited in (words[:at] + ["new"] + words[at + 1 :], words[:at] + words[at + 1 :], words[:at] + ["new"] + words[at:]):
                lead = rng.randrange(100)
                text = " ".join(around[:lead] + edited + around[lead:])
                hashes = D._words(text)
                assert item in index.search(hashes, np.array([len(hashes)]))[0], (n, at)


def test_more_edits_than_allowed_are_none():
    words = D._words(" ".join(f"w{i}" for i in range(12)))
    other = D._words("a b c")
    assert D.within_edits(words, np.concatenate([other, words[:5], other[:1], words[6:], other]), 1)
    assert not D.within_edits(words, np.concatenate([words[:4], other[:2], words[6:]]), 1)
    assert not D.within_edits(words, words[::-1], 1) and not D.within_edits(words, words[:0], 1)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (None, "a text without an id"),
         (3, None), (4, ""), (5, "one")],
        "item_id long, text string",
    )
    got = D.find_leaks(odd_docs, items)
    assert got.columns == odd_docs.columns  # "leaks" is replaced
    found = sorted(((r.doc_id, x.item_id) for r in got.collect() for x in r.leaks), key=repr)
    # an item of one word is reported wherever that word stands
    assert found == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (7, 5), (8, 5), (None, None)]
    kept = D.drop_leaking(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 6
    assert D.find_leaks(no_docs, items).collect() == []
    assert D.drop_leaking(odd_docs, items.where("false")).count() == odd_docs.count()
