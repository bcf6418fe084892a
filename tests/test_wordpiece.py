import random
from collections import Counter

import numpy as np
import pytest

from siftwell.operators import wordpiece as W
from siftwell.operators import wordpiece_training as T
from siftwell.sources.sinks import sink_vocab
from siftwell.sources.text_lines import scan_vocab
from siftwell.session import new_path


def one_by_one(words, size, minimum, specials):
    """Merging one pair at a time, recounting everything: the definition."""
    split = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in words}
    alphabet = sorted({c for w in words for c in w})
    inner = sorted({s for parts in split.values() for s in parts[1:]})
    vocab = list(dict.fromkeys([*specials, *alphabet, *inner]))
    while len(vocab) < size:
        pairs = Counter()
        for word, n in words.items():
            for pair in zip(split[word], split[word][1:]):
                pairs[pair] += n
        best = min(pairs.items(), key=lambda p: (-p[1], p[0]), default=None)
        if best is None or best[1] < minimum:
            break
        (a, b), _ = best
        token = a + b[2:]
        if token not in vocab:
            vocab.append(token)
        for word, parts in split.items():
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [a, b]:
                    out.append(token)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            split[word] = out
    return vocab


def tokens_of(vocab):
    return [r["token"] for r in vocab.orderBy("id").collect()]


def words_frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, freq long")


def random_words(seed, letters, count):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.randint(1, 40) for _ in range(count)}


TIES = [(1, "ab", 30), (2, "abcde", 40), (3, "aaab", 25), (4, "가나다ab", 45), (5, "abcdefgh", 400), (6, "abc", 400)]


@pytest.mark.parametrize("seed, letters, size", TIES)
def test_exact_training_equals_merging_one_by_one(spark, seed, letters, size):
    words = random_words(seed, letters, 120)
    expected = one_by_one(words, size, 3, W.SPECIAL_TOKENS)
    assert tokens_of(W.train_wordpiece(words_frame(spark, words), size, 3)) == expected


@pytest.mark.parametrize("pairs, runs", [(16, 50_000), (32, 12)])
def test_rounds_of_any_size_learn_the_same(spark, monkeypatch, pairs, runs):
    """Most counts tie; rounds look at few pairs, may be sent few runs, or none at all."""
    monkeypatch.setattr(T, "ROUND_PAIRS", pairs)
    monkeypatch.setattr(T, "ROUND_RUNS", runs)
    words = {w: 3 + n % 2 for w, n in random_words(7, "abcd", 60).items()}
    assert tokens_of(W.train_wordpiece(words_frame(spark, words), 60, 3)) == one_by_one(words, 60, 3, W.SPECIAL_TOKENS)


def in_process(words, size, pairs, runs, minimum=3, specials=()):
    """The rounds of the training on plain Python lists; returns the vocabulary, the rounds and how often an entry was made anew."""
    state = [([c if i == 0 else "##" + c for i, c in enumerate(w)], n) for w, n in words.items()]
    inner = sorted({s for symbols, _ in state for s in symbols[1:]})
    vocab = list(dict.fromkeys([*specials, *sorted({c for w in words for c in w}), *inner]))
    rounds = again = 0
    n_pairs = pairs

    def collected(chosen, whole):
        found = Counter()
        for symbols, n in state:
            for run in T.runs_of(symbols, frozenset(chosen), whole):
                found[tuple(run)] += n
        return [(list(run), n) for run, n in found.items()] if len(found) <= runs else None

    while len(vocab) < size:
        n_of, places = Counter(), Counter()
        for symbols, n in state:
            for pair in zip(symbols, symbols[1:]):
                n_of[pair] += n
                places[pair] += 1
        ranked = sorted(((a, b, n, places[a, b]) for (a, b), n in n_of.items() if n >= minimum), key=lambda r: (-r[2], r[:2]))
        if not ranked:
            break
        floor = minimum - 1 if len(ranked) <= pairs else ranked[pairs][2]
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(T, "_runs", lambda _, chosen, whole: (chosen, whole))
            patch.setattr(T, "_collected", lambda asked: collected(*asked))
            patch.setattr(T, "ROUND_RUNS", runs)
            patch.setattr(T, "ROUND_PAIRS", pairs)
            merges, n_pairs = T.look_ahead(None, ranked[: pairs + 1], floor, n_pairs, set(vocab), size - len(vocab), "##")
        rounds += 1
        ranks = {pair: i for i, pair in enumerate(merges)}
        state = [(T.merge_word(symbols, ranks, "##"), n) for symbols, n in state]
        for a, b in merges:
            token = T.merged_token(a, b, "##")
            again += token in vocab
            vocab += [token] if token not in vocab else []
    return vocab, rounds, again


@pytest.mark.parametrize("seed", range(40))
def test_look_ahead_on_many_word_lists(seed):
    rng = random.Random(seed)
    words = {w: rng.choice([1, 1, 2, 3, 3, 4, 5, 9]) for w in random_words(seed, rng.choice(["ab", "abc", "abcdef"]), 90)}
    expected = one_by_one(words, 300, 3, [])
    for pairs, runs in [(4, 10_000), (50, 10_000), (50, 15), (64, 3), (3, 4), (4, 0)]:
        got, _, _ = in_process(words, 300, pairs, runs)
        assert got == expected


def test_look_ahead_survives_entries_made_anew():
    """Control tokens that merging makes as well: such a merge adds no entry."""
    made = 0
    for seed in range(30):
        rng = random.Random(seed)
        words = {w: rng.choice([1, 2, 3, 5]) for w in ("".join(rng.choices("ab", k=rng.randint(2, 9))) for _ in range(60))}
        specials = ["ab", "##ba", "##aa", "##abb", "aab"]
        got, rounds, again = in_process(words, 200, 64, 10_000, specials=specials)
        assert got == one_by_one(words, 200, 3, specials)
        made += again
    assert made > 50


def test_one_round_learns_many_merges():
    words = random_words(11, "abcdefgh", 400)
    vocab, rounds, _ = in_process(words, 2000, 400, 10_000)
    assert len(vocab) > 300 and rounds <= 6


def test_a_very_long_word_is_merged_quickly():
    from time import time

    ranks = {("a", "##a"): 0, ("##a", "##a"): 1, ("##aa", "##aa"): 2, ("aa", "##aaaa"): 3}
    symbols = ["a", *["##a"] * 99_999]
    start = time()
    merged = T.merge_word(symbols, ranks, "##")
    assert time() - start < 5
    assert "".join(t.removeprefix("##") for t in merged) == "a" * 100_000
    assert merged[:2] == ["aaaaaa", "##aaaa"]


@pytest.mark.parametrize("whole", [False, True])
def test_a_batch_is_cut_as_its_words_are(whole):
    """Runs of a batch without a step for each word; the same run of many words is one text."""
    rng = random.Random(4)
    words = [[rng.randrange(5) for _ in range(rng.randint(2, 9))] for _ in range(300)]
    batch = T._batch(T._lists(np.concatenate(words), list(map(len, words))), np.arange(1, 301))
    for chosen in ({(0, 1), (1, 2), (3, 3)}, {(4, 4)}, set()):
        want = Counter()
        for i, word in enumerate(words, start=1):
            for run in T.runs_of(word, frozenset(chosen), whole):
                want[tuple(run)] += i
        flat = T._Flat(batch)
        start, size = flat.runs(np.sort(np.array([a << 32 | b for a, b in chosen], np.int64)), whole)
        texts = flat.texts(start, size)
        freq = np.bincount(texts.indices.to_numpy(), flat.freq[flat.word[start]], len(texts.dictionary))
        assert {tuple(np.frombuffer(t, "<i4").tolist()): n for t, n in zip(texts.dictionary.to_pylist(), freq)} == want


def test_merges_of_a_round_are_applied_to_runs(spark):
    """Merges that use tokens of earlier ones, chains, and words that become one symbol."""
    words = random_words(3, "abc", 200)
    symbols = [*"abc", "##a", "##b", "##c"]
    merges = [("##a", "##b"), ("##ab", "##c"), ("a", "##abc"), ("##c", "##c"), ("##cc", "##ab"), ("b", "##a")]
    split = T.split_words(words_frame(spark, words), list("abc"), "##")
    after = T.apply_merges(T.Words(T.numbered(split, symbols), symbols), merges, "##")
    got = Counter((tuple(after.symbols[i] for i in r["symbols"]), r["freq"]) for r in after.table.collect())
    ranks = {pair: i for i, pair in enumerate(merges)}
    want = Counter()
    for word, n in words.items():
        merged = T.merge_word([c if i == 0 else "##" + c for i, c in enumerate(word)], ranks, "##")
        want[tuple(merged), n] += len(merged) > 1
    assert got == +want


def test_hand_computed_merges(spark):
    words = {"hug": 10, "pug": 5, "pun": 12, "bun": 4, "hugs": 5}
    got = tokens_of(W.train_wordpiece(words_frame(spark, words), 100, 3, specials=["[UNK]"]))
    # u+g 20, then u+n 16, h+ug 15, p+un 12, hug+s 5, p+ug 5, b+un 4
    assert got == ["[UNK]", *"bghnpsu", "##g", "##n", "##s", "##u", "##ug", "##un", "hug", "pun", "hugs", "pug", "bun"]


def test_batched_training_keeps_the_contract(spark):
    words = random_words(5, "abcdefgh", 300)
    vocab = tokens_of(W.train_wordpiece(words_frame(spark, words), 150, 3, merges_per_round=16))
    assert vocab[:5] == list(W.SPECIAL_TOKENS) and len(vocab) == len(set(vocab)) == 150
    assert {c for w in words for c in w} <= set(vocab)
    for token in vocab[5:]:
        plain = token.removeprefix("##")
        if len(plain) > 1:
            held = sum(n for w, n in words.items() if (plain in w[1:] if token.startswith("##") else w.startswith(plain)))
            assert held >= 3


def test_alphabet_limit_drops_rare_characters(spark):
    words = {"aaa": 50, "ab": 20, "axz": 1}
    vocab = tokens_of(W.train_wordpiece(words_frame(spark, words), 50, 3, limit_alphabet=2))
    assert not any("x" in t or "z" in t for t in vocab[5:])


def test_training_agrees_with_an_outside_trainer(spark, data):
    """The frequent pairs of a text do not tie, so the order of the first merges leaves no choice."""
    tokenizers = pytest.importorskip("tokenizers")
    df = spark.read.parquet(f"{data}/documents.parquet").filter("lang = 'en'").select("text")
    model = tokenizers.BertWordPieceTokenizer(
        clean_text=True, handle_chinese_chars=False, strip_accents=False, lowercase=False
    )
    model.train_from_iterator(
        (r["text"] for r in df.collect()), vocab_size=260, min_frequency=3,
        special_tokens=list(W.SPECIAL_TOKENS), wordpieces_prefix="##", show_progress=False,
    )
    got = tokens_of(W.train_wordpiece(W.word_counts(df, "text"), 260, 3))
    theirs = [t for t, _ in sorted(model.get_vocab().items(), key=lambda p: p[1])]
    plain = [t for t in got if len(t.removeprefix("##")) == 1 or t in W.SPECIAL_TOKENS]
    assert set(got) == set(theirs)
    assert got[len(plain) :][:100] == theirs[len(plain) :][:100]


def test_encoding_agrees_with_an_outside_encoder(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocab = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "un", "##aff", "##able", "a", "##b", ",", "백엔드", "##를", "B2B", "개발", "##자"]
    texts = ["unaffable a,ab b", "백엔드를 개발자 B2B", "x" * 101, "", "[MASK] a [UNK]", "café a​b", "ab\tab\n a"]
    model = tokenizers.BertWordPieceTokenizer(
        {t: i for i, t in enumerate(vocab)}, clean_text=True, handle_chinese_chars=False, strip_accents=False, lowercase=False
    )
    model.add_special_tokens(vocab[:5])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(vocab)], W.VOCAB_SCHEMA)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["tokens"] for r in W.encode_wordpiece(df, "t", frame).orderBy("i").collect()]
    assert got == [model.encode(t, add_special_tokens=False).tokens for t in texts]


def longest_match(word, vocab, prefix, unknown):
    """The definition: of all entries that fit at a place the longest, tried one by one."""
    pieces, start = [], 0
    while start < len(word):
        head = prefix if start else ""
        end = next((e for e in range(len(word), start, -1) if head + word[start:e] in vocab), None)
        if end is None:
            return [unknown]
        pieces.append(head + word[start:end])
        start = end
    return pieces


@pytest.mark.parametrize("prefix", ["##", "_", ""])
def test_longest_match_equals_the_definition(prefix):
    unknown = 0
    for seed in range(300):
        rng = random.Random(seed)
        letters = rng.choice(["ab", "abc", "ab#", "가나_"])
        text = lambda most: "".join(rng.choices(letters, k=rng.randint(1, most)))  # noqa: E731, B023
        vocab = {(prefix if rng.random() < 0.6 else "") + text(5) for _ in range(rng.randint(1, 14))} | {""}
        match = W.LongestMatch(vocab, prefix, "?")
        for _ in range(40):
            word = text(12)
            want = longest_match(word, vocab, prefix, "?")
            assert match.pieces(word) == want, (word, vocab)
            unknown += want == ["?"]
    assert 1000 < unknown < 11_900
    assert W.LongestMatch(["a"], prefix, "?").pieces("") == []


def test_longest_match_is_linear():
    from time import time

    # every place but the last begins an entry of a thousand characters
    match = W.LongestMatch(["a", "##a", "##" + "a" * 1000 + "b", "##" + "a" * 10], "##", "?")
    start = time()
    pieces = match.pieces("a" * 100_000)
    assert time() - start < 1
    assert "".join(p.removeprefix("##") for p in pieces) == "a" * 100_000 and pieces[:2] == ["a", "##" + "a" * 10]
    assert match.pieces("a" * 50_000 + "c") == ["?"]


def test_a_vocabulary_too_large_to_send_is_refused(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_ENTRIES", 3)
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate("abcd")], W.VOCAB_SCHEMA)
    with pytest.raises(ValueError, match="more than 3"):
        W.encode_wordpiece(spark.createDataFrame([("a",)], "t string"), "t", vocab)


def test_pieces_restore_the_word(spark):
    words = random_words(9, "abcdef", 200)
    vocab = W.train_wordpiece(words_frame(spark, words), 120, 3, merges_per_round=8)
    encoded = W.encode_wordpiece(words_frame(spark, words), "word", vocab).collect()
    for row in encoded:
        if W.UNKNOWN not in row["tokens"]:
            assert "".join(t.removeprefix("##") for t in row["tokens"]) == row["word"]


def test_oov_rate(spark):
    df = spark.createDataFrame([(["a", "[UNK]"],), (["b", "c"],)], "tokens array<string>")
    assert W.oov_rate(df).collect()[0].asDict() == {"n_tokens": 4, "n_unknown": 1, "unknown_pct": 25.0}
    assert W.oov_rate(df.limit(0)).count() == 0


def test_vocab_file_round_trip(spark):
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(["[PAD]", "b", "##a", "가"])], W.VOCAB_SCHEMA)
    path = new_path(spark, "vocab")
    sink_vocab(vocab.repartition(3), path)
    back = scan_vocab(spark, path).orderBy("id").collect()
    assert [(r["id"], r["token"]) for r in back] == [(0, "[PAD]"), (1, "b"), (2, "##a"), (3, "가")]


def test_probe_and_compare(spark):
    raw = spark.createDataFrame([("개발",), ("개발자를",)], "token string")
    morph = spark.createDataFrame([("개발",), ("자",)], "token string")
    probes = spark.createDataFrame([("개발",), ("개발자를",)], "word string")
    hits = {r["word"]: r["in_vocab"] for r in W.vocab_probe(probes, morph).collect()}
    assert hits == {"개발": True, "개발자를": False}
    rows = {r["token"]: (r["in_left"], r["in_right"]) for r in W.vocab_compare(raw, morph).collect()}
    assert rows == {"개발": (True, True), "개발자를": (True, False), "자": (False, True)}


def test_supplied_analyzer(spark):
    df = spark.createDataFrame([("ab cd",), (None,)], "t string")
    out = W.segment_morphemes(df, "t", factory=lambda: lambda texts: [[*t, " "] for t in texts])
    assert sorted(r["forms"] for r in out.collect()) == ["", "a b c d"]


def test_word_counts(spark):
    df = spark.createDataFrame([("a b, a",), ("b",)], "t string")
    assert {r["word"]: r["freq"] for r in W.word_counts(df, "t").collect()} == {"a": 2, "b": 2, ",": 1}
    top = W.expansion_candidates(W.word_counts(df, "t"), df.sparkSession.createDataFrame([("a",)], "token string"), 1)
    assert [(r["word"], r["freq"]) for r in top.collect()] == [("b", 2)]
