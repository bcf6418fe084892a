import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import huffman as H
from siftwell.llm import token_files as T


def plain_lengths(counts, limit):
    """Package-merge with the packages written out."""
    coins = [(int(n), [i]) for i, n in enumerate(counts) if n]
    level = sorted(coins, key=lambda c: c[0])
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])]
        level = sorted(coins + pairs, key=lambda c: c[0])
    lengths = [0] * len(counts)
    for _, ids in level[: 2 * len(coins) - 2]:
        for i in ids:
            lengths[i] += 1
    return lengths


@pytest.mark.parametrize("limit", [5, 6, 12])
def test_lengths_are_the_best_within_the_limit(limit):
    rng = np.random.default_rng(limit)
    for _ in range(20):
        counts = (rng.pareto(0.5, 20) * 10).astype(np.int64)
        got = H.code_lengths(counts, limit)
        assert got.max() <= limit and sum(2.0 ** -int(g) for g in got if g) == 1
        assert (got * counts).sum() == (np.array(plain_lengths(counts, limit)) * counts).sum()


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_streams_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 60_000).astype(np.uint32)
    code = H.HuffmanCode(H.code_lengths(np.bincount(ids, minlength=1)))
    stream, checkpoints = code.encode(ids)
    assert len(checkpoints) == -(-n // H.CHECKPOINT_IDS)
    assert (code.decode(stream, checkpoints, n) == ids).all()


def test_one_symbol():
    code = H.HuffmanCode(H.code_lengths(np.array([0, 0, 9])))
    ids = np.full(700, 2, np.uint32)
    assert (code.decode(*code.encode(ids), 700) == ids).all()


def test_cached_units_equal_whole_texts(monkeypatch):
    library = Tokenizer.from_str(T.read_tokenizer().decode())
    texts = [
        "", " ", "  ", "a  b", " a b ", "a\n b\n\n  c", "it's we'll  'd", "x <|endoftext|> y", "a <|endoftext|>", "tab\t t \t",
        "wide　 blank \x1c x \x85 y", "1234 56 7", "\n", "a b   c", "😛 😛  é", "end\n", "a \n b",
        "One, two. Three... ,x .y a_. b., 3.14 1,000 é. ², x\u0301. .", ".a ,b", "a\x1fb, c", "a\x1eb. c", " ,x", "a  .b", "...", "x...", "x,.y", ". a", "_.", "a_, b", "é.É,", "1. 2, 3", "don't. I'm, 'tis", "a.b,c",
    ]
    for units in (T.CACHED_UNITS, 3):
        monkeypatch.setattr(T, "CACHED_UNITS", units)
        own = T.CachedTokenizer(T.read_tokenizer())
        for some in (texts, texts[:3], texts[3:] * 3):
            assert [i.tolist() for i in own.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def brute_force(rows):
    library, start, out = Tokenizer.from_str(T.read_tokenizer().decode()), 0, []
    for i, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, path):
    return T.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids"))


def test_files_equal_brute_force(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 3000)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    T.write_token_files(docs, str(tmp_path / "x"))
    want = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(tuple(r) for r in read(spark, str(tmp_path / "x")).collect()) == want
    blocks = spark.read.parquet(str(tmp_path / "x/blocks")).orderBy("part", "first_id").collect()
    order = [i for b in blocks for i in b.doc_ids]
    assert order == sorted(order) and len(blocks) > 8


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    T.write_token_files(odd_docs, str(tmp_path / "x"))
    got = read(spark, str(tmp_path / "x")).collect()
    assert len(got) == odd_docs.count()
    assert sorted((r.start for r in got)) == list(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)][:-1]))
    assert [r.n_tokens for r in got if r.doc_id in (3, 4)] == [1, 1]
    assert min(got, key=lambda r: r.start).doc_id is None
    T.write_token_files(no_docs, str(tmp_path / "y"))
    assert read(spark, str(tmp_path / "y")).collect() == []
