from hashlib import md5

import pytest
from oracle import compare, connect

from siftwell.queries import ORACLES, QUERIES

ROWS_ONLY = {"train_wordpiece", "vocab_size", "chunk_recursive", "chunks_per_posting", "train_vocab"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, data, name):
    verdict, _, rows = compare(spark, con, data, name)
    assert verdict.startswith(("ok", "rows only")), verdict
    assert rows > 0


def test_only_what_sql_cannot_state_lacks_it():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
    assert entry.entry(spark).columns == ["lang", "docs", "unique_docs", "chars"]


def test_chunk_counts_cover_every_body(spark, data):
    from pyspark.sql import functions as F

    counted = QUERIES["chunks_per_posting"](spark, data)
    chunks = QUERIES["chunk_recursive"](spark, data).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert counted.filter("doc_id >= 0").join(chunks, "doc_id", "full").filter("n_chunks <> coalesce(n, 0) OR n_chunks IS NULL").isEmpty()
    assert counted.filter("n_chunks = 0 AND doc_id < 0").count() == counted.filter("doc_id >= 0 AND doc_id % 5 = 0").count() > 0


def recursive_packing(text, size=1000, overlap=200):
    """The chunks of a body by the definition, on indexes into the text: no piece is ever built before it is chosen."""
    spans = []

    def pack(cuts):
        """Greedy windows [i, j) of neighbouring pieces; the next one starts at the first piece that leaves at most the overlap."""
        i = j = 0
        while j < len(cuts) - 1:
            while j < len(cuts) - 1 and (j == i or cuts[j + 1] - cuts[i] <= size):
                j += 1
            spans.append((cuts[i], cuts[j]))
            if j < len(cuts) - 1:
                while i < j and (cuts[j] - cuts[i] > overlap or cuts[j + 1] - cuts[i] > size):
                    i += 1

    def split(start, end, separators):
        at = next(k for k, s in enumerate(separators) if s in text[start:end])
        mark, finer = separators[at], separators[at + 1 :]
        if mark:
            places, found = [start], text.find(mark, start, end)
            while found >= 0:
                places += [found] if found > places[-1] else []
                found = text.find(mark, found + len(mark), end)
        else:
            places = list(range(start, end))
        cuts, run = [*places, end], [places[0]]
        for a, b in zip(cuts, cuts[1:]):
            if b - a < size or not finer:
                run.append(b)
                continue
            pack(run)
            split(a, b, finer)
            run = [b]
        pack(run)

    if text:
        split(0, len(text), ("\n\n", "\n", " ", ""))
    return [c for c in (text[a:b].strip() for a, b in spans) if c]


def test_chunks_of_all_documents_equal_brute_force(spark, data):
    from siftwell.queries.registry import noisy_documents

    want = {}
    for row in noisy_documents(spark, data).select("doc_id", "body").collect():
        for i, chunk in enumerate(recursive_packing(row["body"] or "")):
            want[row["doc_id"], i] = (len(chunk), md5(chunk.encode()).hexdigest())
    got = {(r["doc_id"], r["chunk_index"]): (r["n"], r["chunk"]) for r in QUERIES["chunk_recursive"](spark, data).collect()}
    assert len(want) > 200 and got == want
    counted = {r["doc_id"]: r["n_chunks"] for r in QUERIES["chunks_per_posting"](spark, data).collect()}
    assert all(n == sum(d == doc for d, _ in want) for doc, n in counted.items())


def test_vocabularies_are_trained_to_the_end(spark, data):
    """32,000 entries, or all that occur three times: then no neighbours are left that do."""
    from siftwell.operators import wordpiece as W

    vocab = QUERIES["train_wordpiece"](spark, data).orderBy("id").collect()
    tokens = [r["token"] for r in vocab]
    assert [r["id"] for r in vocab] == list(range(len(tokens))) and len(set(tokens)) == len(tokens)
    assert QUERIES["vocab_size"](spark, data).first()["vocab_size"] == len(tokens)
    assert len(tokens) == W.VOCAB_SIZE or 5000 < len(tokens) < W.VOCAB_SIZE
    first = QUERIES["train_wordpiece_first"](spark, data).orderBy("id").collect()
    assert [r["token"] for r in first] == tokens[: len(first)]
