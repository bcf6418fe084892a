import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.operators import chunking as C


def invariants(text, size, overlap):
    chunks = C.split_recursive(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    # every non-blank character is covered, in order
    at = 0
    for chunk in chunks:
        found = text.find(chunk, max(0, at - size))
        assert found >= 0
        assert not text[at:found].strip()
        at = max(at, found + len(chunk))
    assert not text[at:].strip()
    return chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccccc", " ", "\n", "\n\n", "가나", "x" * 30]), max_size=80).map("".join))
def test_invariants(text):
    for size, overlap in ((10, 3), (25, 0), (40, 20)):
        chunks = C.split_recursive(text, size, overlap)
        assert all(0 < len(c) <= size for c in chunks)
        covered = "".join("".join(c.split()) for c in C.split_recursive(text, size, 0))
        assert covered == "".join(text.split())


def test_unique_words_are_covered_in_order():
    words = [f"w{i}" for i in range(3000)]
    random.Random(1).shuffle(words)
    text = "".join(w + random.Random(i).choice([" ", " ", "\n", "\n\n"]) for i, w in enumerate(words))
    chunks = invariants(text, 1000, 200)
    for left, right in zip(chunks, chunks[1:]):
        shared = set(left.split()) & set(right.split())
        assert sum(len(w) + 1 for w in shared) <= 202


@pytest.mark.parametrize(
    "text, size, overlap, expected",
    [
        ("", 10, 2, []),
        (" \n\n ", 10, 2, []),
        ("x" * 10, 10, 2, ["x" * 10]),
        ("x" * 11, 10, 2, ["x" * 10, "x" * 3]),
        ("aa bb cc dd", 5, 2, ["aa bb", "cc", "dd"]),
        ("one two\n\nthree four", 10, 0, ["one two", "three", "four"]),
        ("aaa bbb ccc ddd", 8, 4, ["aaa bbb", "bbb ccc", "ccc ddd"]),
    ],
)
def test_hand_made(text, size, overlap, expected):
    assert C.split_recursive(text, size, overlap) == expected


def test_exact_size(spark):
    rows = [(1, "x" * 1000), (2, "y" * 1001), (3, ""), (4, None)]
    out = C.chunk_recursive(spark.createDataFrame(rows, "id long, t string"), "t", "id").orderBy("id", "chunk_index")
    assert [(r["id"], r["chunk_index"], len(r["chunk_text"])) for r in out.collect()] == [(1, 0, 1000), (2, 0, 1000), (2, 1, 201)]


def test_points_are_repeatable(spark):
    df = spark.range(3).withColumn("p", C.chunk_point_id(F.col("id"), F.lit(0)))
    first, second = df.collect(), df.repartition(3).orderBy("id").collect()
    assert [r["p"] for r in first] == [r["p"] for r in second]
    assert all(len(r["p"]) == 36 for r in first) and len({r["p"] for r in first}) == 3


def test_supplied_embedder_is_built_per_task(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("abc",), (None,)], "t string").coalesce(1)
    assert [list(r["vector"]) for r in C.embed_chunks(df, "t", factory).collect()] == [[3.0, 1.0], [0.0, 1.0]]


def test_bundled_embedder_gives_unit_vectors():
    out = C.hashing_embedder(64)()(["a b a", "", "c"])
    assert np.allclose(np.linalg.norm(out, axis=1), [1, 0, 1])
