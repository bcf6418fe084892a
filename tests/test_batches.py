import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.functions import batches as B
from siftwell.functions import text as T
from siftwell.operators import chunking as C
from siftwell.operators import wordpiece as W
from siftwell.queries import registry
from siftwell.sources import csv_parts


def test_slices_keep_every_row_and_their_bound():
    texts = pa.array(["ab", None, "", "x" * 50, "cd", "ef", "gh"] * 9)
    slices = list(B.text_slices(texts.slice(1), 5))
    assert pa.concat_arrays(slices).equals(texts.slice(1))
    assert all(len(s) == 1 or sum(len(t or "") for t in s.to_pylist()) <= 5 for s in slices)
    lists = pa.array([[1, 2], [], None, list(range(20)), [3]] * 4)
    assert [x for s in B.list_slices(lists, 4) for x in s.to_pylist()] == lists.to_pylist()
    assert list(B.text_slices(pa.array([], pa.string()))) == []


def test_a_task_turns_a_bounded_part_of_a_batch_into_objects(spark, monkeypatch):
    """The results are those of whole batches; ``text_slices`` is what the tasks see of a batch."""
    rows = [(i, None if i % 7 == 0 else f"Ａ{i} word\n" * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    want = {i: T.unicodedata.normalize("NFKC", t) if t is not None else None for i, t in rows}
    monkeypatch.setattr(B, "SLICE_BYTES", 100)
    assert {r["id"]: r["n"] for r in df.select("id", T.normalize_nfkc(F.col("t")).alias("n")).collect()} == want
    chunks = {r["id"]: r["c"] for r in df.select("id", C.chunk_texts(F.col("t"), 40, 10).alias("c")).collect()}
    assert chunks == {i: None if t is None else C.split_recursive(t, 40, 10) for i, t in rows}
    vocab = spark.createDataFrame([(0, "word"), (1, "A"), (2, "##1")], "id int, token string")
    monkeypatch.setattr(W, "ENCODED_WORDS", 7)
    encoded = {r["id"]: r["tokens"] for r in W.encode_wordpiece(df, "t", vocab).collect()}
    assert len(encoded) == 300 and all(len(encoded[i]) == 2 * (t or "").count("\n") for i, t in rows)


def test_vectors_leave_the_task_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "EMBED_ROWS", 3)

    def factory():
        return lambda texts: np.array([[len(texts), len(t)] for t in texts])

    df = spark.range(8).select("id", F.when(F.col("id") != 2, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t")).coalesce(1)
    found = {r["id"]: r["vector"] for r in C.embed_chunks(df, "t", factory).collect()}
    assert found == {i: [3.0 if i < 6 else 2.0, 0.0 if i == 2 else float(i)] for i in range(8)}


def test_rows_of_a_file_leave_the_task_by_their_size(monkeypatch):
    content = pa.py_buffer(("iframe_jd_text\n" + "\n".join("한" * 30 for _ in range(10))).encode("utf-8-sig"))
    monkeypatch.setattr(csv_parts, "_CHARS_AT_ONCE", 90)
    parsed = csv_parts._parse("p", content, "iframe_jd_text", ["iframe_jd_text"])
    sizes = []
    while rows := csv_parts._some(parsed):
        sizes.append(len(rows))
    assert sizes == [4, 3, 3, 1]


def test_a_bad_byte_counts_before_a_bad_row():
    late = pa.py_buffer(b"t\n1,2\n" + b"x" * 3_000_000 + b"\xff")
    assert next(csv_parts._parse("p", late, "t", ["t"]))[2] == "not UTF-8 at byte 3000006"


def test_partitions_become_more_with_the_table(spark, data, monkeypatch):
    whole = registry.table(spark, data, "documents")
    monkeypatch.setattr(registry, "PARTITION_BYTES", 10_000)
    dealt = registry.text_table(spark, data, "documents", "doc_id")
    assert dealt.rdd.getNumPartitions() > 20
    assert dealt.exceptAll(whole).count() == 0 and dealt.count() == whole.count()
