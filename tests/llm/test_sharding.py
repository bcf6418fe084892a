import hashlib

import pytest
from oracle import connect, rows_of
from pyspark.sql import functions as F

from siftwell.llm import sharding as S
from siftwell.llm.queries import sharding_sql

NAMES = ["doc_id", "shard", "n_bytes", "shard_bytes", "shard_docs"]


@pytest.mark.parametrize("limit", [1 << 30, 100_000, 20_000])
def test_equals_sql(spark, data, limit, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(F.octet_length("text") <= 20_000)
    S.write_shards(docs, str(tmp_path / "s"), limit=limit)
    got = S.read_shards(spark, str(tmp_path / "s"))
    con = connect(data)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{data}/documents.parquet' WHERE strlen(text) <= 20000")
    assert rows_of(got.select(*NAMES).toArrow()) == rows_of(con.sql(sharding_sql(limit)).to_arrow_table())
    assert got.agg(F.max("shard_bytes")).first()[0] <= limit
    assert set(docs.columns) < set(got.columns)


def plain(rows, limit):
    """Splits oversized buckets bit by bit, first on the key's bits and then on those of the row."""
    bits = lambda s: f"{int(hashlib.md5(s.encode()).hexdigest()[:15], 16):060b}"
    out = []

    def split(some, depth, phase, at):
        if sum(r[2] for r in some) <= limit or (phase == "r" and depth == 60):
            out.extend((r[0], r[1], phase + at) for r in some)
        elif depth == 60:
            rest.extend(some)
        else:
            for b in "01":
                half = [r for r in some if r[4 if phase else 3][depth] == b]
                if half:
                    split(half, depth + 1, phase, at + b)

    keyed = [
        (i, t, len((t or "").encode()), bits("" if i is None else str(i)), bits("\0".join(x for x in (None if i is None else str(i), t) if x is not None)))
        for i, t in rows
    ]
    rest = []
    split(keyed, 0, "", "")
    if rest:
        split(rest, 0, "r", "")
    return sorted(out, key=repr)


def test_a_hot_key_is_split_by_row(spark):
    rows = [(7, "x" * 50 + str(i)) for i in range(40)] + [(i, "y" * 30) for i in range(100, 140)] + [(8, "z" * 500)]
    got = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=200)
    assert sorted(((r.doc_id, r.text, r.shard) for r in got.collect()), key=repr) == plain(rows, 200)
    assert {r.doc_id for r in got.where("shard_bytes > 200 OR shard_bytes IS NULL").collect()} == {8}


def test_odd_rows(spark, odd_docs, no_docs):
    for limit in (30, 1 << 20):
        got = S.assign_shards(odd_docs, limit=limit)
        assert got.count() == odd_docs.count()
        want = plain([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], limit)
        assert sorted(((r.doc_id, r.text, r.shard) for r in got.collect()), key=repr) == want
    assert S.assign_shards(no_docs).collect() == []
