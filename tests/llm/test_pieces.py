import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from siftwell.llm import piece_model as M
from siftwell.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())


@pytest.fixture(scope="module")
def transducer():
    return pieces.transducer(pieces.read_model())


TEXTS = [
    "", " ", "  a  b ", "\n\t x", "中文字 text 😛😛", "a" * 90, "x" * 300 + "é" * 30, "\x00\x01", "▁a▁▁b", "the" * 60, "١٢ مرحبا",
    "Un ciónue jaaras", " ".join("ab" * i for i in range(30)),
]


def test_equals_the_library(library, transducer):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz  éñüß0123456789.,;:!?-_/'\"()中文日本كلمة한국абв😀\n\t"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(1, 120))) for _ in range(400)]
    texts += ["".join(rng.choices("etaoin shrdlu", k=rng.randrange(1, 120))) for _ in range(400)]
    assert [transducer.encode(t) for t in texts] == library.encode(texts)
    ids = [[rng.randrange(3, 32_000) for _ in range(30)] for _ in range(200)]
    assert [transducer.decode(i) for i in ids] == library.decode(ids)


def test_small_caches(library, transducer, monkeypatch):
    monkeypatch.setattr(M, "CACHED_UNITS", 2)
    monkeypatch.setattr(M, "CACHED_PAIRS", 2)
    assert [transducer.encode(t) for t in TEXTS] == library.encode(TEXTS)


def test_a_task_leaves_no_units_behind(library, transducer):
    """Workers live longer than tasks, and other stages need their memory."""
    for run in (pieces._encoded, pieces._encoded_and_decoded):
        found = pa.concat_arrays(run(iter([pa.array(TEXTS), pa.array(["", None])]), pieces.read_model()))
        ids = found if run is pieces._encoded else found.field("ids")
        assert ids.to_pylist() == library.encode([*TEXTS, "", ""])
        assert not transducer.units and not transducer.old_units
    rows = run(iter([pa.array(TEXTS)]), pieces.read_model())  # not read to its end
    next(rows)
    rows.close()
    assert not transducer.units


def test_unigram_paths_have_the_least_weight():
    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "▁a", "abc"]
    scores = [0, -2.0, -3.0, -3.5, -3.0, -4.0, -1.0, -2.5, -9.0]
    model = M.PieceModel(names, scores, [2] + [1] * 8, M.UNIGRAM)
    machine = M.PieceTransducer(model)

    def best(text):
        if not text:
            return 0.0, []
        options = [(13.0 + 6.0, 1, 0)] if text[0] not in machine.ids else []
        options += [(-scores[i], len(p), i) for p, i in machine.ids.items() if text.startswith(p)]
        found = []
        for weight, n, i in options:
            rest = best(text[n:])
            found.append((weight + rest[0], [i, *rest[1]]))
        return min(found)

    rng = random.Random(0)
    for _ in range(100):
        text = "".join(rng.choices("abcz", k=rng.randrange(1, 8)))
        assert machine.encode(text) == best("▁" + text)[1]


def test_columns(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = pieces.detokenize(pieces.tokenize(docs)).select("text", "piece_ids", "decoded").collect()
    both = pieces.round_trip(docs)
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert both.select("text", "piece_ids", "decoded").collect() == got
    assert [r.piece_ids for r in got] == library.encode([r.text for r in got])
    assert all(r.decoded == r.text for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = pieces.detokenize(pieces.tokenize(odd_docs, out="score"), ids="score", out="label")
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    assert got.where(F.coalesce("text", F.lit("")) != F.col("label")).count() == 0
    assert got.where("doc_id IN (3, 4)").agg(F.sum(F.size("score"))).first()[0] == 0
    both = pieces.round_trip(odd_docs, ids="score", decoded="label")
    assert both.columns == odd_docs.columns and both.orderBy("doc_id", "text").collect() == got.orderBy("doc_id", "text").collect()
    assert pieces.tokenize(no_docs).collect() == pieces.round_trip(no_docs).collect() == []


def test_steps_say_whether_longer_pieces_begin_so(transducer):
    """A piece that begins no longer one ends the search at a place."""
    beginnings = {p[:k] for p in transducer.ids for k in range(1, len(p))}
    assert transducer.steps.keys() == beginnings | transducer.ids.keys()
    assert all(v == M._ONLY_PREFIX or (v >> 1, v & 1) == (transducer.ids[p], p in beginnings) for p, v in transducer.steps.items())


def test_a_search_begins_at_the_pieces_of_its_path():
    """Not at every character; and what is cut at punctuation is remembered too."""
    machine = M.PieceTransducer(M.PieceModel.parse(pieces.read_model()))
    asked = []

    class Asked(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    machine.steps = Asked(machine.steps)
    words = "understanding internationally thatreatthed, eneinerver."
    ids = machine.encode(words)
    assert sum(len(k) == 1 for k in asked) <= 1.5 * len(ids) < len(words) / 2
    asked.clear()
    assert machine.encode(words) == ids and not asked


@pytest.mark.parametrize("tied", [4_096, 4])
def test_paths_equal_merging_in_any_merge_model(monkeypatch, tied):
    """Also where the longest piece is a dead end, and where characters are beyond the table of tied ones."""
    monkeypatch.setattr(M, "TIED", tied)
    for seed in range(40):
        rng = random.Random(seed)
        names = [M.BLANK, *"abcd"]
        while len(names) < 30:
            made = rng.choice(names) + rng.choice(names)
            if made not in names and M.BLANK not in made[1:]:
                names.append(made)
        model = M.PieceModel(["<unk>", *names], [0.0, *(-float(i) for i in range(len(names)))], [2] + [1] * len(names), M.BPE)
        machine = M.PieceTransducer(model)
        for _ in range(60):
            text = "".join(rng.choices("abcdz ", (8, 8, 8, 8, 1, 2), k=rng.randrange(1, 30)))
            merged = machine._merged(machine.normalise(text))
            assert machine.encode(text) == [i for piece in merged for i in machine._written(piece)]
