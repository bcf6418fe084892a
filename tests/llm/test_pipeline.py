import random

import corpus_pipeline
import sentencepiece
from test_decontamination import brute_force as leaks
from test_jaccard_join import brute_force as components
from test_lines_and_licenses import BLANKS, low

from siftwell import session
from siftwell.llm import language_id as L
from siftwell.llm.decontamination import EDIT_WORDS
from siftwell.llm.pieces import read_model

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"en": "abcdefgh", "de": "klmnopäö"}


def tables(spark, folder):
    """A corpus with repeated lines, near copies, leaks, and texts without letters."""
    rng = random.Random(4)
    words = {lang: ["".join(rng.choices(s, k=rng.randrange(2, 7))) for _ in range(150)] for lang, s in LETTERS.items()}
    line = lambda lang: " ".join(rng.choices(words[lang], k=rng.randrange(3, 25)))
    shared = {lang: [line(lang) for _ in range(2)] for lang in words}
    items = [(i, " ".join(rng.choices(words["en"], k=12))) for i in range(10)]
    docs = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        lines = [line(lang) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared[lang]).upper())
        if rng.random() < 0.15:
            lines.append(rng.choice(items)[1])
        docs.append((i, "\n".join(lines), lang))
    for i in range(120, 170):
        own = rng.choice(docs)
        text = own[1].split(" ")
        if rng.random() < 0.6:
            text[rng.randrange(len(text))] = "changed"
        docs.append((i, " ".join(text), rng.choice([own[2], None])))
    docs += [(170, None, "en"), (171, "", "en"), (172, "12 34 !!", "de"), (173, shared["en"][0], "en")]
    rows = [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def brute_force(spark, docs, items):
    learned = [(i, t, lang) for i, t, lang in docs if not L.crc_fold(i)]
    profiles = L.learn_profiles(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    kept = [(i, t) for i, t, _ in docs if t and profiles.predict(t)[0] != "und" and profiles.predict(t)[1] >= 0.1]
    yield kept
    key = lambda x: low(x).strip(BLANKS)
    count = {}
    for _, t in kept:
        for k in {key(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    shorter = [(i, "\n".join(x for x in t.split("\n") if not key(x) or count[key(x)] < 10), t) for i, t in kept]
    kept = [(i, t) for i, t, before in shorter if t.strip(" ") or t == before]
    yield kept
    first = {i for i, _, component in components(kept, 5, 80) if i == component}
    kept = [(i, t) for i, t in kept if i in first]
    yield kept
    bad = {d for d, _ in leaks(kept, items, EDIT_WORDS)}
    kept = [(i, t) for i, t in kept if i not in bad]
    yield kept


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    folder, out = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [out.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_force(spark, docs, items)):
        stage(spark, out, folder).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(want), name
        assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        assert all(r.n_chars == len(r.text) for r in out.collect())
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] and sizes[2] > sizes[3] > sizes[4] > 0
    library = sentencepiece.SentencePieceProcessor(model_proto=read_model())
    got = {r.doc_id: (r.piece_ids, r.n_pieces, r.round_trip) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: (library.encode(t), len(library.encode(t)), True) for i, t in want}


def test_stages_that_are_read_later_bound_their_batches(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(session.ARROW_BATCH)
    for stage in (corpus_pipeline.identify_languages, corpus_pipeline.decontaminate, corpus_pipeline.encode):
        spark.conf.set(session.ARROW_BATCH, before)
        stage(spark, docs, str(tmp_path))
        assert spark.conf.get(session.ARROW_BATCH) == str(session.BATCH_BYTES)
    spark.conf.set(session.ARROW_BATCH, before)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "some benchmark item of six words")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd_docs.columns
        ids = sorted(str(r.doc_id) for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).collect())
        assert set(ids) <= {"1", "2", "6", "7", "9", "None"}
