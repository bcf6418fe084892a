"""Similarity joins on word shingles: from signatures of sets to connected classes.

A join differs from another in its signatures (which sets can meet) and in how it searches a block; both are handed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.batches import giving_back
from siftwell.llm.columns import free_name, only, sent_if_small
from siftwell.llm.components import components
from siftwell.llm.wordhash import BLANK, hash_words, mix, shingles, slices, text_bytes
from siftwell.session import small_batches, stage, unstage

#: Texts whose signatures are combined before they are shuffled, in bytes.
COMBINE_BYTES = 16 << 20
#: Nodes in one row of those that share a signature.
LIST_NODES = 64
#: Most bytes of a row of two classes, or of a class and some numbers, in memory.
PAIR_BYTES = 120
#: Shingles that a task indexes and shingles that it looks up in them; larger blocks are searched in parts.
INDEX_SHINGLES, PROBE_SHINGLES = 500_000, 4_000_000


@dataclass(frozen=True)
class Method:
    """``sign`` gives, of some sets, (signatures one after the other, how many each set has): sets that share none are never
    compared. ``search`` finds links in a block: (sets, indexed, percent) -> a function of i that yields those positions of
    ``indexed`` that link with set i."""

    sign: Callable[[list[np.ndarray], int], tuple[np.ndarray, np.ndarray]]
    search: Callable[[list[np.ndarray], list[int], int], Callable[[int], Iterator[int]]]


def links_up(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


# ---- sets of texts -------------------------------------------------------------------------------------------------


def identity(tokens: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return np.array([tokens.sum(dtype=np.uint64) + np.uint64(len(tokens)), mix(tokens).sum(dtype=np.uint64)]).tobytes()


def node_of(name: bytes) -> int:
    return int(np.frombuffer(name, dtype=np.int64)[0])


def text_sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, set) of each text."""
    for start, end in slices(list(map(len, texts))):
        hashes, counts = hash_words(texts[start:end], BLANK)
        at = np.concatenate([[0], np.cumsum(counts)])
        for i in range(end - start):
            yield start + i, shingles(hashes[at[i] : at[i + 1]], size)


def _identify(size: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = [], []
            for _, tokens in text_sets(text_bytes(batch.column("text")), size):
                names.append(identity(tokens) if len(tokens) else None)
                counts.append(len(tokens))
            nodes = [None if name is None else node_of(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array(counts, pa.int64()), pa.array(names, pa.binary()),
                    pa.array(nodes, pa.int64()),
                ],
                names=["doc_id", "mark", "n_shingles", "class", "node"],
            )

    return run


def _hashes(size: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for start, end in slices(list(map(len, texts))):
                sets = [tokens.view(np.int64) for _, tokens in text_sets(texts[start:end], size)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                hashes = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets), pa.int64()))
                kept = [batch.column(c).slice(start, end - start) for c in ("node", "class")]
                yield pa.RecordBatch.from_arrays([*kept, hashes], names=["node", "class", "hashes"])

    return run


# ---- who shares a signature ----------------------------------------------------------------------------------------


def combined(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """The nodes that share a signature in a piece of the corpus: rows of the smallest and up to ``LIST_NODES`` others."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    once = new | np.concatenate([[True], node[1:] != node[:-1]])
    key, node, new = key[once], node[once], new[once]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    place = np.arange(len(key)) - first
    begins = new | ((place > 1) & ((place - 1) % LIST_NODES == 0))
    n_others = np.bincount((np.cumsum(begins) - 1)[~new], minlength=begins.sum())
    offsets = np.concatenate([[0], np.cumsum(n_others)]).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[~new]), mask=pa.array(n_others == 0))
    return pa.RecordBatch.from_arrays(
        [pa.array(key[begins]), pa.array(node[first[begins]]), others], names=["key", "node", "others"]
    )


def signed(method: Method, size: int, percent: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for start, end in slices(list(map(len, texts))):
                sets = [tokens for _, tokens in text_sets(texts[start:end], size) if len(tokens)]
                held += sum(map(len, texts[start:end]))
                if sets:
                    found, counts = method.sign(sets, percent)
                    if len(found):
                        keys.append(found.view(np.int64))
                        nodes.append(np.repeat(np.array([node_of(identity(s)) for s in sets]), counts))
                if held > COMBINE_BYTES and keys:
                    yield combined(np.concatenate(keys), np.concatenate(nodes))
                    keys, nodes, held = [], [], 0
        if keys:
            yield combined(np.concatenate(keys), np.concatenate(nodes))

    return run


@giving_back
def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and node: everybody under a key, in whatever piece, is tied to its first node."""
    last_key = last_head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        others = batch.column("others")
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = node[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if last_key is not None and key[0] == last_key:
            head[key == last_key] = last_head
        last_key, last_head = key[-1], head[-1]
        n_others = others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        pairs = np.stack(
            [
                np.concatenate([node, others.flatten().to_numpy(zero_copy_only=False)]),
                np.concatenate([head, np.repeat(head, n_others)]),
            ],
            axis=1,
        )
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["node", "head"])


# ---- comparing -----------------------------------------------------------------------------------------------------


def _can_link(a: str, b: str, percent: int):
    """Sizes of two sets that link are near each other."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """(a, b, linked) for the classes of each pair, at most ``rows`` of them, by their whole sets."""
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("of_b"))
    both = left.join(sent_if_small(pairs.select("a", "b"), PAIR_BYTES, rows), "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    union = F.size("of_a") + F.size("of_b") - shared
    return both.select("a", "b", (100 * shared >= percent * union).alias("linked"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def search_block(
    sets: list[np.ndarray], labels: list, indexed: list[int], probes: list[int], method: Method, percent: int
) -> list[tuple[int, int]]:
    """Links between ``probes`` and ``indexed`` that connect all that are connected at all.

    Sets of one label are known to be connected. Ends as soon as everything is.
    """
    if not indexed:
        return []
    forest, first = _Forest(len(sets)), {}
    for i, label in enumerate(labels):
        forest.join(first.setdefault(label, i), i)
    links: list[tuple[int, int]] = []
    found = None
    roots = {forest.root(i) for i in indexed}
    for i in probes:
        if roots == {forest.root(i)}:
            continue
        if found is None:
            found = method.search(sets, indexed, percent)
        for j in found(i):
            if j != i and forest.join(i, j):
                links.append((i, j))
                roots = {forest.root(r) for r in roots}
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block, chunk and part, which come one after the other."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for start, end in zip(cuts, cuts[1:]):
            if held and part[start] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = part[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _searched(method: Method, percent: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            names, labels = rows["class"].to_pylist(), rows["label"].to_pylist()
            hashes = rows["hashes"].combine_chunks()
            values, offsets = hashes.flatten().to_numpy().view(np.uint64), hashes.offsets.to_numpy()
            offsets = offsets - offsets[0]
            sets = [values[a:b] for a, b in zip(offsets, offsets[1:])]
            indexed, probes = (np.flatnonzero(rows[c].to_numpy()).tolist() for c in ("indexed", "probe"))
            links = search_block(sets, labels, indexed, probes, method, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, _ in links], pa.binary()), pa.array([names[j] for _, j in links], pa.binary())],
                names=["a", "b"],
            )

    return run


def _block_links(pairs: DataFrame, labels: DataFrame, sets: DataFrame, method: Method, percent: int) -> DataFrame:
    """Links inside blocks between members of different components.

    Pairs with the head of a block are settled; a block is open if its other members are in several components. What
    is not in the largest of them is indexed, by chunks, and everything is looked up in it, by parts.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = sets.select(F.col("class").alias("a"), F.size("hashes").alias("size"))
    label = sent_if_small(labels.select(F.col("node").alias("a"), "label"), PAIR_BYTES)
    members = stage(
        pairs.join(label, "a", "left").join(sent_if_small(sizes, PAIR_BYTES), "a")
        .select(F.col("b").alias("block"), "a", F.coalesce("label", "a").alias("label"), "size"),
        "members",
    )
    per_label = members.groupBy("block", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = per_label.groupBy("block").agg(
        F.max_by("label", "n").alias("big"), F.max_by("size", "n").alias("big_size"), F.sum("size").alias("size"), F.count("*").alias("n"),
    ).where("n > 1")
    blocks = blocks.select(
        "block", "big",
        F.ceil((F.col("size") - F.col("big_size")) / INDEX_SHINGLES).alias("chunks"), F.ceil(F.col("size") / PROBE_SHINGLES).alias("parts"),
    )
    blocks = stage(blocks, "open_blocks")
    placed = members.join(sent_if_small(blocks, PAIR_BYTES), "block").withColumn("small", F.col("label") != F.col("big"))
    mark = F.xxhash64("a")
    chunk = F.pmod(F.shiftright(mark, 20), F.col("chunks"))
    part = F.pmod(mark, F.col("parts"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    probing = F.transform(
        upto("chunks"),
        lambda c: F.struct(c.alias("chunk"), part.alias("part"), F.lit(True).alias("probe"), (F.col("small") & (c == chunk)).alias("indexed")),
    )
    held = F.transform(
        F.filter(upto("parts"), lambda p: F.col("small") & (p != part)),
        lambda p: F.struct(chunk.alias("chunk"), p.alias("part"), F.lit(False).alias("probe"), F.lit(True).alias("indexed")),
    )
    dealt = placed.select("block", "a", "label", F.explode(F.concat(probing, held)).alias("at"))
    dealt = dealt.select(
        F.xxhash64("block", "at.chunk", "at.part").alias("task"), "at.probe", "at.indexed", "label", F.col("a").alias("class")
    )
    dealt = stage(dealt, "dealt")
    rows = sets.select("class", "hashes").join(sent_if_small(dealt, PAIR_BYTES), "class")
    rows = rows.repartition(n, "task").sortWithinPartitions("task")
    found = stage(rows.mapInArrow(_searched(method, percent), "a binary, b binary"), "block_links")
    unstage(members, blocks, dealt)
    return found


def similar_sets(docs: DataFrame, method: Method, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of ``docs`` (doc_id, text).

    ``rows`` has doc_id, mark (a hash of the text), n_shingles and class (128 bits that stand for the set; null if it
    is empty), one row per document. ``classes`` has class, least (smallest doc_id of the component), pick (smallest
    doc_id and mark) for each class that has several rows or a link.

    Equal sets are one class from the start. Classes that share a signature are tied to the smallest node under it, the
    head of a block. A class is compared with its smallest head first, then with those other heads to which that has not
    connected it. After that, a block is searched only between members that are still in different components. So a
    group of near copies costs one comparison each, and its sets are sent once. Blocks are dealt by bytes.
    """
    with small_batches(docs.sparkSession):
        return _similar_sets(docs, method, words, percent)


def _similar_sets(docs: DataFrame, method: Method, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    docs = only(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(
        docs.mapInArrow(
            _identify(words), f"doc_id {id_type}, mark long, n_shingles long, class binary, node long"
        ),
        "shingle_sets",
    )
    keys = docs.select("text").mapInArrow(signed(method, words, percent), "key long, node long, others array<long>")
    tied = keys.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(tie, "node long, head long")
    ties = stage(tied.distinct(), "ties")
    per_class = (
        rows.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.first("node").alias("node"),
            F.first("n_shingles").alias("size"),
            F.min("doc_id").alias("least"),
            F.min(F.struct("doc_id", "mark")).alias("pick"),
            F.count("*").alias("n"),
        )
    )
    picked = stage(per_class, "classes")
    of_a = picked.select("node", F.col("class").alias("a"), F.col("size").alias("size_a"))
    of_b = picked.select(F.col("node").alias("head"), F.col("class").alias("b"), F.col("size").alias("size_b"))
    n_classes, n_ties = picked.count(), ties.count()
    few = lambda side: sent_if_small(side, PAIR_BYTES, n_classes)
    # pairs with a head of another size stay, since two members may link
    pairs = stage(
        ties.join(few(of_a), "node").join(few(of_b), "head")
        .select("a", "b", "head", _can_link("size_a", "size_b", percent).alias("near")),
        "tied",
    )
    wanted = ties.select("node").union(ties.select(F.col("head").alias("node")))
    wanted = picked.join(sent_if_small(wanted, 16, 2 * n_ties), "node", "left_semi")
    wanted = stage(wanted.select("class", "node", "pick.doc_id", "pick.mark"), "wanted")
    asked = sent_if_small(wanted, PAIR_BYTES).withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m")
    texts = docs.join(asked, docs.doc_id.eqNullSafe(F.col("d")) & docs.mark.eqNullSafe(F.col("m")))
    sets = stage(
        texts.select("node", "class", "text").mapInArrow(_hashes(words), "node long, class binary, hashes array<long>"), "sets"
    )
    if rows.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():
        repeated, sets = sets, stage(sets.dropDuplicates(["class"]), "sets")
        unstage(repeated)

    near = pairs.where("near")
    first = near.groupBy("a").agg(F.min(F.struct("head", "b")).alias("h")).select("a", "h.b")
    first = stage(_compared(first, sets, percent, n_ties), "first_links")
    n_first = first.count()
    star = first.where("linked").select("a", "b")
    over = sent_if_small(star.select(F.col("a").alias("b"), F.col("b").alias("above")), PAIR_BYTES, n_first)
    up = stage(star.join(over, "b", "left").select(F.col("a").alias("node"), F.coalesce("above", "b").alias("label")), "up")
    asked = sent_if_small(first.select("a", "b"), PAIR_BYTES, n_first)
    rest = near.select("a", "b").join(asked, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        label = sent_if_small(up.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), PAIR_BYTES, n_first)
        rest = rest.join(label, side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
    rest = stage(rest.where("label_a <> label_b").select("a", "b"), "unsettled")
    second = stage(_compared(rest, sets, percent, rest.count()), "second_links")
    links = star.union(second.where("linked").select("a", "b"))
    labels = components(links, up)
    more = _block_links(pairs.select("a", "b"), labels, sets, method, percent)
    if more.limit(1).count():
        before, labels = labels, components(links.union(more), labels)
        unstage(before)
    named = sent_if_small(labels.withColumnRenamed("node", "class"), PAIR_BYTES)
    linked = picked.join(named, "class", "left").where("n > 1 OR label IS NOT NULL")
    linked = linked.withColumn("label", F.coalesce("label", "class"))
    multiple = linked.groupBy("label").agg(F.min("least").alias("least"), F.min("pick").alias("pick"))
    classes = stage(linked.select("class", "label").join(multiple, "label").select("class", "least", "pick"), "similar_classes")
    unstage(ties, picked, pairs, wanted, sets, first, up, rest, second, more, labels)
    return rows, classes


def components_of(docs: DataFrame, method: Method, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    rows, classes = similar_sets(only(docs, doc_id=doc_id, text=text), method, words, percent)
    named = classes.select("class", F.col("least").alias("component_id"))
    return rows.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_per_component(docs: DataFrame, method: Method, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id (of equal ids, the smallest hash)."""
    rows, classes = similar_sets(only(docs, doc_id=doc_id, text=text), method, words, percent)
    other = ~(F.col("doc_id").eqNullSafe(F.col("pick.doc_id")) & F.col("mark").eqNullSafe(F.col("pick.mark")))
    gone = stage(rows.join(classes, "class").where(other).select("doc_id", "mark").distinct(), "near_copies")
    d, m, mark = "gone_id", "gone_mark", free_name(docs, "text_mark")
    gone = sent_if_small(gone, 32).select(F.col("doc_id").alias(d), F.col("mark").alias(m))
    marked = docs.withColumn(mark, F.xxhash64(F.col(text)))
    kept = marked.join(gone, marked[doc_id].eqNullSafe(gone[d]) & (marked[mark] == gone[m]), "left_anti")
    if rows.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([doc_id, mark])
    unstage(rows, classes)
    return kept.drop(mark)
