"""Exact similarity search over dense vectors, and the vector table itself."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ranking import top_k_per_group
from siftwell.session import stage

SEARCH_LIMIT = 5
SCORE_DIGITS = 6
# most cells; vectors that a task holds, as rows and as numbers in them; queries that are streamed past them; rows whose
# cells are looked up at a time
MAX_PIVOTS = 1024
CELL_ROWS = 50_000
CELL_NUMBERS = 8_000_000
QUERY_ROWS = 200_000
ASSIGN_ROWS = 4096
# a smaller table is dealt to several tasks for each core, but not to tasks of fewer rows than these
TASKS_PER_CORE = 4
LEAST_ROWS = 2000
# queries that a task searches for at a time, and scores of one precision that it holds
QUERY_SLICE = 1024
NARROW_CELLS = 2_000_000
# by how much a bound may be too low: scores are rounded, angles computed
SLACK = 2e-6
# below every cosine: stands for the undefined score of a zero or missing vector inside a task
UNDEFINED = -2.0

# cells of a score matrix that a task holds at a time
SCORE_CELLS = 4_000_000

CANDIDATES = "query_id long, doc_id long, score double"
_ASKING = "query_id long, vector array<double>, floor double, cells array<int>, groups array<int>"


def _unit_rows(vectors: pa.ListArray) -> np.ndarray:
    """Matrix of unit rows; missing and zero vectors give rows of NaN."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if not np.isin(sizes, (0, width)).all():
        raise ValueError("vectors differ in length")
    matrix = np.full((len(vectors), width), np.nan)
    if width:
        matrix[sizes > 0] = vectors.filter(pa.array(sizes > 0)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


class _Best:
    """The ``k`` best documents per query seen by one task: score descending, ties by id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.rows, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def offer(self, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        """Takes a matrix of (query, document) scores; minus infinity stands for no score at all."""
        # a document counts as its best row
        order = np.argsort(doc_ids, kind="stable")
        doc_ids, starts = np.unique(doc_ids[order], return_index=True)
        scores = np.maximum.reduceat(scores[:, order], starts, axis=1)
        if len(doc_ids) > self.k:
            floor = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            rows, columns = np.nonzero(scores >= floor)
        else:
            rows, columns = np.indices(scores.shape).reshape(2, -1)
        found = scores[rows, columns] > -np.inf
        rows, columns = rows[found], columns[found]
        self.rows = np.concatenate([self.rows, rows])
        self.ids = np.concatenate([self.ids, doc_ids[columns]])
        self.scores = np.concatenate([self.scores, scores[rows, columns]])
        self._cut()

    def _cut(self) -> None:
        order = np.lexsort((-self.scores, self.ids, self.rows))
        rows, ids, scores = self.rows[order], self.ids[order], self.scores[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
        rows, ids, scores = rows[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]

    def batch(self, undefined: float | None = UNDEFINED) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.query_ids[self.rows], pa.int64()),
                pa.array(self.ids, pa.int64()),
                pa.array(self.scores, pa.float64(), mask=self.scores == undefined if undefined is not None else None),
            ],
            names=["query_id", "doc_id", "score"],
        )


class _Nearest(_Best):
    """The ``k`` best by cosine. ``floor`` holds for each query a score that the best are known to reach.

    Scores are first taken in single precision. What could reach the floor, given the largest error that such a sum can
    have, is scored again in double precision, and the floor rises with what is found.
    """

    def __init__(self, query_ids: np.ndarray, asking: np.ndarray, k: int, floor: np.ndarray | None = None):
        super().__init__(query_ids, k)
        self.asking, self.narrow = asking, asking.astype(np.float32)
        self.floor = np.full(len(query_ids), -np.inf) if floor is None else floor.copy()
        self.margin = 10.0**-SCORE_DIGITS + (asking.shape[1] + 4) * 2.0**-24

    def add(self, queries: np.ndarray, doc_ids: np.ndarray, doc_rows: np.ndarray, narrow: np.ndarray) -> None:
        """Offers documents, given in both precisions, to the queries of these numbers."""
        step = max(1, NARROW_CELLS // max(1, len(queries)))
        asking = self.narrow[queries]
        for lo in range(0, len(doc_ids) if len(queries) else 0, step):
            ids, scores = doc_ids[lo : lo + step], asking @ narrow[lo : lo + step].T
            least = self.floor[queries] - self.margin
            likely = scores >= least.astype(np.float32)[:, None]
            if np.count_nonzero(likely) > 4 * self.k * len(queries):
                likely = scores >= np.maximum(least, self._reached(scores, ids)).astype(np.float32)[:, None]
            self._take(queries, np.flatnonzero(likely), ids, doc_rows[lo : lo + step])

    def _reached(self, scores: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        """What the ``k`` best of these documents reach for sure; a document counts as its best row."""
        order = np.argsort(doc_ids, kind="stable")
        distinct, starts = np.unique(doc_ids[order], return_index=True)
        if len(distinct) < self.k:
            return np.full(len(scores), -np.inf)
        if len(distinct) < len(doc_ids):
            scores = np.maximum.reduceat(scores[:, order], starts, axis=1)
        at = scores.shape[1] - self.k
        return np.partition(scores, at, axis=1)[:, at].astype(float) - 2 * self.margin

    def _take(self, queries: np.ndarray, found: np.ndarray, doc_ids: np.ndarray, doc_rows: np.ndarray) -> None:
        step = max(1, SCORE_CELLS // max(1, doc_rows.shape[1]))
        for lo in range(0, len(found), step):
            row, column = np.divmod(found[lo : lo + step], len(doc_ids))
            row = queries[row]
            scores = np.round(np.einsum("ij,ij->i", self.asking[row], doc_rows[column]), SCORE_DIGITS)
            good = scores >= self.floor[row]
            if not good.any():
                continue
            self.rows = np.concatenate([self.rows, row[good]])
            self.ids = np.concatenate([self.ids, doc_ids[column[good]]])
            self.scores = np.concatenate([self.scores, scores[good]])
            self._cut()
            last = np.flatnonzero(np.arange(len(self.rows)) - np.searchsorted(self.rows, self.rows) == self.k - 1)
            self.floor[self.rows[last]] = np.maximum(self.floor[self.rows[last]], self.scores[last])


@dataclass(frozen=True)
class Cells:
    """Cells around unit pivots: how many vectors each holds, and the least and largest angle between them and the pivot."""

    pivots: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    def angles(self, rows: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(rows @ self.pivots.T, -1, 1))

    def nearest(self, rows: np.ndarray, k: int) -> list[np.ndarray]:
        """For each row the nearest cells, as many as it takes to hold ``k`` vectors."""
        order = np.argsort(self.angles(rows), axis=1, kind="stable")
        held = np.cumsum(self.counts[order], axis=1)
        return [o[: n + 1][self.counts[o[: n + 1]] > 0] for o, n in zip(order, (held < k).sum(axis=1))]

    def near(self, rows: np.ndarray, scores: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """For each row which of the cells (or of those in ``which``) may hold a vector of at least that cosine.

        Angles obey the triangle inequality: a vector at angle v from a pivot that is at angle p from the row is at least
        |p - v| away from the row.
        """
        angles = np.arccos(np.clip(rows @ self.pivots[which].T, -1, 1))
        apart = np.maximum(np.maximum(angles - self.largest[which], self.least[which] - angles), 0)
        return (np.cos(apart) + SLACK >= scores[:, None]) & (self.counts[which] > 0)

    def within(self, rows: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
        """For each row the cells that may hold a vector of at least that cosine."""
        return [np.flatnonzero(n) for n in self.near(rows, scores)]


@dataclass(frozen=True)
class Groups:
    """Groups of neighbouring cells that tasks hold: for each cell its first group, and over how many it is dealt."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, cells: Cells, rows: int) -> Groups:
        """Groups of at most ``rows`` vectors. From each cell the next one is the nearest not yet in a group."""
        n = len(cells.counts)
        first, parts = np.zeros(n, np.int64), np.maximum(1, -(-cells.counts // rows))
        free, at, group, held = np.ones(n, bool), 0, 0, 0
        for _ in range(n):
            free[at] = False
            if held and held + cells.counts[at] > rows:
                group, held = group + 1, 0
            first[at], held = group, held + cells.counts[at]
            if parts[at] > 1:
                group, held = group + parts[at], 0
            cosine = cells.pivots @ cells.pivots[at]
            cosine[~free] = -np.inf
            at = int(cosine.argmax())
        return cls(first, parts)

    def holding(self, cells: np.ndarray) -> np.ndarray:
        """The groups that hold one of the cells."""
        parts = self.parts[cells]
        ends = np.cumsum(parts)
        return np.unique(np.repeat(self.first[cells] - (ends - parts), parts) + np.arange(ends[-1] if len(ends) else 0))


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = SEARCH_LIMIT,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "vector",
) -> DataFrame:
    """The ``k`` documents of highest cosine similarity per query, ties by document id.

    Returns (query_id, doc_id, score, rank). A document with several vectors counts as its most similar one; a zero or
    missing vector has no score and ranks last. Exact.

    A few queries, not more than there would be cells, are sent to the documents, each task of which keeps ``k`` for a
    query. Otherwise the corpus is dealt into cells around at most ``MAX_PIVOTS`` of its vectors. A query asks its nearest
    cells first, which gives its k-th score so far, then only those others that the triangle inequality does not rule
    out. A task holds a group of neighbouring cells, at most ``CELL_ROWS`` vectors; a query is sent once to a group,
    however many cells of it are asked. Queries are streamed past, ``QUERY_ROWS`` to a task, and of what reaches the
    query's score ``k`` documents per query and task come back. How much is ruled out depends on the data: of vectors
    without any clusters, nothing; each query is then compared with each vector.
    """
    spark = corpus.sparkSession
    questions = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("vector"))
    documents = corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(vector).alias("vector"))
    n_documents, n_queries = documents.count(), questions.count()
    wanted = min(MAX_PIVOTS, math.isqrt(n_documents) + 1)
    if n_queries <= wanted:
        return _best(documents.mapInArrow(_in_place(_sent(questions), k), CANDIDATES), k)
    pivots = _pivots(documents, wanted)
    dealt = stage(documents.mapInArrow(_assign(pivots), "doc_id long, vector array<double>, cell int, angle double, spread long"), "cells")
    # one row for each pivot at most, and one for the vectors without a score
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()
    some_undefined = any(row["cell"] is None for row in sizes)
    sizes = [row for row in sizes if row["cell"] is not None]
    undefined, dealt = dealt.where("cell IS NULL"), dealt.where("cell IS NOT NULL")
    counts, least, largest = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for row in sizes:
        counts[row["cell"]], least[row["cell"]], largest[row["cell"]] = row["n"], row["lo"], row["hi"]
    around = Cells(pivots, counts, least, largest)
    side = math.isqrt(n_documents * n_queries // (TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    side = max(side, LEAST_ROWS)
    groups = Groups.of(around, max(1, min(side, CELL_ROWS, CELL_NUMBERS // max(1, pivots.shape[1]))))
    cells = spark.sparkContext.broadcast((around, groups))
    number = spark.createDataFrame(
        [(c, int(groups.first[c]), int(groups.parts[c])) for c in range(len(pivots))], "cell int, first long, parts long"
    )
    held = dealt.join(F.broadcast(number), "cell").select(
        "cell", (F.col("first") + F.pmod("spread", "parts")).cast("int").alias("group"), "doc_id", "vector"
    )

    first = stage(questions.mapInArrow(_first_cells(cells, k), _ASKING), "first_cells")
    found = stage(_asked(first.where("cells IS NOT NULL"), held, cells, min(side, QUERY_ROWS), k), "first_found")
    floor = _best(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = first.where("cells IS NOT NULL").drop("floor").join(floor, "query_id", "left").mapInArrow(_other_cells(cells), _ASKING)
    second = stage(rest, "other_cells")
    found = found.unionAll(_asked(second, held, cells, min(side, QUERY_ROWS), k))
    # what has no score: all documents for a query without a vector, documents without one where others are too few
    smallest = lambda rows: [r["doc_id"] for r in rows.select("doc_id").distinct().orderBy("doc_id").limit(k).collect()]
    void = first.where("cells IS NULL").select("query_id")
    if not void.isEmpty():
        found = found.unionAll(_unscored(void, smallest(documents)))
    if some_undefined and dealt.select("doc_id").distinct().limit(k).count() < k:
        found = found.unionAll(_unscored(first.where("cells IS NOT NULL").select("query_id"), smallest(undefined)))
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_k_per_group(best, ["query_id"], [F.col("score").desc_nulls_last(), F.col("doc_id")], k)


def _unscored(queries: DataFrame, ids: list[int]) -> DataFrame:
    listed = F.array(*map(F.lit, ids)).cast("array<long>")
    return queries.select("query_id", F.explode(listed).alias("doc_id"), F.lit(None).cast("double").alias("score"))


def _sent(questions: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a few queries; rows of NaN for those without a vector."""
    rows = questions.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    ids, vectors = rows["query_id"].to_numpy(), rows["vector"]
    return ids, _unit_rows(vectors.combine_chunks()) if len(ids) else np.empty((0, 0))


def _in_place(queries: tuple[np.ndarray, np.ndarray], k: int):
    """(query_id, doc_id, score): the ``k`` best documents of a task for every query."""
    query_ids, asking = queries
    void = np.isnan(asking).any(axis=1) if asking.shape[1] else np.ones(len(asking), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(query_ids[~void], asking[~void], k)
        # the smallest ids of all documents, and of those without a score
        least = unscored = np.empty(0, np.int64)
        everyone = np.arange(len(best.query_ids))
        for whole in batches:
            for start in range(0, whole.num_rows, ASSIGN_ROWS):
                batch = whole.slice(start, ASSIGN_ROWS)
                ids, rows = batch.column("doc_id").to_numpy(), _unit_rows(batch.column("vector"))
                without = np.isnan(rows).any(axis=1) if rows.shape[1] else np.ones(len(rows), bool)
                if len(everyone) and not without.all():
                    if rows.shape[1] != asking.shape[1]:
                        raise ValueError("vectors differ in length")
                    rows = rows[~without]
                    best.add(everyone, ids[~without], rows, rows.astype(np.float32))
                least = np.unique(np.concatenate([least, ids]))[:k]
                unscored = np.unique(np.concatenate([unscored, ids[without]]))[:k]
        yield best.batch(None)
        for asked, held in ((query_ids[void], least), (query_ids[~void], unscored)):
            columns = [pa.array(np.repeat(asked, len(held))), pa.array(np.tile(held, len(asked))), pa.nulls(len(asked) * len(held), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "score"])

    return run


def _pivots(documents: DataFrame, wanted: int) -> np.ndarray:
    """Distinct unit vectors of a sample, that of the smallest hashes: at most ``wanted``."""
    sample = documents.where(F.size("vector") > 0).orderBy(F.xxhash64("doc_id", "vector")).select("vector").limit(wanted)
    rows = _unit_rows(sample.select(F.col("vector").cast("array<double>").alias("vector")).toArrow()["vector"].combine_chunks())
    rows = rows[~np.isnan(rows).any(axis=1)]
    return np.unique(rows, axis=0) if len(rows) else rows.reshape(0, 0)


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel(), pa.float64()))


def _assign(pivots: np.ndarray):
    """The nearest pivot of every document; no cell for those without a score. ``spread`` deals a cell's rows to its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for whole in batches:
            for start in range(0, whole.num_rows, ASSIGN_ROWS):
                batch = whole.slice(start, ASSIGN_ROWS)
                rows = _unit_rows(batch.column("vector"))
                void = np.isnan(rows).any(axis=1) if rows.shape[1] else np.ones(len(rows), bool)
                cell, cosine = np.zeros(len(rows), np.int32), np.zeros(len(rows))
                if not void.all():
                    scores = rows[~void] @ pivots.T
                    cell[~void] = scores.argmax(axis=1)
                    cosine[~void] = np.clip(scores.max(axis=1), -1, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), _lists(rows), pa.array(cell, mask=void), pa.array(np.arccos(cosine)),
                        pa.array(np.arange(done, done + len(rows))),
                    ],
                    names=["doc_id", "vector", "cell", "angle", "spread"],
                )
                done += len(rows)

    return run


def _asking(batch: pa.RecordBatch, rows: np.ndarray, floor: pa.Array, cells: list | pa.Array, groups: list) -> pa.RecordBatch:
    lists = pa.list_(pa.int32())
    columns = [batch.column("query_id"), _lists(rows), floor, pa.array(cells, lists), pa.array(groups, lists)]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vector", "floor", "cells", "groups"])


def _first_cells(cells: Broadcast, k: int):
    """Unit vectors of the queries, the cells they ask first and the groups of these; no lists for those without a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, groups = cells.value
        for whole in batches:
            for start in range(0, whole.num_rows, ASSIGN_ROWS):
                batch = whole.slice(start, ASSIGN_ROWS)
                rows = _unit_rows(batch.column("vector"))
                void = np.isnan(rows).any(axis=1) if rows.shape[1] else np.ones(len(rows), bool)
                if not len(around.pivots):
                    void[:] = True
                chosen: list = [None] * len(rows)
                held: list = [None] * len(rows)
                if not void.all():
                    for i, found in zip(np.flatnonzero(~void).tolist(), around.nearest(rows[~void], k)):
                        chosen[i], held[i] = found, groups.holding(found)
                yield _asking(batch, rows, pa.nulls(len(rows), pa.float64()), chosen, held)

    return run


def _other_cells(cells: Broadcast):
    """The score that a query has reached and the groups of cells that may still hold one of the best, less the cells
    already asked; queries without any are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, groups = cells.value
        for whole in batches:
            for start in range(0, whole.num_rows, ASSIGN_ROWS):
                batch = whole.slice(start, ASSIGN_ROWS)
                rows = _unit_rows(batch.column("vector"))
                floor = batch.column("floor").fill_null(UNDEFINED)
                asked = batch.column("cells").to_pylist()
                near = around.within(rows, floor.to_numpy(zero_copy_only=False))
                rest = [groups.holding(np.setdiff1d(n, a)) for n, a in zip(near, asked)]
                some = pa.array([len(r) > 0 for r in rest])
                yield _asking(batch, rows, floor, asked, rest).filter(some)

    return run


def _asked(asking: DataFrame, held: DataFrame, cells: Broadcast, query_rows: int, k: int) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best of each task for every query that asks its group."""
    spark = asking.sparkSession
    asks = asking.select("query_id", "vector", "floor", "cells", F.explode("groups").alias("group"))
    # one row for each group
    chunks = {r["group"]: -(-r["count"] // query_rows) for r in asking.select(F.explode("groups").alias("group")).groupBy("group").count().collect()}
    if not chunks:
        return spark.createDataFrame([], CANDIDATES)
    grid = F.broadcast(spark.createDataFrame(list(chunks.items()), "group int, chunks long"))
    questions = asks.join(grid, "group").select(
        "group", F.pmod(F.xxhash64("query_id"), "chunks").alias("chunk"), F.lit(1).alias("side"), F.lit(0).alias("cell"),
        F.col("query_id").alias("id"), "vector", "floor", "cells",
    )
    documents = held.join(grid, "group").select(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "cell",
        F.col("doc_id").alias("id"), "vector", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("array<int>").alias("cells"),
    )
    both = documents.unionAll(questions).withColumn("task", F.xxhash64("group", "chunk")).drop("group", "chunk")
    # enough partitions that few tasks share one
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * sum(chunks.values()))
    return both.repartition(n, "task").sortWithinPartitions("task", "side", "cell").mapInArrow(_scan(cells, k), CANDIDATES)


class _Held:
    """The vectors of a task, in the order of their cells."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.ids, cell, self.matrix = (np.concatenate(part) for part in zip(*rows))
        self.narrow = self.matrix.astype(np.float32)
        self.cells, starts = np.unique(cell, return_index=True)
        self.ends = np.append(starts, len(cell))

    def search(self, rows: pa.RecordBatch, around: Cells, k: int) -> pa.RecordBatch:
        asking, lists = _matrix(rows), rows.column("cells")
        floor = rows.column("floor").to_numpy(zero_copy_only=False)
        first = np.isnan(floor)  # asks the cells listed; the others ask those that are near, less the ones listed
        cell = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy())
        own = np.isin(cell, self.cells)
        wanted = np.zeros((len(rows), len(self.cells)), bool)
        wanted[row[own], np.searchsorted(self.cells, cell[own])] = True
        if not first.all():
            wanted = np.where(first[:, None], wanted, around.near(asking, floor, self.cells) & ~wanted)
        best = _Nearest(rows.column("id").to_numpy(), asking, k, np.where(first, -np.inf, floor))
        sizes = np.diff(self.ends)
        # more than is asked does no harm; small products of single cells take longer
        if 4 * (wanted @ sizes).sum() >= len(rows) * len(self.ids):
            best.add(np.arange(len(rows)), self.ids, self.matrix, self.narrow)
        else:
            for i, (start, end) in enumerate(zip(self.ends, self.ends[1:])):
                best.add(np.flatnonzero(wanted[:, i]), self.ids[start:end], self.matrix[start:end], self.narrow[start:end])
        return best.batch(None)


def _scan(cells: Broadcast, k: int):
    """A task's vectors are held, then its queries streamed past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, side = batch.column("task").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                rows = batch.slice(start, end - start)
                if at[start] != task:
                    task, parts, held = at[start], [], None
                if side[start] == 0:
                    parts.append((rows.column("id").to_numpy(), rows.column("cell").to_numpy(), _matrix(rows)))
                elif parts or held:
                    if held is None:
                        held, parts = _Held(parts), []
                    for lo in range(0, len(rows), QUERY_SLICE):
                        yield held.search(rows.slice(lo, QUERY_SLICE), cells.value[0], k)

    return run


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("vector").flatten().to_numpy().reshape(rows.num_rows, -1)


def recommend_postings(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = SEARCH_LIMIT,
    query_id: str = "query_id",
    posting_id: str = "job_post_id",
    vector: str = "vector",
) -> DataFrame:
    """Best postings per query; a posting scores as its most similar chunk."""
    best = dense_topk(queries, chunks, k, query_id, posting_id, vector)
    return best.withColumnRenamed("doc_id", posting_id)


def upsert_points(current: DataFrame, incoming: DataFrame, key: str = "id", latest: str | None = None) -> DataFrame:
    """Incoming points replace current ones of the same id.

    Of incoming points with the same id the one with the largest ``latest`` stays; without that column, the one with
    the largest hash, so the result does not depend on how rows are dealt out.
    """
    newest = F.col(latest) if latest else F.xxhash64(*incoming.columns)
    incoming = top_k_per_group(incoming, [key], [newest.desc()], 1, "_place").drop("_place")
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)
