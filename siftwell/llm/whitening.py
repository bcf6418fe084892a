"""Embedding whitening by incremental eigendecomposition."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.spectra import Spectrum
from siftwell.session import stage, unstage

COMPONENTS = 16
#: Entries become whole numbers: floor(SCALE * entry) + SHIFT, with entries beyond LARGEST / SCALE counting as that.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
#: Spectra that one task combines.
FAN_IN = 16
#: A component is one if its share of the variance is above this.
LEAST_SHARE = 1e-13

_STATE = "slot long, n long, mean array<double>, values array<double>, basis array<double>"


@dataclass(frozen=True)
class Whitening:
    """Axes (columns, by falling eigenvalue) of the vectors fitted; ``sums`` are exact."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with whole numbers subtracted first."""
        base = [s // self.n for s in self.sums]
        rest = np.array([(s - b * self.n) / self.n for s, b in zip(self.sums, base)])
        return (x - np.array(base, dtype=np.int64)) - rest

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with ``x``, the vector as whole numbers; without rows whose vector is null, empty, or holds a null or non-finite entry."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = lambda c: F.least(F.greatest(c * SCALE, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    x = F.transform(entries, lambda c: F.floor(bound(c)).cast("long") + SHIFT)
    # a null entry makes the test null or false, never true
    return df.where((F.size(entries) > 0) & sound).withColumn("x", x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _states(spectra: list[tuple[int, Spectrum]]) -> pa.RecordBatch:
    columns = [
        pa.array([slot for slot, _ in spectra], pa.int64()),
        pa.array([s.n for _, s in spectra], pa.int64()),
        *(pa.array([getattr(s, c).ravel() for _, s in spectra], pa.list_(pa.float64())) for c in ("mean", "values", "basis")),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["slot", "n", "mean", "values", "basis"])


def _spectrum(state: dict) -> Spectrum:
    size = len(state["mean"])
    parts = [np.array(state[c]) for c in ("mean", "values", "basis")]
    return Spectrum(state["n"], parts[0], parts[1], parts[2].reshape(size, size))


def _fit_partition(centre: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectrum = Spectrum.empty(len(centre.sums))
        for batch in batches:
            for point in centre.centred(_matrix(batch.column("x"))):
                spectrum.add_point(point)
        if spectrum.n:
            yield _states([(TaskContext.get().partitionId(), spectrum)])

    return run


def _combine(size: int):
    """States come sorted by slot; those of a group of ``FAN_IN`` slots become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, spectrum = None, None
        for batch in batches:
            for state in batch.to_pylist():
                if slot is not None and state["slot"] // FAN_IN != slot:
                    yield _states([(slot, spectrum)])
                    slot = None
                if slot is None:
                    slot, spectrum = state["slot"] // FAN_IN, Spectrum.empty(size)
                spectrum.merge(_spectrum(state))
        if slot is not None:
            yield _states([(slot, spectrum)])

    return run


def _products(fit: DataFrame, project) -> np.ndarray:
    """Sum of the outer products of the projections of all rows: each task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            y = project(_matrix(batch.column("x")))
            total = total + y.T @ y
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "value"]
            )

    cells = fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    # as many rows as the matrix has entries
    found = cells.orderBy("cell").collect()
    size = math.isqrt(len(found))
    return np.array([r["value"] for r in found]).reshape(size, size)


def _sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = _matrix(batch.column("x")).sum(axis=0)  # below 2 ** 63, since a batch has far fewer than 2 ** 22 rows
                columns = [pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array([batch.num_rows] * len(total), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["entry", "total", "n"])

    sums = fit.mapInArrow(run, "entry int, total long, n long").groupBy("entry")
    found = sums.agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).orderBy("entry").collect()
    return (found[0]["n"] if found else 0), tuple(int(r["total"]) for r in found)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Axes of the rows of ``fit`` (x, staged, all of one length), or None if nothing varies.

    Each partition brings its own spectrum up to date by a centred rank-one update for every row: roots of the secular
    equation after deflation. Spectra are combined, ``FAN_IN`` at a time on the executors, by successive rank-one updates.
    On the basis found, made orthonormal, one pass over all rows gives the projected covariance, whose eigenvectors (a
    matrix as wide as a vector) turn the basis into the axes: Rayleigh-Ritz, to working precision.
    """
    n, sums = _sums(fit)
    if not n:
        return None
    size = len(sums)
    start = Whitening(n, sums, np.ones(size), np.eye(size), 1.0)
    states = stage(fit.mapInArrow(_fit_partition(start), _STATE), "spectra")
    last = states.agg(F.max("slot").alias("slot")).first()["slot"]
    while last:
        tasks = max(1, min(last // FAN_IN + 1, int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        dealt = states.repartition(tasks, F.floor(F.col("slot") / FAN_IN)).sortWithinPartitions("slot")
        combined = stage(dealt.mapInArrow(_combine(size), _STATE), "spectra")
        unstage(states)
        states, last = combined, last // FAN_IN
    # one row of a spectrum
    spectrum = _spectrum(states.first().asDict())
    unstage(states)
    basis, _ = np.linalg.qr(spectrum.basis[:, ::-1])
    projected = _products(fit, lambda x: start.centred(x) @ basis) / n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    kept = [i for i in range(min(components, size)) if values[i] > LEAST_SHARE * trace]
    return Whitening(n, sums, values[kept], axes[:, kept], trace) if kept else None


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component, from 1.

    A vector is null, empty, or holds a null or non-finite entry: its row is left out, as is one whose length is not the
    most frequent one (of equally frequent ones the largest). Entries become whole numbers; every distinct vector counts
    once (``n`` of them) for the covariance, whose unit eigenvectors by falling eigenvalue are the components. ``deviation``
    is the exact sum of (n x - S)^2, null if it passes 64 bits; ``whitened`` the centred vector on the component over the
    square root of its eigenvalue; ``explained`` the eigenvalue's share; ``identity_error`` the largest entry of the
    whitened vectors' covariance less the identity, measured over all distinct vectors.

    At most ``components`` components are given, and none whose share of the variance is not above rounding, so an empty
    table, a single vector or equal ones give no row. Rows with the same id or vector are rows of their own; other columns
    are left out, whatever they are called.
    """
    own = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    own = whole_vectors(own, "vector").select("vec_id", "x")
    lengths = own.groupBy(F.size("x").alias("size")).count()
    widest = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    kind = own.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if widest is None:
        return df.sparkSession.createDataFrame([], schema)
    own = own.where(F.size("x") == widest["size"])
    fit = stage(own.select("x").distinct(), "distinct_vectors")
    model = fit_whitening(fit, components)
    if model is None:
        unstage(fit)
        return df.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    error = float(np.abs(_products(fit, model.apply) / model.n - np.eye(k)).max())
    unstage(fit)
    explained = model.values / model.trace
    sums = np.array(model.sums, dtype=object)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x, m = _matrix(batch.column("x")), min(4096, whole.num_rows - start)
                near = (np.square(model.n * model.centred(x))).sum(axis=1)
                if near.max() < 2**62 and max(map(abs, model.sums)) < 2**62:
                    away = model.n * x - sums.astype(np.int64)
                    deviation = pa.array((away * away).sum(axis=1))
                else:
                    exact = [sum(int(d) ** 2 for d in model.n * row.astype(object) - sums) for row in x]
                    deviation = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.n)), deviation.take(at), pa.array(model.apply(x).ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(rows, schema)
