import math

import numpy as np
import pytest

from siftwell.llm import whitening as W
from siftwell.llm.spectra import Spectrum


def by_hand(rows, components=16):
    """Rows and components from plain integers and a direct solver."""
    clean = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in clean}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums // n) - (sums % n) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(sums))
    found = {}
    for i, x in clean:
        x = np.array(x)
        away = [n * int(a) - int(s) for a, s in zip(x, sums)]
        white = ((x - sums // n) - (sums % n) / n) @ axes[:, :k] / np.sqrt(values[:k])
        found[i] = (n, sum(a * a for a in away), white, values[:k] / values.sum())
    return found


def check(rows, got, components=16):
    want = by_hand(rows, components)
    per_id = {}
    for r in got:
        per_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert per_id.keys() == want.keys()
    signs = {}
    for i, (n, deviation, white, explained) in want.items():
        assert sorted(per_id[i]) == list(range(1, len(white) + 1))
        for c, r in per_id[i].items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            assert r["identity_error"] < 1e-9
            if abs(white[c - 1]) > 0.1:  # either sign, the same for all rows
                sign = signs.setdefault(c, math.copysign(1, r["whitened"] * white[c - 1]))
                assert r["whitened"] == pytest.approx(sign * white[c - 1], rel=1e-6, abs=1e-7)


def vectors(seed, n, size, spread):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, size)) * np.linspace(1, spread, size)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(n + i, rows[i % 7][1]) for i in range(n // 3)]  # a third are copies of a few
    return rows


@pytest.mark.parametrize("seed, n, size, spread", [(1, 300, 20, 6), (2, 400, 5, 3), (3, 900, 64, 4)])
def test_equals_a_direct_solver(spark, seed, n, size, spread):
    rows = vectors(seed, n, size, spread)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    check(rows, W.whiten(frame).collect())


def test_spectra_are_combined_in_levels(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 2)
    rows = vectors(4, 200, 8, 5)
    frame = spark.createDataFrame([(W_x(v),) for _, v in rows], "x array<long>").distinct().repartition(6)
    fit = W.stage(frame, "fit")
    model = W.fit_whitening(fit, 8)
    x = np.array(sorted({tuple(W_x(v)) for _, v in rows}))
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert model.n == len(x) and model.sums == tuple(int(s) for s in x.sum(axis=0))
    assert np.allclose(model.values, values, rtol=1e-10)
    assert np.allclose(model.axes.T @ model.axes, np.eye(8), atol=1e-13)


def W_x(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


CASES = {
    "one entry": np.random.default_rng(0).normal(size=(30, 1)),
    "fewer points than entries": np.random.default_rng(1).normal(size=(4, 9)),
    "equal points": np.repeat(np.random.default_rng(2).normal(size=(20, 7)), 3, axis=0),
    "equal eigenvalues": np.concatenate([np.eye(8), -np.eye(8)] * 3),
    "two directions": np.random.default_rng(3).normal(size=(60, 2)) @ np.random.default_rng(4).normal(size=(2, 8)),
    "whole numbers": np.random.default_rng(5).integers(0, 2, (70, 6)).astype(float),
    "far from zero": np.random.default_rng(6).normal(size=(200, 12)) + 1e6,
    "wide range": np.random.default_rng(7).normal(size=(150, 16)) * np.logspace(-5, 5, 16),
    "one point": np.ones((1, 5)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("parts", [1, 3])
def test_spectrum_equals_the_scatter(name, parts):
    x = CASES[name]
    spectrum = Spectrum.empty(x.shape[1])
    for part in np.array_split(x, parts):
        own = Spectrum.empty(x.shape[1])
        for point in part:
            own.add_point(point)
        spectrum.merge(own)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    size = max(np.abs(scatter).max(), 1e-12)
    assert spectrum.n == len(x) and np.allclose(spectrum.mean, x.mean(axis=0), rtol=1e-9)
    assert np.abs((spectrum.basis * spectrum.values) @ spectrum.basis.T - scatter).max() < 1e-9 * size + 1e-12 * np.abs(x).max() ** 2
    assert np.abs(spectrum.basis.T @ spectrum.basis - np.eye(x.shape[1])).max() < 1e-11
    assert (np.diff(spectrum.values) >= 0).all()


def test_deflation_leaves_untouched_directions():
    spectrum = Spectrum(1, np.zeros(4), np.array([1.0, 2.0, 2.0, 5.0]), np.eye(4))
    spectrum.add_outer(np.array([0.0, 3.0, 4.0, 0.0]), 0.5)
    assert np.allclose(spectrum.values, [1, 2, 5, 2 + 12.5])
    assert np.allclose(np.abs(spectrum.basis[:, 3]), [0, 0.6, 0.8, 0]) and np.allclose(np.abs(spectrum.basis[:, 0]), [1, 0, 0, 0])


def test_large_deviations(spark):
    rows = [(i, [float(2 ** (25 + i)), float(i)]) for i in range(6)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = by_hand(rows)
    for r in got:
        assert r["deviation"] == (want[r["vec_id"]][1] if want[r["vec_id"]][1] < 2**63 else None)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(i, [0.1 * i, (i * i) % 7 / 3.0, (i * 5) % 11 / 2.0]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 2.0]), (104, [1.0, -inf, 2.0]), (105, [1.0, 2.0])]
    names = "vec_id long, embedding array<double>, x string, n int, component string, size int, slot int"
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in sound + odd + [(0, sound[0][1])]], names)
    got = W.whiten(frame).collect()
    assert len(got) == 41 * 3
    check(sound, [r for r in got if r["vec_id"] != 0] + [r for r in got if r["vec_id"] == 0][:3])
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert len(W.whiten(huge).collect()) in (3, 6)
    for few in (frame.where("false"), frame.where("vec_id >= 100"), frame.where("vec_id = 0"), frame.where("vec_id = 102")):
        assert W.whiten(few).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in W.whiten(line).collect()} == {1}


def test_query_over_the_whole_table(spark, data):
    from siftwell.llm.queries import QUERIES, table

    rows = [(r["vec_id"], list(r["embedding"])) for r in table(spark, data, "embeddings").collect()]
    check(rows, QUERIES["op11_whitening"](spark, data).collect())
