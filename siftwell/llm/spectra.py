"""Eigendecompositions kept up to date by rank-one changes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = float(np.finfo(float).eps)


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(pole, offset) of the roots of 1 + rho * sum(z2 / (d - t)), one above each of the rising ``d``.

    A root is kept as its distance from the nearer pole, so differences to all poles stay exact. Each step puts a rational
    function with the two neighbouring poles through value and slopes; where it leaves the bracket, the bracket is halved.
    """
    k = len(d)
    each = np.arange(k)
    ends = np.append(d, d[-1] + rho * z2.sum())
    gap = np.diff(ends)
    middle = gap / 2
    at_middle = 1 / rho + (z2[:, None] / ((d[:, None] - d) - middle)).sum(axis=0)
    low_half = at_middle > 0
    pole = np.where(low_half | (each == k - 1), each, each + 1)
    lo = np.where(low_half, 0.0, np.where(each == k - 1, middle, -middle))
    hi = np.where(low_half, middle, np.where(each == k - 1, gap, 0.0))
    delta = d[:, None] - d[pole]
    before, after = d - d[pole], ends[1:] - d[pole]
    below = each[:, None] <= each
    mu = (lo + hi) / 2
    for _ in range(120):
        diff = delta - mu
        terms = z2[:, None] / diff
        f = 1 / rho + terms.sum(axis=0)
        size = 1 / rho + np.abs(terms).sum(axis=0)
        done = (np.abs(f) <= _EPS * size) | (hi - lo <= 2 * _EPS * np.abs(mu))
        if done.all():
            break
        lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
        slopes = terms / diff
        left = (slopes * below).sum(axis=0)
        right = slopes.sum(axis=0) - left
        one, two = before - mu, after - mu
        c = f - one * left - two * right
        a = (one + two) * f - one * two * (left + right)
        b = one * two * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = mu + step
        mu = np.where(done, mu, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return pole, mu


@dataclass
class Spectrum:
    """Eigenvalues (rising) and eigenvectors (columns) of the scatter of ``n`` points around their mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add_point(self, point: np.ndarray) -> None:
        """Centred update: the distance from the mean so far, weighted n / (n + 1)."""
        away = point - self.mean
        if self.n:
            self.add_outer(away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """The scatter of both: one update for each direction of the other, and one between the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.add_outer(vector, float(value))
        n = self.n + other.n
        away = other.mean - self.mean
        self.add_outer(away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n = n

    def add_outer(self, vector: np.ndarray, weight: float) -> None:
        """Adds weight * vector vector^T: eigenvalues from the secular equation, after deflation.

        Directions that the vector has no part in stay; of two values that are equal to working precision, a rotation turns
        the vector's part into one of their directions. Vectors follow from weights that the computed roots solve exactly,
        so they are orthogonal to working precision.
        """
        length = float(vector @ vector)
        rho = weight * length
        if not rho > 0:
            return
        z = (self.basis.T @ vector) / np.sqrt(length)
        d = self.values
        small = 8 * _EPS * max(float(np.abs(d).max()), rho)
        live = np.flatnonzero(rho * np.abs(z) > small)
        if not len(live):
            return
        live = self._merged_equal(z, live, small)
        d, z2, k = self.values[live], z[live] ** 2, len(live)
        pole, mu = _roots(d, z2, rho)
        diff = (d[:, None] - d[pole]) - mu
        # weights for which the roots are exact: products of ratios of like size
        each = np.arange(k)
        other = np.where(each[None, :] < each[:, None], d[None, :] - d[:, None], np.append(d[1:], 0.0)[None, :] - d[:, None])
        other[:, -1] = 1.0  # the last root has no pole above it
        weights = np.sqrt(np.abs(np.prod(-diff / other, axis=1) / rho))
        vectors = np.copysign(weights, z[live])[:, None] / diff
        vectors /= np.linalg.norm(vectors, axis=0)
        self.basis[:, live] = self.basis[:, live] @ vectors
        self.values[live] = d[pole] + mu
        order = np.argsort(self.values, kind="stable")
        self.values, self.basis = self.values[order], self.basis[:, order]

    def _merged_equal(self, z: np.ndarray, live: np.ndarray, small: float) -> np.ndarray:
        d = self.values
        gap, p, q = np.diff(d[live]), z[live[:-1]], z[live[1:]]
        if not (np.abs(gap * p * q) <= small * (p * p + q * q)).any():
            return live
        kept = [int(live[0])]
        for j in live[1:].tolist():
            i = kept[-1]
            tau = float(np.hypot(z[i], z[j]))
            c, s = z[j] / tau, z[i] / tau
            if abs((d[j] - d[i]) * c * s) > small:
                kept.append(j)
                continue
            z[j], z[i] = tau, 0.0
            a, b = self.basis[:, i].copy(), self.basis[:, j].copy()
            self.basis[:, j], self.basis[:, i] = s * a + c * b, c * a - s * b
            d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
            kept[-1] = j
        return np.array(kept)
