"""Local regression on NumPy arrays: the kernel that every physical plan runs inside Arrow batches.

Everything is vectorised over queries: neighbours come as index matrices, and local fits are solved as
stacks of small normal equations. Nothing here imports Spark.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from driftline import errors as E
from driftline.config import CrossValidation, SmootherConfig

EPS = float(np.finfo(np.float64).eps)
#: Elements of the largest temporary array of a stack of fits.
BLOCK = 2_000_000
#: Neighbours of all queries together that are kept between iterations; beyond, they are found again block by block.
KEPT = 8_000_000


# --- spans, kernels, distances -----------------------------------------------------------------------


def span(n: int, fraction: float) -> int:
    """Points of a neighbourhood: the fraction of n, at least 2."""
    return max(2, min(n, int(fraction * n + 1e-5)))


def kernel(name: str, u: np.ndarray) -> np.ndarray:
    """Weights at scaled distances ``u``; bounded kernels are 0 from 1 on."""
    u = np.abs(u)
    if name == "gaussian":
        return np.maximum(np.where(u > 6, 0.0, np.exp(-0.5 * u * u)), np.finfo(np.float64).tiny)
    inside = {
        "cosine": lambda: np.cos(np.pi * u / 2),
        "epanechnikov": lambda: 1 - u * u,
        "biweight": lambda: (1 - u * u) ** 2,
        "triangle": lambda: 1 - u,
        "tricube": lambda: (1 - u * u * u) ** 3,
        "uniform": lambda: np.ones_like(u),
    }[name]()
    return np.where(u < 1, inside, 0.0)


#: Kernels that are polynomials of the scaled distance and vanish at 1: coefficients by power.
POLYNOMIALS = {"tricube": {0: 1, 3: -3, 6: 3, 9: -1}, "epanechnikov": {0: 1, 2: -1}, "biweight": {0: 1, 2: -2, 4: 1}, "triangle": {0: 1, 1: -1}}


def scales_of(x: np.ndarray) -> np.ndarray:
    """Per dimension 1 / range, or 1 where all values are equal."""
    width = x.max(axis=0) - x.min(axis=0)
    return np.where(width > 0, 1 / np.where(width > 0, width, 1), 1.0)


def distances(points: np.ndarray, queries: np.ndarray, c: SmootherConfig, scales: np.ndarray) -> np.ndarray:
    """Matrix of distances, queries by points."""
    gap = np.abs(queries[:, None, :] - points[None, :, :])
    metric = c.distance_metric
    if metric == "minkowski" and abs(c.minkowski_p - 1) < EPS:
        metric = "manhattan"
    if metric == "normalized":
        return np.sqrt(((gap * scales) ** 2).sum(axis=2))
    if metric == "manhattan":
        return gap.sum(axis=2)
    if metric == "chebyshev":
        return gap.max(axis=2)
    if metric == "weighted":
        return np.sqrt((gap**2 * np.asarray(c.metric_weights)).sum(axis=2))
    if metric == "minkowski" and abs(c.minkowski_p - 2) >= EPS:
        return (gap**c.minkowski_p).sum(axis=2) ** (1 / c.minkowski_p)
    return np.sqrt((gap**2).sum(axis=2))


class Neighbours:
    """Nearest points of any query; of points equally far the one with the lower index is nearer."""

    def __init__(self, points: np.ndarray, c: SmootherConfig, scales: np.ndarray):
        self.points, self.c, self.scales = points, c, scales
        self.order = np.argsort(points[:, 0], kind="stable") if points.shape[1] == 1 else None
        self.line = None if self.order is None else points[self.order, 0]
        self.factor = scales[0] if c.distance_metric == "normalized" else math.sqrt(c.metric_weights[0]) if c.distance_metric == "weighted" else 1.0

    def find(self, queries: np.ndarray, q: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of the ``q`` nearest, one row per query; ``skip`` has the point that each query leaves out."""
        if skip is not None:
            index, gap = self.find(queries, min(q + 1, len(self.points)))
            far = np.where(index == skip[:, None], np.inf, gap)
            out = np.arange(index.shape[1]) != far.shape[1] - 1 - far[:, ::-1].argmax(axis=1)[:, None]  # the last of the farthest
            return index[out].reshape(len(queries), -1), gap[out].reshape(len(queries), -1)
        q = min(q, len(self.points))
        if self.order is None:
            return self._by_blocks(queries, q)
        v = queries[:, 0]
        index = self.order[self.stretch(v, q)[:, None] + np.arange(q)]
        return index, np.abs(self.points[index, 0] - v[:, None]) * self.factor

    def stretch(self, v: np.ndarray, q: int, gone: np.ndarray | None = None) -> np.ndarray:
        """Where on the line the ``q`` nearest points of each place begin; ``gone`` has the point of the line that each leaves out, which is not counted."""
        seen = (lambda k: k) if gone is None else (lambda k: k + (k >= gone))
        x, last = self.line, len(self.line) - 1 - (gone is not None)
        low, high = np.zeros(len(v), np.int64), np.full(len(v), last + 1 - q, np.int64)
        while (low < high).any():  # leftmost stretch whose left end is no farther than the point after its right end
            middle = (low + high) // 2
            right = np.minimum(middle + q, last)
            go = (low < high) & (v - x[seen(middle)] > x[seen(right)] - v)
            low, high = np.where(go, middle + 1, low), np.where(go, high, np.where(low < high, middle, high))
        return low

    def _by_blocks(self, queries: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, BLOCK // (len(self.points) * self.points.shape[1]))
        index, gap = [], []
        for k in range(0, len(queries), step):
            d = distances(self.points, queries[k : k + step], self.c, self.scales)
            if q < d.shape[1]:
                reach = np.partition(d, q - 1, axis=1)[:, q - 1 : q]
                closer = d < reach
                level = d == reach
                room = q - closer.sum(axis=1, keepdims=True)
                chosen = closer | (level & (np.cumsum(level, axis=1) <= room))
                near = np.nonzero(chosen)[1].reshape(len(d), q)
            else:
                near = np.tile(np.arange(q), (len(d), 1))
            index.append(near), gap.append(np.take_along_axis(d, near, axis=1))
        return np.concatenate(index), np.concatenate(gap)


# --- boundary padding --------------------------------------------------------------------------------


def pad(x: np.ndarray, y: np.ndarray, policy: str, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points with artificial ones beyond the ends, and for each the row whose robustness weight it takes."""
    n, d = x.shape
    rows = np.arange(n)
    if policy == "none" or n < 2 or (d > 1 and policy == "extend"):
        return x, y, rows
    if d > 1:
        return _pad_planes(x, y, policy, max(1, min(q // 2, n // 2)))
    k = min(q // 2, n - 1)
    if k == 0:
        return x, y, rows
    steps = np.arange(1, k + 1)
    if policy == "reflect":
        head, tail = 2 * x[0, 0] - x[steps, 0], 2 * x[-1, 0] - x[n - 1 - steps, 0]
        head_y, tail_y = y[steps], y[n - 1 - steps]
    else:
        head, tail = x[0, 0] - steps * (x[1, 0] - x[0, 0]), x[-1, 0] + steps * (x[-1, 0] - x[-2, 0])
        zero = policy == "zero"
        head_y, tail_y = np.full(k, 0.0 if zero else y[0]), np.full(k, 0.0 if zero else y[-1])
    return np.r_[head[::-1], x[:, 0], tail][:, None], np.r_[head_y[::-1], y, tail_y], np.r_[np.zeros(k, np.int64), rows, np.full(k, n - 1)]


def _pad_planes(x: np.ndarray, y: np.ndarray, policy: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mirror the outermost points of each dimension across its extreme planes."""
    px, py, source = [x], [y], [np.arange(len(x))]
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        for chosen, plane in ((order[:k], x[order[0], j]), (order[len(order) - k :], x[order[-1], j])):
            chosen = chosen[np.abs(x[chosen, j] - plane) > EPS]
            mirrored = x[chosen].copy()
            mirrored[:, j] = 2 * plane - mirrored[:, j]
            px.append(mirrored), py.append(np.zeros(len(chosen)) if policy == "zero" else y[chosen]), source.append(chosen)
    return np.concatenate(px), np.concatenate(py), np.concatenate(source)


# --- local fits --------------------------------------------------------------------------------------


def monomials(dimensions: int, degree: int) -> list[tuple[int, ...]]:
    """Dimensions multiplied in each term, by total degree and then lexicographically."""
    return [t for k in range(degree + 1) for t in itertools.combinations_with_replacement(range(dimensions), k)]


def basis(offset: np.ndarray, degree: int) -> np.ndarray:
    """Centred monomials along a new last axis."""
    one = np.ones(offset.shape[:-1])
    return np.stack([np.prod([offset[..., k] for k in t], axis=0) if t else one for t in monomials(offset.shape[-1], degree)], axis=-1)


def solve(normal: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and first diagonal element of the inverse, for a stack of equilibrated normal equations.

    Singular ones get the least-norm solution with an absolute cut-off of 100 epsilon.
    """
    diagonal = np.diagonal(normal, axis1=1, axis2=2)
    scale = np.where(diagonal > EPS, 1 / np.sqrt(np.where(diagonal > EPS, diagonal, 1)), 1.0)
    a = normal * scale[:, :, None] * scale[:, None, :]
    b = right * scale
    beta, lever = np.empty_like(b), np.empty(len(b))
    sound = _least_eigenvalue(a) > 1e-9
    if sound.any():
        first = np.zeros_like(b[sound])
        first[:, 0] = 1
        both = np.linalg.solve(a[sound], np.stack([b[sound], first], axis=-1))
        beta[sound], lever[sound] = both[..., 0], both[:, 0, 1]
    if not sound.all():
        values, vectors = np.linalg.eigh(a[~sound])
        inverse = np.where(values > 100 * EPS, 1 / np.where(values > 100 * EPS, values, 1), 0.0)
        inner = np.matmul(vectors.transpose(0, 2, 1), b[~sound][..., None])[..., 0] * inverse
        beta[~sound] = np.matmul(vectors, inner[..., None])[..., 0]
        lever[~sound] = (vectors[:, 0, :] ** 2 * inverse).sum(axis=1)
    return beta * scale, lever * scale[:, 0] ** 2


def _least_eigenvalue(a: np.ndarray) -> np.ndarray:
    """The least eigenvalues of a stack of symmetric matrices; those of one and two rows in closed form."""
    if a.shape[1] == 1:
        return a[:, 0, 0]
    if a.shape[1] == 2:
        middle, half = (a[:, 0, 0] + a[:, 1, 1]) / 2, (a[:, 0, 0] - a[:, 1, 1]) / 2
        return middle - np.hypot(half, a[:, 0, 1])
    return np.linalg.eigvalsh(a)[:, 0]


@dataclass
class LocalFits:
    """Neighbourhoods of some queries with their kernel weights, to be fitted under changing robustness."""

    points: np.ndarray
    y: np.ndarray
    queries: np.ndarray
    index: np.ndarray
    gap: np.ndarray
    config: SmootherConfig
    reach: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.reach = self.gap.max(axis=1)
        weigh = self.config.custom_weight or (lambda u: kernel(self.config.weight_function, u))
        self.weight = weigh(self.gap / np.where(self.reach > EPS, self.reach, 1.0)[:, None])

    def subset(self, use: np.ndarray) -> LocalFits:
        """The fits of some of the queries, with the weights that they have."""
        out = copy.copy(self)
        out.queries, out.index, out.gap, out.reach, out.weight = (x[use] for x in (self.queries, self.index, self.gap, self.reach, self.weight))
        return out

    def weighted_mean(self, robust: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted means (plain ones where all weights vanish) and the sums of weights."""
        w = self.weight * robust[self.index]
        total = w.sum(axis=1)
        near = self.y[self.index]
        mean = (w * near).sum(axis=1) / np.where(total > EPS, total, 1)
        return np.where(total > EPS, mean, near.mean(axis=1)), total

    def coefficients(self, robust: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the local polynomials and their leverages, regardless of degenerate cases."""
        terms = len(monomials(self.points.shape[1], degree))
        beta, lever = np.zeros((len(self.queries), terms)), np.zeros(len(self.queries))
        step = max(1, BLOCK // (self.index.shape[1] * terms))
        for k in range(0, len(self.queries), step):
            part = slice(k, k + step)
            w = self.weight[part] * robust[self.index[part]]
            w = np.where(w > EPS, w, 0.0)
            b = basis(self.points[self.index[part]] - self.queries[part, None, :], degree)
            wb = b * w[..., None]
            turned = wb.transpose(0, 2, 1)
            beta[part], lever[part] = solve(np.matmul(turned, b), np.matmul(turned, self.y[self.index[part]][..., None])[..., 0])
        return beta, lever

    def values(self, robust: np.ndarray, own: np.ndarray, fallback: str) -> tuple[np.ndarray, np.ndarray]:
        """Fitted values and leverages; ``own`` is the response of each query for the fallback."""
        mean, total = self.weighted_mean(robust)
        lone = np.where(total > EPS, 1 / np.where(total > EPS, total, 1), 0.0)
        degree = self.config.degree
        flat = (self.reach <= EPS) | (degree == 0) | (self.index.shape[1] < self.config.coefficients)
        vanished = (total <= EPS) & (self.reach > EPS) & (degree > 0)
        value, lever = mean.copy(), lone.copy()
        if not flat.all():
            beta, own_lever = self.coefficients(robust, degree)
            value[~flat], lever[~flat] = beta[~flat, 0], own_lever[~flat]
        instead = self.y[self.index].mean(axis=1) if fallback == "use_local_mean" else own
        return np.where(vanished, instead, value), np.where(vanished, 0.0, lever)

    def vertices(self, robust: np.ndarray, linear: np.ndarray) -> np.ndarray:
        """Values and first derivatives at surface vertices; ``linear`` marks those fitted with degree 1 at most."""
        d, degree = self.points.shape[1], self.config.degree
        mean, total = self.weighted_mean(robust)
        out = np.zeros((len(self.queries), d + 1))
        out[:, 0] = mean
        fit = (self.reach > EPS) & (degree > 0)
        if not self.config.compat and self.config.zero_weight_fallback == "use_local_mean":
            fit &= total > EPS
        for deg, use in ((degree, fit & ~linear), (min(1, degree), fit & linear)):
            if use.any():
                sub = self if use.all() else self.subset(use)
                out[use] = sub.coefficients(robust, deg)[0][:, : d + 1]
        return out


class BlockwiseFits:
    """The values of ``LocalFits`` for so many queries that their neighbours are found, used and forgotten in blocks."""

    def __init__(self, points: np.ndarray, y: np.ndarray, queries: np.ndarray, neighbours: Neighbours, q: int, config: SmootherConfig, skip: np.ndarray | None = None):
        self.points, self.y, self.queries, self.neighbours, self.q, self.config, self.skip = points, y, queries, neighbours, q, config, skip
        self.step = max(1, BLOCK // min(q, len(points)))

    def values(self, robust: np.ndarray, own: np.ndarray, fallback: str) -> tuple[np.ndarray, np.ndarray]:
        value, lever = np.empty(len(self.queries)), np.empty(len(self.queries))
        for k in range(0, len(self.queries), self.step):
            part = slice(k, k + self.step)
            near = self.neighbours.find(self.queries[part], self.q, None if self.skip is None else self.skip[part])
            fits = LocalFits(self.points, self.y, self.queries[part], *near, self.config)
            value[part], lever[part] = fits.values(robust, own[part], fallback)
        return value, lever


class Moments:
    """Moments of the points of a line about the middles of nested stretches, from which kernel-weighted sums over any stretch follow.

    Every stretch within a neighbourhood is shorter than its reach, so that no power exceeds 1 and nothing cancels.
    """

    LEAF = 16

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, name: str, degree: int):
        self.x, self.y, self.weight, self.name, self.degree = x, y, weight, name, degree
        size = max(POLYNOMIALS[name]) + 2 * degree + 1
        self.shift = np.zeros((2 * degree + 1, size, size))  # by power k: from powers of the middle to the Taylor coefficients of kernel(a) * a**k there
        for k, (power, factor) in itertools.product(range(2 * degree + 1), POLYNOMIALS[name].items()):
            for m in range(power + k + 1):
                self.shift[k, power + k - m, m] += factor * math.comb(power + k, m)
        self.levels = []
        length = self.LEAF
        while length <= len(x):
            starts = np.arange(0, len(x), length)
            ends = np.minimum(starts + length, len(x)) - 1
            middle, half = (x[starts] + x[ends]) / 2, (x[ends] - x[starts]) / 2
            own = np.arange(len(x)) // length
            t = (x - middle[own]) / np.where(half > 0, half, 1)[own]
            plain, times_y, power = np.empty((len(starts), size)), np.empty((len(starts), size)), weight
            for m in range(size):
                plain[:, m], times_y[:, m] = np.add.reduceat(power, starts), np.add.reduceat(power * y, starts)
                power = power * t
            self.levels.append((middle, half, plain, times_y))
            length *= 2

    def sums(self, v: np.ndarray, reach: np.ndarray, side: int, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of kernel(a) * a**k and, for half of the powers, of kernel(a) * a**k * y; a is the distance of points first to end - 1, all on one ``side``, by the reach."""
        out, out_y = np.zeros((len(v), 2 * self.degree + 1)), np.zeros((len(v), self.degree + 1))
        low, high = -(-first // self.LEAF), end // self.LEAF
        for start, stop in ((first, np.minimum(low * self.LEAF, end)), (np.where(low <= high, np.maximum(high * self.LEAF, first), end), end)):
            row = start[:, None] + np.arange(self.LEAF)
            inside = row < stop[:, None]
            row = np.where(inside, row, 0)
            a = np.where(inside, side * (self.x[row] - v[:, None]) / reach[:, None], 1.0)
            w = kernel(self.name, a) * self.weight[row]
            for k in range(2 * self.degree + 1):
                out[:, k] += w.sum(axis=1)
                if k <= self.degree:
                    out_y[:, k] += (w * self.y[row]).sum(axis=1)
                w = w * a
        for middle, half, plain, times_y in self.levels:
            if not (low < high).any():
                break
            for left in (True, False):  # stretches that are no half of a longer one inside
                use = np.flatnonzero((low < high) & ((low if left else high) % 2 == 1))
                node = low[use] if left else high[use] - 1
                (low if left else high)[use] += 1 if left else -1
                at = np.vander(side * (middle[node] - v[use]) / reach[use], self.shift.shape[1], increasing=True)
                scale = np.vander(side * half[node] / reach[use], self.shift.shape[1], increasing=True)
                moments, moments_y = plain[node] * scale, times_y[node] * scale
                for k in range(2 * self.degree + 1):
                    taylor = at @ self.shift[k]
                    out[use, k] += (taylor * moments).sum(axis=1)
                    if k <= self.degree:
                        out_y[use, k] += (taylor * moments_y).sum(axis=1)
            low, high = low // 2, high // 2
        return out, out_y


class MomentFits:
    """The values of ``LocalFits`` on a line under polynomial kernels, in time that grows with the logarithm of the neighbourhoods.

    Neighbourhoods whose weights hardly determine a fit, where rounding would matter, are fitted point by point.
    """

    def __init__(self, points: np.ndarray, y: np.ndarray, queries: np.ndarray, neighbours: Neighbours, q: int, config: SmootherConfig, skip: np.ndarray | None = None):
        self.points, self.y, self.queries, self.neighbours, self.config, self.skip = points, y, queries, neighbours, config, skip
        self.q = min(q, len(points) - (skip is not None))
        self.step = max(1, BLOCK // 200)

    def values(self, robust: np.ndarray, own: np.ndarray, fallback: str) -> tuple[np.ndarray, np.ndarray]:
        order = self.neighbours.order
        moments = Moments(self.neighbours.line, self.y[order], robust[order], self.config.weight_function, self.config.degree)
        value, lever, sound = np.empty(len(self.queries)), np.empty(len(self.queries)), np.empty(len(self.queries), bool)
        gone = None if self.skip is None else np.argsort(order)[self.skip]
        for k in range(0, len(self.queries), self.step):
            part = slice(k, k + self.step)
            value[part], lever[part], sound[part] = self._solved(moments, self.queries[part, 0], None if gone is None else gone[part])
        if not sound.all():
            poor = ~sound
            skip = None if self.skip is None else self.skip[poor]
            value[poor], lever[poor] = BlockwiseFits(self.points, self.y, self.queries[poor], self.neighbours, self.q, self.config, skip).values(robust, own[poor], fallback)
        return value, lever

    def _solved(self, moments: Moments, v: np.ndarray, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, leverages, and which of them are as good as sums over the single points."""
        x, powers = moments.x, np.arange(self.config.degree + 1)
        first = self.neighbours.stretch(v, self.q, gone)
        end = first + self.q
        if gone is not None:
            first, end = first + (first >= gone), end + (end > gone)
        reach = np.maximum(np.abs(v - x[first]), np.abs(x[end - 1] - v))
        sound = reach * self.neighbours.factor > EPS
        unit = np.where(sound, reach, 1.0)
        middle = np.clip(np.searchsorted(x, v), first, end)
        sums, target = 0.0, 0.0
        for side, low, high in ((-1, first, middle), (1, middle, end)):
            for start, stop in [(low, high)] if gone is None else [(low, np.clip(gone, low, high)), (np.clip(gone + 1, low, high), high)]:
                plain, times_y = moments.sums(v, unit, side, start, stop)
                sums, target = sums + plain * float(side) ** np.arange(plain.shape[1]), target + times_y * float(side) ** powers
        normal = sums[:, powers[:, None] + powers]
        diagonal = sums[:, 2 * powers]
        sound &= (diagonal > 1e-5 * self.q).all(axis=1) & (diagonal * unit[:, None] ** (2 * powers) > 10 * EPS).all(axis=1)
        scale = 1 / np.sqrt(np.where(sound[:, None], diagonal, 1.0))
        sound &= _least_eigenvalue(np.where(sound[:, None, None], normal * scale[:, :, None] * scale[:, None, :], 0.0)) > 1e-3
        value, lever = np.zeros(len(v)), np.zeros(len(v))
        if sound.any():
            beta, lever[sound] = solve(normal[sound], target[sound])
            value[sound] = beta[:, 0]
        return value, lever, sound


def local_fits(points: np.ndarray, y: np.ndarray, queries: np.ndarray, neighbours: Neighbours, q: int, c: SmootherConfig, skip: np.ndarray | None = None) -> LocalFits | BlockwiseFits | MomentFits:
    """Fits at ``queries``; ``skip`` has the point that each leaves out."""
    if len(queries) * min(q, len(points)) <= KEPT:
        return LocalFits(points, y, queries, *neighbours.find(queries, q, skip), c)
    known = neighbours.order is not None and c.custom_weight is None and c.weight_function in POLYNOMIALS and c.degree <= 2
    return (MomentFits if known and q >= 100 else BlockwiseFits)(points, y, queries, neighbours, q, c, skip)


# --- interpolation surface ---------------------------------------------------------------------------


class Surface:
    """A tree of cells with fitted values and slopes at their corners, blended by cubic Hermite polynomials."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: SmootherConfig, q: int, neighbours: Neighbours, robust: np.ndarray):
        self.x, self.y, self.c, self.d = x, y, c, x.shape[1]
        low, high = x.min(axis=0), x.max(axis=0)
        margin = 0.005 * (high - low)
        self.corners: dict[tuple[float, ...], int] = {}
        self.split: list[tuple[int, float, int, int] | None] = []
        self.cells: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        self._grow(low - margin, high + margin, max(1, math.floor(len(y) * (c.cell or 0.2) * c.fraction)))
        self.vertex = np.array(list(self.corners), np.float64).reshape(-1, self.d)
        self.inner = np.array([s is not None for s in self.split])
        self.cut_of = [np.array([s[k] if s else 0 for s in self.split]) for k in range(4)]
        self.box = [np.array([c[k] for c in self.cells]) for k in range(3)]
        self.fits = LocalFits(x, y, self.vertex, *neighbours.find(self.vertex, q), c)
        self.linear = self._outside(low, high)
        self.data = self.fits.vertices(robust, self.linear)

    def _outside(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if not self.c.boundary_degree_fallback or self.c.degree <= 1:
            return np.zeros(len(self.vertex), bool)
        return ((self.vertex < low) | (self.vertex > high)).any(axis=1)

    def refit(self, robust: np.ndarray) -> None:
        """New vertex values under new robustness weights, with the same cells and neighbourhoods."""
        linear = self.linear
        if self.c.compat and self.d > 1:  # the box of a refit covers the first n / d points only
            part = self.x[: max(1, len(self.x) // self.d)]
            linear = self._outside(part.min(axis=0), part.max(axis=0))
        self.data = self.fits.vertices(robust, linear)

    def _corner(self, at: np.ndarray) -> int:
        return self.corners.setdefault(tuple(at.tolist()), len(self.corners))

    def _box_corners(self, low: np.ndarray, high: np.ndarray) -> list[int]:
        bits = np.arange(1 << self.d)[:, None] >> np.arange(self.d) & 1
        return [self._corner(at) for at in np.where(bits == 1, high, low)]

    def _grow(self, low: np.ndarray, high: np.ndarray, most: int) -> None:
        limit = self.c.interpolation_vertices or math.inf
        self.cells.append((low, high, self._box_corners(low, high)))
        self.split.append(None)
        queue = deque([(0, np.arange(len(self.x)))])
        while queue:  # first come, first split
            k, own = queue.popleft()
            low, high, _ = self.cells[k]
            if len(self.cells) + 2 > 2 * limit or len(self.corners) + (1 << self.d) // 2 > limit:
                continue
            if len(own) <= most or not len(own) or np.sqrt(((high - low) ** 2).sum()) <= 0:
                continue
            spread = np.ptp(self.x[own], axis=0)
            dim = int(spread.argmax()) if spread.max() > 0 else 0
            own = own[np.argsort(self.x[own, dim], kind="stable")]
            m = self._untied(self.x[own, dim])
            cut = self.x[own[m], dim]
            if cut in (low[dim], high[dim]):
                continue
            upper, lower = high.copy(), low.copy()
            upper[dim] = lower[dim] = cut
            sides = [len(self.cells), len(self.cells) + 1]
            self.split[k] = (dim, float(cut), *sides)
            for box_low, box_high, part, at in ((low, upper, own[: m + 1], sides[0]), (lower, high, own[m + 1 :], sides[1])):
                self.cells.append((box_low, box_high, self._box_corners(box_low, box_high)))
                self.split.append(None)
                queue.append((at, part))

    @staticmethod
    def _untied(values: np.ndarray) -> int:
        """Place to cut after: the middle, or the nearest place where the next value differs."""
        last = len(values) - 1
        middle = last // 2
        for step in range(last + 1):
            for m in (middle + step, middle - step) if step else (middle,):
                if not 0 <= m < last:
                    return middle
                if values[m] != values[m + 1]:
                    return m
        return middle

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        """Blended values at points."""
        cell = np.zeros(len(x), np.int64)
        dim, cut, left, right = self.cut_of
        while (go := self.inner[cell]).any():
            at = cell[go]
            cell[go] = np.where(x[go, dim[at]] <= cut[at], left[at], right[at])
        low, high, corner = (x[cell] for x in self.box)
        data = self.data[corner]  # point, corner, value and slopes
        for k in range(self.d - 1, -1, -1):
            width = high[:, k] - low[:, k]
            h = np.clip((x[:, k] - low[:, k]) / np.where(width > EPS, width, 1), 0, 1)[:, None]
            half = data.shape[1] // 2
            a, b = data[:, :half], data[:, half:]
            rise, fall = h * h * (3 - 2 * h), (1 - h) ** 2 * (1 + 2 * h)
            value = fall * a[..., 0] + rise * b[..., 0] + (h * (1 - h) ** 2 * a[..., k + 1] + h * h * (h - 1) * b[..., k + 1]) * width[:, None]
            mixed = fall[..., None] * a + rise[..., None] * b
            mixed[..., 0] = value
            data = np.where((width > EPS)[:, None, None], mixed, a)
        return data[:, 0, 0]


# --- robustness --------------------------------------------------------------------------------------


def mad(r: np.ndarray) -> float:
    """Median absolute deviation from the median."""
    return float(np.median(np.abs(r - np.median(r))))


def robustness_scale(r: np.ndarray, method: str) -> float:
    """Scale of absolute residuals, with a floor against vanishing medians."""
    mean = float(r.mean())
    if mean == 0:
        return 0.0
    s = mad(r) if method == "mad" else float(np.median(r))
    return max(mean, s) if s <= max(1e-7 * mean, 1e-12) else s


def robustness_weights(residuals: np.ndarray, method: str, scaling: str) -> np.ndarray:
    r = np.abs(residuals)
    s = robustness_scale(r, scaling)
    if s <= 0:
        return np.ones_like(r)
    if method == "bisquare":
        u = r / max(6 * s, 1e-12)
        return np.where(u <= 0.001, 1.0, np.where(u >= 0.999, 0.0, (1 - u * u) ** 2))
    u = r / s
    if method == "huber":
        return np.where(u <= 1.345, 1.0, 1.345 / np.maximum(u, 1.345))
    return np.where(u <= 2.5, 1.0, 0.0)


# --- one fit -----------------------------------------------------------------------------------------


@dataclass
class Fit:
    """What one fit yields, by row and in total."""

    y: np.ndarray
    weights: np.ndarray
    iterations_used: int
    fraction: float
    std_err: np.ndarray | None = None
    leverage: np.ndarray | None = None
    cv_scores: list[float] | None = None
    lower: dict[str, np.ndarray] = field(default_factory=dict)
    upper: dict[str, np.ndarray] = field(default_factory=dict)
    hat: dict[str, float] | None = None
    diagnostics: dict[str, float | None] | None = None


def check_data(x: np.ndarray, y: np.ndarray) -> None:
    if not len(y) or not x.size:
        raise E.EmptyInput("there are no points")
    if len(x) != len(y):
        raise E.MismatchedInputs(f"{len(x)} predictor rows, {len(y)} responses")
    if len(y) < 2:
        raise E.TooFewPoints(f"{len(y)} points, at least 2 are needed")
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise E.InvalidNumericValue("predictors and responses must be finite")


def smooth(x: np.ndarray, y: np.ndarray, c: SmootherConfig, iterations: int | None = None) -> Fit:
    """One fit with the configuration's span: padding, neighbours, surface or direct values, reweighting."""
    n = len(y)
    q = span(n, c.fraction)
    px, py, source = pad(x, y, c.boundary_policy, q)
    neighbours = Neighbours(px, c, scales_of(px))
    robust = np.ones(len(py))
    direct = c.surface_mode == "direct"
    surface, fits = (None, local_fits(px, py, x, neighbours, q, c)) if direct else (Surface(px, py, c, q, neighbours, robust), None)
    fitted = lambda: fits.values(robust, y, c.zero_weight_fallback)[0] if direct else surface.evaluate(x)
    value = fitted()
    used, weights = 1, np.ones(n)
    for used in range(2, (c.iterations if iterations is None else iterations) + 1):
        weights = robustness_weights(y - value, c.robustness_method, c.scaling_method)
        change = np.abs(weights[source] - robust).max()
        robust = weights[source]
        if change < (c.auto_converge or 1e-6):
            break
        if not direct:
            surface.refit(robust)
        value = fitted()
    out = Fit(value, weights, used, c.fraction)
    if c.wants_errors:
        if direct:
            out.y, out.leverage = fits.values(robust, y, c.zero_weight_fallback)
        sigma = 1.4826 * float(np.sort(np.abs(y - out.y))[n // 2])
        out.std_err = sigma * np.sqrt(out.leverage if direct else np.full(n, c.fraction / n))
    return out


def predict(x: np.ndarray, y: np.ndarray, queries: np.ndarray, c: SmootherConfig, robust: np.ndarray | None = None) -> np.ndarray:
    """Direct fits at any points, with the span of the data and without padding."""
    fits = local_fits(x, y, queries, Neighbours(x, c, scales_of(x)), span(len(y), c.fraction), c)
    return fits.values(np.ones(len(y)) if robust is None else robust, np.zeros(len(queries)), "use_local_mean")[0]


# --- cross validation --------------------------------------------------------------------------------


def shuffled(n: int, seed: int | None) -> np.ndarray:
    """Row order for folds: as given, or a Fisher-Yates shuffle by a 64-bit linear congruential generator."""
    order = list(range(n))
    if seed is not None:
        state = seed  # fixed value below: the generator's multiplier
        for i in range(n - 1, 0, -1):
            state = (state * 6364136223846793005 + 1) % (1 << 64)
            j = (state >> 32) % (i + 1)
            order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def bracket(x: np.ndarray, at: np.ndarray, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of sorted ``x`` next to the places ``at`` and the share of the right one; beyond the ends both are the outermost row.

    ``gone`` has the row that each place does without.
    """
    last, right = len(x) - 1, np.searchsorted(x, at, side="left")
    seen = lambda k: k
    if gone is not None:
        last, right = last - 1, right - (gone < right)
        seen = lambda k: k + (k >= gone)
    right = np.clip(right, min(1, last), last)
    left = np.maximum(right - 1, 0)
    for row, outside in ((last, at >= x[seen(last)]), (0, at <= x[seen(0)])):
        left, right = np.where(outside, row, left), np.where(outside, row, right)
    left, right = seen(left), seen(right)
    width = x[right] - x[left]
    share = np.where(width > 0, np.clip((at - x[left]) / np.where(width > 0, width, 1), 0, 1), 0.5)
    return left, right, share


def between(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation over sorted ``x``, constant beyond the ends; the mean between equal places."""
    if not len(x):
        return np.zeros(len(at))
    left, right, share = bracket(x, at)
    return y[left] + share * (y[right] - y[left])


def _fit_at(x: np.ndarray, y: np.ndarray, rows: np.ndarray, c: SmootherConfig) -> np.ndarray:
    """Values of ``smooth`` at some rows; a direct fit that is not reweighted needs no others for that."""
    if c.surface_mode != "direct" or c.iterations > 1:
        return smooth(x, y, c).y[rows]
    q = span(len(y), c.fraction)
    px, py, _ = pad(x, y, c.boundary_policy, q)
    return local_fits(px, py, x[rows], Neighbours(px, c, scales_of(px)), q, c).values(np.ones(len(py)), y[rows], c.zero_weight_fallback)[0]


def _held_out_error(x: np.ndarray, y: np.ndarray, test: np.ndarray, c: SmootherConfig) -> np.ndarray:
    """Squared errors at ``test`` of a fit to all other rows."""
    rest = np.ones(len(y), bool)
    rest[test] = False
    tx, ty = x[rest], y[rest]
    if x.shape[1] > 1:
        return (y[test] - predict(tx, ty, x[test], c)) ** 2
    order = np.argsort(tx[:, 0], kind="stable")
    tx, ty = tx[order], ty[order]
    if len(ty) < 2:
        return (y[test] - between(tx[:, 0], ty, x[test, 0])) ** 2
    left, right, share = bracket(tx[:, 0], x[test, 0])
    rows, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    low, high = _fit_at(tx, ty, rows, c)[place].reshape(2, -1)
    return (y[test] - low - share * (high - low)) ** 2


def _left_out_errors(x: np.ndarray, y: np.ndarray, c: SmootherConfig) -> list[np.ndarray]:
    """Squared errors of each row under a fit to all other rows."""
    n = len(y)
    if x.shape[1] > 1 or n < 4 or c.surface_mode != "direct" or c.iterations > 1 or c.boundary_policy != "none":
        return [_held_out_error(x, y, test, c) for test in fold_rows(n, CrossValidation((c.fraction,), None))]
    order = np.argsort(x[:, 0], kind="stable")
    x, y = x[order], y[order]
    rows = np.arange(1, n - 1)  # without an outermost row distances may have another scale
    left, right, share = bracket(x[:, 0], x[rows, 0], rows)
    at = np.concatenate([left, right])
    fits = local_fits(x, y, x[at], Neighbours(x, c, scales_of(x)), span(n - 1, c.fraction), c, np.concatenate([rows, rows]))
    low, high = fits.values(np.ones(n), y[at], c.zero_weight_fallback)[0].reshape(2, -1)
    return [_held_out_error(x, y, np.array([0]), c), (y[rows] - low - share * (high - low)) ** 2, _held_out_error(x, y, np.array([n - 1]), c)]


def fold_rows(n: int, cv: CrossValidation) -> list[np.ndarray]:
    """Test rows of each fold; the last one takes what is left over."""
    if cv.folds is None:
        return [np.array([i]) for i in range(n)]
    order, size = shuffled(n, cv.seed), n // cv.folds
    return [order[k * size : n if k == cv.folds - 1 else (k + 1) * size] for k in range(cv.folds)]


#: Scores that differ by less, relatively, are equal.
TIED = 1e-9


def cross_validate(x: np.ndarray, y: np.ndarray, c: SmootherConfig) -> tuple[float, list[float]]:
    """The best candidate span (the first of equals) and the score of each."""
    cv = c.cross_validation
    n = len(y)
    plain = c.but(cross_validation=None, return_se=False, confidence_level=None, prediction_level=None, auto_converge=None)
    if cv.folds is not None and n < cv.folds:
        return cv.fractions[0], [0.0] * len(cv.fractions)
    scores = []
    for f in cv.fractions:
        own = plain.but(fraction=f)
        errors = _left_out_errors(x, y, own) if cv.folds is None else [_held_out_error(x, y, test, own) for test in fold_rows(n, cv)]
        if cv.folds is None:
            scores.append(math.sqrt(sum(float(e.sum()) for e in errors) / n))
        else:
            scores.append(sum(math.sqrt(float(e.mean())) for e in errors) / cv.folds)
    return cv.fractions[int(np.argmax(np.array(scores) <= min(scores) * (1 + TIED)))], scores


# --- diagnostics and intervals -----------------------------------------------------------------------


def residual_sd(r: np.ndarray) -> float:
    """Robust spread of signed residuals."""
    if len(r) == 1:
        return abs(float(r[0])) * 1.4826
    s = mad(r)
    return 1.4826 * (s if s > 0 else 1e-12)


def akaike(rss: float, n: int, df: float) -> tuple[float, float]:
    """AIC and its small-sample form; infinite for a perfect fit."""
    if rss <= 0:
        return math.inf, math.inf
    aic = n * math.log(rss / n) + 2 * df
    return aic, aic + 2 * df * (df + 1) / (n - df - 1) if n - df - 1 > 0 else math.inf


def diagnose(y: np.ndarray, fitted: np.ndarray, std_err: np.ndarray | None) -> dict[str, float | None]:
    r = y - fitted
    n, rss, tss = len(y), float((r * r).sum()), float(((y - y.mean()) ** 2).sum())
    sd = residual_sd(r)
    r2 = 1.0 if n == 1 else (1.0 if rss == 0 else 0.0) if tss == 0 else 1 - rss / tss
    out = {"rmse": math.sqrt(rss / n), "mae": float(np.abs(r).mean()), "r_squared": r2, "aic": None, "aicc": None, "effective_df": None, "residual_sd": sd}
    if std_err is not None and sd > 0 and (df := float(np.clip((std_err / sd) ** 2, 0, 1).sum())) > 0:
        out["effective_df"] = df
        out["aic"], out["aicc"] = akaike(rss, n, df)
    return out


def hat_statistics(lever: np.ndarray, rss: float) -> dict[str, float]:
    n, trace = len(lever), float(lever.sum())
    d1 = n - 2 * trace + float((lever**2).sum())
    return {"enp": trace, "trace_hat": trace, "delta1": d1, "delta2": d1 * d1 / n, "residual_scale": math.sqrt(rss / d1) if d1 > 0 else 0.0}


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution, by Acklam's rational approximation."""
    # fixed values: Acklam's published coefficients
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    tail = min(p, 1 - p)
    if tail < 0.02425:
        q = math.sqrt(-2 * math.log(tail))
        return math.copysign(np.polyval(c, q) / np.polyval(d, q), p - 0.5)
    q = p - 0.5
    return float(np.polyval(a, q * q) * q / np.polyval(b, q * q))


def critical_z(level: float) -> float:
    """Two-sided normal quantile; the usual rounded values at 90, 95 and 99 percent."""
    for known, z in ((0.99, 2.576), (0.95, 1.960), (0.90, 1.645)):
        if abs(level - known) < 1e-6:
            return z
    return abs(normal_quantile((1 + level) / 2))


def critical_t(level: float, df: float) -> float:
    z = critical_z(level)
    return z * math.sqrt(df / (df - 2)) if df > 2 else 1.5 * z


def add_intervals(fit: Fit, y: np.ndarray, c: SmootherConfig) -> None:
    r = y - fit.y
    rss = float((r * r).sum())
    if fit.leverage is not None:
        fit.hat = hat_statistics(fit.leverage, rss)
    if c.level is None:
        return
    hat = fit.hat
    sd = hat["residual_scale"] if hat and hat["delta1"] > 0 else residual_sd(r)
    exact = hat and hat["delta1"] > 0 and hat["delta2"] > 0
    t = critical_t(c.level, hat["delta1"] ** 2 / hat["delta2"]) if exact else critical_z(c.level)
    spreads = {}
    if c.confidence_level is not None:
        spreads["conf"] = t * fit.std_err
    if c.prediction_level is not None:
        spreads["pred"] = t * np.sqrt(fit.std_err**2 + sd**2)
    for name, half in spreads.items():
        low, high = fit.y - half, fit.y + half
        poor = ~((high - low) > 0) | ~np.isfinite(high - low)
        if sd > 0 or (fit.std_err > 0).any():
            high = np.where(poor, low + 1e-12, high)
        fit.lower[name], fit.upper[name] = low, high


def window_se(x: np.ndarray, y: np.ndarray, fitted: np.ndarray, name: str, q: int, robust: np.ndarray | None = None) -> np.ndarray:
    """Standard errors from local residual variances in windows of ``q`` neighbours of sorted ``x``."""
    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        left = min(max(i - q // 2, 0), max(n - q, 0))
        right = min(left + q, n) - 1
        while right < n - 1 and x[i] - x[left] > x[right + 1] - x[i]:
            left, right = left + 1, right + 1
        while left > 0 and x[right] - x[i] > x[i] - x[left - 1]:
            left, right = left - 1, right - 1
        h = max(x[i] - x[left], x[right] - x[i])
        if h <= 0:
            continue
        at = slice(left, right + 1)
        w = kernel(name, np.abs(x[at] - x[i]) / h) * (1.0 if robust is None else robust[at])
        total = float(w.sum())
        if total > 2:
            out[i] = math.sqrt(float((w * (y[at] - fitted[at]) ** 2).sum()) / (total - 2) * float(w[i - left]) / total)
    return out


def window_weights(x: np.ndarray, left: int, right: int, at: float, h: float, near: float, far: float, name: str) -> tuple[np.ndarray, int]:
    """Kernel weights of a window of sorted ``x`` and the last place with one: 1 up to ``near``, 0 beyond ``far``."""
    out = np.zeros(len(x))
    if left > right or right >= len(x) or h <= 0:
        return out, left
    gap = np.abs(x - at)
    inside = np.zeros(len(x), bool)
    inside[left : right + 1] = gap[left : right + 1] <= far
    out[inside] = np.where(gap[inside] <= near, 1.0, kernel(name, gap[inside] / h))
    return out, int(np.flatnonzero(inside)[-1]) if inside.any() else left


# --- adapters on arrays ------------------------------------------------------------------------------


def fit_series(x: np.ndarray, y: np.ndarray, c: SmootherConfig) -> Fit:
    """A whole fit of one series: cross validation, smoothing, errors, intervals and diagnostics."""
    x = np.asarray(x, np.float64).reshape(-1, c.dimensions)
    y = np.asarray(y, np.float64)
    check_data(x, y)
    scores = None
    if c.cross_validation:
        best, scores = cross_validate(x, y, c)
        c = c.but(fraction=best, cross_validation=None)
    fit = smooth(x, y, c)
    fit.cv_scores = scores
    if c.wants_errors:
        add_intervals(fit, y, c)
    if c.return_diagnostics:
        fit.diagnostics = diagnose(y, fit.y, fit.std_err)
    return fit


def online_value(x: np.ndarray, y: np.ndarray, c: SmootherConfig) -> tuple[float, float, int]:
    """Smoothed newest point of a window, its robustness weight and the iterations used."""
    if len(y) == 2 and x.shape[1] == 1:
        # the line through two points, at the newest, is the newest point itself
        return (float(y[1]) if x[0, 0] != x[1, 0] else float(y.mean())), 1.0, 0
    check_data(x, y)
    if c.update_mode == "incremental":
        if c.surface_mode == "direct" and c.boundary_policy == "none":
            return float(full_windows(x, y, c.but(window_capacity=max(len(y), 3), min_points=2))[-1]) if len(y) > 2 else float(smooth(x, y, c, iterations=0).y[-1]), 1.0, 1
        return float(smooth(x, y, c, iterations=0).y[-1]), 1.0, 1
    fit = smooth(x, y, c)
    return float(fit.y[-1]), float(fit.weights[-1]), fit.iterations_used


def window_values(x: np.ndarray, y: np.ndarray, ends: np.ndarray, size: int, c: SmootherConfig) -> np.ndarray:
    """Incremental direct values at the last points ``ends`` of windows of ``size`` rows, all windows at once."""
    q = min(span(size, c.fraction), size)
    out = np.empty(len(ends))
    step = max(1, BLOCK // (size * x.shape[1]))
    for k in range(0, len(ends), step):
        at = ends[k : k + step]
        rows = at[:, None] + np.arange(1 - size, 1)
        offset = np.abs(x[rows] - x[at, None, :])
        if c.distance_metric == "normalized":
            width = np.ptp(x[rows], axis=1)
            offset = offset / np.where(width > 0, width, 1)[:, None, :]
        gap = distances(np.zeros((1, x.shape[1])), offset.reshape(-1, x.shape[1]), c, np.ones(x.shape[1])).reshape(rows.shape)
        near = np.lexsort((x[rows, 0], gap), axis=1)[:, :q]
        fits = LocalFits(x, y, x[at], np.take_along_axis(rows, near, axis=1), np.take_along_axis(gap, near, axis=1), c)
        out[k : k + step] = fits.values(np.ones(len(y)), y[at], c.zero_weight_fallback)[0]
    return out


def full_windows(x: np.ndarray, y: np.ndarray, c: SmootherConfig) -> np.ndarray:
    """``window_values`` of every full window of one series."""
    return window_values(x, y, np.arange(c.window_capacity - 1, len(y)), c.window_capacity, c)


def merged(before: np.ndarray, now: np.ndarray, strategy: str) -> np.ndarray:
    """Two fits of the rows that two neighbouring blocks share, as one."""
    if strategy == "take_first":
        return before
    if strategy == "take_last":
        return now
    share = np.full(len(now), 0.5) if strategy == "average" else np.arange(len(now)) / max(len(now), 1)
    return before * (1 - share) + now * share
