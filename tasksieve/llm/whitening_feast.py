"""Whitening of embeddings by the leading components of their covariance, found by contour integration (FEAST).

Spark sums up the distinct vectors: number and exact totals first, then the centred products. The covariance, a matrix of
dim x dim whatever the number of vectors, is decomposed as follows. Inertia counts (signs of the pivots of a symmetric
indefinite factorization of V - t I) tell how many eigenvalues lie above t; bisection with them finds an edge in the gap
below the wanted components, and slices of the range above it. For each slice, quadrature over a half circle in the complex plane
of solves with z I - V applied to a block of random vectors projects onto the eigenvectors whose eigenvalues lie in the
slice; Rayleigh-Ritz on that block gives them, and the block is filtered again until their residuals stay at rounding. At
last the count above the edge must equal the number of components found, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.stored import stored
from tasksieve.llm.whole_vectors import by_dim, whole_vectors

_LONG = 2**63


@dataclass(frozen=True)
class Whitening:
    """components: how many at most; scale: of the entries; nodes: of the quadrature; rounds: filterings of a slice at most."""

    components: int = 4
    scale: int = 256
    nodes: int = 8
    rounds: int = 40
    seed: int = 2026


# --- eigenvalues of a covariance --------------------------------------------------------------------------------------

def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of P (A - shift I) P' = L D L' (Sylvester).

    Pivots of one or two rows are chosen by the largest entry left, so growth is bounded and no definiteness is needed.
    """
    left = matrix - shift * np.eye(len(matrix))
    above, edge = 0, (1 + 17**0.5) / 8
    while len(left):
        diagonal = np.abs(np.diag(left))
        r = int(diagonal.argmax())
        off = np.abs(left - np.diag(np.diag(left)))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[r] == 0 and off[i, j] == 0:
            return above
        pivot = [r] if diagonal[r] >= edge * off[i, j] else [int(i), int(j)]
        block = left[np.ix_(pivot, pivot)]
        above += int(block[0, 0] > 0) if len(pivot) == 1 else 1  # a pivot of two rows is indefinite
        rest = np.delete(np.arange(len(left)), pivot)
        side = left[np.ix_(rest, pivot)]
        left = left[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        left = (left + left.T) / 2
    return above


def _gap_below(matrix: np.ndarray, wanted: int, floor: float, ceiling: float) -> float:
    """A point below the ``wanted`` largest eigenvalues, in the middle of the gap that follows them where there is one."""
    low, high = floor, ceiling  # at least ``wanted`` above low, fewer above high
    if count_above(matrix, low) <= wanted:
        return low
    within = None
    while high - low > 1e-14 * ceiling and within is None:
        middle = (low + high) / 2
        n = count_above(matrix, middle)
        if n == wanted:
            within = middle
        elif n > wanted:
            low = middle
        else:
            high = middle
    if within is None:
        return low
    top, bottom = within, within
    for _ in range(12):
        middle = (top + high) / 2
        top, high = (middle, high) if count_above(matrix, middle) == wanted else (top, middle)
        middle = (bottom + low) / 2
        bottom, low = (middle, low) if count_above(matrix, middle) == wanted else (bottom, middle)
    return (top + bottom) / 2


def _slice(matrix: np.ndarray, low: float, high: float, n: int, op: Whitening, noise: np.random.Generator) -> np.ndarray:
    """Orthonormal eigenvectors for the ``n`` eigenvalues between low and high."""
    dim, norm = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(op.nodes)
    angles = np.pi * (1 + x) / 2
    block = noise.standard_normal((dim, min(dim, 2 * n + 4)))
    best, best_error = None, np.inf
    for _ in range(op.rounds):
        projected = np.zeros_like(block)
        for angle, weight in zip(angles, w):
            turn = radius * np.exp(1j * angle)
            projected += weight / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(dim) - matrix, block.astype(complex))).real
        basis = np.linalg.qr(projected)[0]
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ inner
        # The n Ritz values nearest to the slice's centre; a value on its edge may fall out by rounding.
        own = np.argsort(np.abs(values - centre), kind="stable")[:n]
        error = float(np.abs(matrix @ block[:, own] - block[:, own] * values[own]).max())
        if error < best_error / 2:
            best, best_error = block[:, own], error
        elif best_error <= 1e-12 * norm:
            break
        if error <= 1e-16 * norm:
            break
    if best is None or best_error > 1e-10 * norm:
        raise RuntimeError(f"the components between {low} and {high} did not settle")
    return best


def leading_components(matrix: np.ndarray, op: Whitening = Whitening()) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a covariance: the leading ``components`` of positive variance."""
    trace = float(np.trace(matrix))
    if trace <= 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    floor, ceiling = 1e-12 * trace, 1.0001 * float(np.abs(matrix).sum(axis=1).max())
    wanted = min(op.components, count_above(matrix, floor))
    edge = _gap_below(matrix, wanted, floor, ceiling)
    noise = np.random.default_rng(op.seed)
    found, high, above = [], ceiling, 0
    while high > edge:
        low = max(edge, high / 4)
        n = count_above(matrix, low)
        if n > above:
            found.append(_slice(matrix, low, high, n - above, op, noise))
        high, above = (low if low > edge else edge), n
    # Slices meet in eigenvalues close to their edges: one Rayleigh-Ritz step over all of them.
    basis = np.linalg.qr(np.concatenate(found, axis=1))[0]
    values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
    vectors = basis @ inner
    error = float(np.abs(matrix @ vectors - vectors * values).max())
    if int((values > edge * (1 - 1e-10)).sum()) != above or error > 1e-10 * ceiling:
        raise RuntimeError(f"{above} eigenvalues lie above {edge}, other than {len(values)} were found")
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


# --- sums over the distinct vectors ------------------------------------------------------------------------------------

def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length: the number of vectors (place -1) and the exact total of each entry."""
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for dim, _, x in by_dim(batch):
            wide = x if x.size == 0 or np.abs(x).max() < _LONG // 2 // len(x) else x.astype(object)
            own = [len(x), *(int(v) for v in wide.sum(axis=0))]
            sums[dim] = [a + b for a, b in zip(sums.get(dim, [0] * (dim + 1)), own)]
    for dim, total in sums.items():
        # 38 digits: text, for Arrow's decimals take Python's decimals only.
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in total])], ["dim", "place", "total"]
        )


def _means(sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    return {dim: np.array([s / n for s in total]) for dim, (n, total) in sums.items()}


def _products(means: dict[int, np.ndarray], turns: dict[int, np.ndarray] | None = None):
    """Rows (dim, place, sums) of the matrix of centred products, of the vectors or of what ``turns`` makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_dim(batch):
                y = x - means[dim]
                if turns is not None:
                    y = y @ turns[dim]
                sums[dim] = sums.get(dim, 0) + y.T @ y
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                ["dim", "place", "sums"],
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for dim, place, row in zip(*(batch.column(c).to_pylist() for c in ("dim", "place", "sums"))):
            sums[dim, place] = sums.get((dim, place), 0) + np.array(row)
    for (dim, place), total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([place], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["dim", "place", "sums"])


def _matrices(fit: DataFrame, means: dict[int, np.ndarray], turns: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """The sums of centred products by length: each task adds up its own, rows of the matrices are added where they meet.

    What reaches the driver are the matrices, whose size depends on the lengths of the vectors and not on their number.
    """
    shape = "dim int, place int, sums array<double>"
    rows = fit.mapInArrow(_products(means, turns), shape).repartition("dim", "place").mapInArrow(_added, shape).collect()
    found: dict[int, dict[int, list[float]]] = {}
    for dim, place, sums in rows:
        found.setdefault(dim, {})[place] = sums
    return {dim: np.array([by_place[i] for i in range(len(by_place))]).reshape(len(by_place), -1) for dim, by_place in found.items()}


@dataclass(frozen=True)
class Fitted:
    """What the vectors of one length have in common."""

    n: int
    totals: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None


def fit(distinct: DataFrame, op: Whitening = Whitening()) -> dict[int, Fitted]:
    """Totals and components by length of the vectors, from rows (dim, x) of which each vector is one."""
    sums: dict[int, tuple[int, list[int]]] = {}
    collected = distinct.mapInArrow(_totals, "dim int, place int, total string").groupBy("dim", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")
    ).orderBy("dim", "place").collect()  # one row for each place of each length
    for dim, place, total in collected:
        if place < 0:
            sums[dim] = (int(total), [])
        else:
            sums[dim][1].append(int(total))
    means = _means(sums)
    found: dict[int, Fitted] = {}
    for dim, products in _matrices(distinct.where("dim > 0"), means).items():
        n, totals = sums[dim]
        covariance = (products + products.T) / (2 * n)
        values, vectors = leading_components(covariance, op)
        found[dim] = Fitted(n, totals, values, vectors, float(np.trace(covariance)))
    turns = {dim: f.vectors / np.sqrt(f.values) for dim, f in found.items()}
    errors = {
        dim: float(np.abs(products / found[dim].n - np.eye(len(products))).max())
        for dim, products in _matrices(distinct.where("dim > 0"), means, turns).items()
    }
    return {dim: Fitted(f.n, f.totals, f.values, f.vectors, f.trace, errors.get(dim)) for dim, f in found.items()}


# --- all vectors --------------------------------------------------------------------------------------------------------

_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, fitted: Fitted) -> list[int | None]:
    """The exact sums of (n x - S)^2, None beyond the range of a long."""
    largest = (fitted.n * int(np.abs(x).max()) + max(abs(s) for s in fitted.totals)) ** 2 * x.shape[1]
    kind = np.int64 if largest < _LONG else object
    apart = x.astype(kind) * fitted.n - np.array(fitted.totals, kind)
    return [int(v) if v < _LONG else None for v in (apart * apart).sum(axis=1)]


def _projector(fits: dict[int, Fitted], op: Whitening):
    means = _means({dim: (f.n, f.totals) for dim, f in fits.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in by_dim(batch):
                if not dim:
                    continue
                f, kept = fits[dim], min(op.components, dim)
                white = (x - means[dim]) @ (f.vectors / np.sqrt(f.values))
                blank = np.full((len(x), kept - white.shape[1]), np.nan)
                white = np.concatenate([white, blank], axis=1).ravel()
                shares = [float(v) / f.trace for v in f.values] + [0.0 if f.trace else None] * (kept - len(f.values))
                times = np.repeat(np.arange(len(x)), kept)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at[times])), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(times), f.n, np.int64)), pa.array(_deviations(x, f), pa.int64()).take(pa.array(times)),
                    pa.array(white, from_pandas=True), pa.array(shares * len(x), pa.float64()),
                    pa.array([f.identity_error] * len(times), pa.float64()),
                ], [c.split()[0] for c in _RESULT.split(", ")])

    return run


def whitened(embeddings: DataFrame, op: Whitening = Whitening()) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each usable row of ``embeddings``
    (vec_id, embedding array<float or double>) and component.

    Vectors that are null or hold null or non-finite entries are dropped, also those with an entry of 2**45 or more (at a scale of 256).
    Repeated vectors count once in the fit and get equal rows; so do rows with equal or null ids. Vectors of different lengths
    are fitted apart, each length for itself; empty vectors have no component and no row. A component without variance (an eigenvalue below
    1e-12 of the trace) has a null ``whitened`` and 0 ``explained`` (null where nothing varies), and does not enter ``identity_error``,
    which is null where no component is left. A deviation beyond the range of a long is null. No vectors, no rows.
    """
    rows = stored(whole_vectors(embeddings, op.scale), "whole-vectors")
    distinct = stored(rows.select("dim", "x").distinct(), "fit-list")
    return rows.mapInArrow(_projector(fit(distinct, op), op), _RESULT)
