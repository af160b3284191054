"""Embedding whitening with FEAST contour integration.

The covariance comes from one pass over all vectors: integers less a whole number near
their mean, multiplied in blocks, so that sums below 2**53 are exact. Its upper spectrum is
cut into intervals at gaps, found with inertia counts (negative pivots of the shifted
matrix). On each interval Gauss-Legendre quadrature along a half circle solves complex shifted
systems, which projects a block of vectors onto the interval's eigenvectors; Rayleigh-Ritz
extracts these, and the block goes round again until residuals vanish. An interval counts as
done when it holds as many eigenvectors as the inertia of its ends says, so none is missed.

What reaches the driver is one matrix of the vectors' dimension, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import dropped, staged, table

COMPONENTS = 32
#: x = floor(SCALE * c) + SHIFT. Fixed values.
SCALE, SHIFT = 64, 1_000_000
#: Quadrature nodes on the half circle, eigenvalues wanted per interval, and rounds before the block grows.
NODES, PER_INTERVAL, ROUNDS = 8, 8, 40
#: Vectors multiplied at a time.
BLOCK = 4096


def sound_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec, x: rows whose vector has neither null nor non-finite entries, of the most frequent length (the longer of two)."""
    ok = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    rows = vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).cast("array<double>").alias("x")).where("x is not null").where(ok)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return rows.where(F.size("x") == (most.d if most else 0))


def _integers(batch: pa.RecordBatch, size: int) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(-1, size) * float(SCALE)).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, size: int, shape: tuple[int, ...], of_block: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of `of_block` (a matrix of that shape) over all blocks of vectors: per partition, then per row of the matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _integers(batch, size)
            for i in range(0, len(x), BLOCK):
                some = of_block(x[i : i + BLOCK])
                total = some if total is None else total + some
        if total is not None:
            k, part = len(total), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(np.full(k, part)), pa.array(total.tolist())], ["i", "part", "sums"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                totals[i] = totals.get(i, 0) + np.array(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["i", "sums"])

    parts = rows.select("x").mapInArrow(partial, f"i long, part long, sums array<{kind}>")
    parts = parts.repartition("i").sortWithinPartitions("i", "part").select("i", "sums")
    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for row in parts.mapInArrow(final, f"i long, sums array<{kind}>").collect():
        out[row.i] = row.sums
    return out


def _tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar matrix, by reflections; inertia counts read these."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if not np.any(x[1:]):
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(t: tuple[np.ndarray, np.ndarray], sigma: float) -> int:
    """Eigenvalues over sigma: the positive pivots of the factored shifted matrix."""
    diagonal, off = t
    tiny = np.finfo(float).tiny ** 0.5
    above, pivot = 0, 1.0
    for i, value in enumerate(diagonal):
        pivot = value - sigma - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = -tiny if pivot == 0 else pivot
        above += pivot > 0
    return above


def _gap(t, low: float, high: float) -> float:
    """A point in the middle half of the interval with a wide free range around it."""
    best, clear = (low + high) / 2, 0.0
    for sigma in np.linspace(0.75 * low + 0.25 * high, 0.25 * low + 0.75 * high, 17):
        free = (high - low) / 4
        while free > clear and count_above(t, sigma - free) != count_above(t, sigma + free):
            free /= 2
        if free > clear:
            best, clear = float(sigma), free
    return best


def intervals(t, low: float, high: float, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues): intervals from the top down, with `wanted` eigenvalues or more in all."""
    out, open_, found = [], [(low, high)], 0
    while open_ and found < wanted:
        a, b = open_.pop()
        n = count_above(t, a) - count_above(t, b)
        if n > PER_INTERVAL and b - a > 1e-9 * high:
            middle = _gap(t, a, b)
            open_ += [(a, middle), (middle, b)]
        elif n:
            out.append((a, b, n))
            found += n
    return out


def feast(v: np.ndarray, low: float, high: float, n: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The n eigenpairs of symmetric v in (low, high]."""
    d = len(v)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (1 + points))
    centre, radius = (low + high) / 2, (high - low) / 2
    width = min(d, 2 * n + 8)
    while True:
        y = np.random.default_rng(d).standard_normal((d, width))
        for _ in range(ROUNDS):
            q = np.zeros((d, y.shape[1]))
            for turn, weight in zip(turns, weights, strict=True):
                solved = np.linalg.solve((centre + radius * turn) * np.eye(d) - v, y.astype(complex))
                q += 0.5 * weight * (radius * turn * solved).real
            left, sizes, _ = np.linalg.svd(q, full_matrices=False)
            basis = left[:, sizes > 1e-13 * sizes[0]]
            e, u = np.linalg.eigh(basis.T @ v @ basis)
            x = basis @ u
            rest = np.linalg.norm(v @ x - x * e, axis=0)
            inside = (e > low) & (e <= high) & (rest <= tolerance)
            if inside.sum() == n:
                return e[inside], x[:, inside]
            y = x
        if width == d:
            raise ArithmeticError(f"{n} eigenvalues in ({low}, {high}], {inside.sum()} found")
        width = min(d, 2 * width)


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, with their unit vectors as columns; none that is zero but for rounding."""
    size = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if size == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    t = _tridiagonal(v)
    floor = size * len(v) * np.finfo(float).eps * 16
    wanted = min(components, count_above(t, floor))
    found = [feast(v, a, b, n, 1e-14 * len(v) * size) for a, b, n in intervals(t, floor, size * (1 + 1e-9), wanted)]
    basis, _ = np.linalg.qr(np.concatenate([x for _, x in found], axis=1))
    e, u = np.linalg.eigh(basis.T @ v @ basis)  # vectors of different intervals, at right angles to the last digit
    e, x = e[::-1][:wanted], (basis @ u)[:, ::-1][:, :wanted]
    return e, x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(wanted)])


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n @ self.vectors / np.sqrt(self.values)


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all `sound_vectors`; None for none. Fit and check pass over all rows, with divisor n."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None or first.d == 0:
        return None
    d = first.d
    sums = _summed(rows, d, (d + 1, 1), lambda x: np.append(x.sum(axis=0), len(x)).reshape(-1, 1), "long").ravel()
    n, sums = int(sums[-1]), sums[:-1]
    centre = np.array([round(int(s) / n) for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - centre).astype(np.float64)
        return y.T @ y

    off = np.array([int(s) - n * int(c) for s, c in zip(sums, centre, strict=True)], np.float64) / n
    v = _summed(rows, d, (d, d), products, "double") / n - np.outer(off, off)
    values, vectors = principal(v, components)
    model = Whitening(n, sums, values, vectors, float(np.trace(v)))
    k = len(values)
    if k:
        def moments(x: np.ndarray) -> np.ndarray:
            w = model(x)
            return np.vstack([w.T @ w, w.sum(axis=0)])

        both = _summed(rows, d, (k + 1, k), moments, "double") / n
        model.identity_error = float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())
    return model


def _exact_squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """sum((n * x - sums)**2) per row, exact; None where it doesn't fit in a long."""
    y = x * n - sums
    top = float(np.abs(y).max(initial=0))
    if top * top * max(1, y.shape[1]) < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    totals = [sum(int(c) ** 2 for c in row) for row in y.tolist()]
    return [t if t < 2**63 else None for t in totals]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec, n, deviation, whitened array, explained array, identity_error: one row per sound vector.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another
    length than the most frequent one. Repeated rows count as often as they occur;
    ids may be null. There are as many components as eigenvalues above rounding,
    `components` at most, so equal vectors or a single one have none. An empty table, or empty vectors, give an
    empty result. Entries must stay below 2**40 for the integers to be exact.
    """
    rows = sound_vectors(vectors, id_col, vector_col)
    held = staged(rows, "sound-vectors")
    model = fitted(held, components)
    if model is None:
        return held.where("false").select("vec", *[F.lit(None).cast(kind).alias(name) for name, kind in _KINDS.items()])
    d, explained = len(model.sums), (model.values / model.trace if len(model.values) else model.values).tolist()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch, d)
            for i in range(0, len(x), BLOCK):
                some = x[i : i + BLOCK]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec")[i : i + k], pa.array([model.n] * k, pa.int64()), pa.array(_exact_squares(some, model.n, model.sums), pa.int64()),
                     pa.array(model(some).tolist(), pa.list_(pa.float64())), pa.array([explained] * k, pa.list_(pa.float64())),
                     pa.array([model.identity_error] * k, pa.float64())],
                    ["vec", *_KINDS],
                )

    kinds = ", ".join(f"{name} {kind}" for name, kind in _KINDS.items())
    out = staged(held.mapInArrow(of, f"vec {held.schema['vec'].dataType.simpleString()}, {kinds}"), "whitened")
    dropped(held)
    return out


_KINDS = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    rows = rows.select("vec", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "both"), "identity_error")
    return rows.select(
        F.col("vec").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("both.whitened").alias("whitened"), F.col("both.explained").alias("explained"), "identity_error",
    )
