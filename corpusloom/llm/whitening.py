"""Embedding whitening: vectors projected on the unit eigenvectors of their covariance, over the roots of the eigenvalues.

Two passes: the first adds up whole numbers, so the mean is exact; the second adds up outer products of centred vectors, by
a matrix product for each batch. What each task has added up is merged in a tree. LAPACK decomposes the covariance, and
the projection is broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components that are told; an entry c becomes floor(SCALE * c) + SHIFT.
COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Entries whose number is no smaller than this are not whole numbers in double precision.
LARGEST = float(2**53)
#: Rows of a batch that are centred at once.
ROWS = 4096


@dataclass
class Fit:
    """Of all vectors of one length: their number, sums, covariance (divisor n), and the projection of centred vectors."""

    n: int
    sums: list[int]
    explained: np.ndarray
    projection: np.ndarray
    identity_error: float = 0.0


def integers(vectors: pa.Array) -> np.ndarray:
    """A row of whole numbers for each vector; all have the same length."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


def apart(x: np.ndarray, fit_n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: exact, as 64-bit numbers where they fit."""
    if fit_n * (int(np.abs(x).max(initial=0)) + 1) < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return fit_n * x - np.array(sums, np.int64)
    return fit_n * x.astype(object) - np.array(sums, object)


def deviations(gap: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null where a sum is no 64-bit number."""
    near = gap.astype(float)
    if (near * near).sum(axis=1).max(initial=0) < 2.0**62:
        return (gap.astype(np.int64) ** 2).sum(axis=1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in gap]
    return [v if v < 2**63 else None for v in exact]


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) of a batch, in parts of ROWS rows; rows without an entry are left out."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        for k in range(0, len(rows), ROWS):
            yield d, rows[k : k + ROWS]


def tree_summed(vectors: DataFrame, part: Callable[[int, np.ndarray], tuple]) -> dict[int, tuple]:
    """For each length the sum, over all rows, of part(length, whole numbers of some rows): a tuple of arrays or numbers.

    A task sends one small row, and rows are merged in a tree of tasks, so the driver receives one.
    """

    def add(a: dict, b: dict) -> dict:
        return a | {d: tuple(x + y for x, y in zip(a[d], s, strict=True)) if d in a else s for d, s in b.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            column = batch.column("v")
            for d, rows in by_length(column):
                total = add(total, {d: part(d, integers(column.take(pa.array(rows))))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    parts = vectors.select("v").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(bytes(r["part"])))
    return parts.treeAggregate({}, add, add)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that are whitened, v as doubles."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.filter(F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x * SCALE) < F.lit(LARGEST), F.lit(False)) & ~F.isnan(x)), F.lit(False)))


def fit(rows: DataFrame) -> dict[int, Fit]:
    """Fits (vec_id, v) of usable(), for each length of vectors."""
    # Halves of 32 bits, so that no sum of a task leaves 64 bits.
    sums = tree_summed(rows, lambda d, x: (len(x), np.array([int(v) for v in (x >> 32).sum(axis=0)], object) * 2**32 + np.array([int(v) for v in (x & 0xFFFFFFFF).sum(axis=0)], object)))
    means = {d: (n, [int(v) for v in s]) for d, (n, s) in sums.items()}

    def centred(d: int, x: np.ndarray) -> np.ndarray:
        n, s = means[d]
        return apart(x, n, s).astype(np.float64) / n

    def outer(d: int, x: np.ndarray) -> tuple[np.ndarray]:
        c = centred(d, x)
        return (c.T @ c,)

    out = {}
    for d, (products,) in tree_summed(rows, outer).items():
        n, s = means[d]
        values, axes = np.linalg.eigh(products / n)
        values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
        trace = float(np.trace(products / n))
        # Without variance a component has no direction of its own: it is told, but nothing is divided by its root.
        there = values > d * np.finfo(float).eps * trace
        root = np.where(there, np.sqrt(values), np.nan)
        k = min(COMPONENTS, d)
        out[d] = Fit(n, s, values[:k] / trace if trace > 0 else np.zeros(k), (axes / root)[:, :k])

    def white(d: int, x: np.ndarray) -> tuple[np.ndarray]:
        w = np.nan_to_num(centred(d, x) @ out[d].projection)
        return (w.T @ w,)

    for d, (products,) in tree_summed(rows, white).items():
        f = out[d]
        real = ~np.isnan(f.projection[0])
        off = (products / f.n - np.eye(len(real)))[np.ix_(real, real)]
        f.identity_error = float(np.abs(off).max(initial=0.0))
    return out


def whiten(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array of numbers) -> vec_id, component, n, deviation, whitened, explained, identity_error: a row for
    each usable vector and each of the first COMPONENTS components.

    Vectors that are null or hold a null or non-finite entry, or one whose whole number would leave double precision (2^53), are left
    out, of the fit as well; so are empty ones, which have no components. Vectors of another length are a list of their
    own. Rows that repeat a vector or an id, or have a null id, are rows each. Components are numbered by falling
    eigenvalue; ties by LAPACK's order. Of a component without variance whitened is null, and identity_error leaves it out. A
    deviation that is no 64-bit number is null. Other columns are ignored. An empty table gives no rows.
    """
    rows = usable(vectors)
    # As large as the square of the vectors' length, whatever the number of vectors.
    shared = vectors.sparkSession.sparkContext.broadcast(fit(rows))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            for d, at in by_length(column):
                f = shared.value[d]
                gap = apart(integers(column.take(pa.array(at))), f.n, f.sums)
                white = (gap.astype(np.float64) / f.n) @ f.projection
                k, m = white.shape[1], len(at)
                many = lambda values, of: pa.array(np.repeat(np.asarray(values), of))
                deviation = pa.array(deviations(gap), pa.int64()).take(many(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(many(at, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), many([f.n], m * k), deviation,
                        pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(f.explained, m)), many([f.identity_error], m * k),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
