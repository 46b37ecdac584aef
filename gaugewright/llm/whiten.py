"""Whitening of embeddings: covariance by Welford's rank-one updates, merged across partitions, and a symmetric QR eigen-solve.

Entries are put on a whole-number grid, so that sums and deviations are exact and equal vectors are
equal rows. Only states of one fit per partition, of the size of a covariance, leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from gaugewright.session import checkpointed

#: x = floor(GRID * c) + OFFSET of an entry c.
GRID, OFFSET = 64, 1_000_000

#: Tasks that merge the partitions' states before one merges theirs.
MERGE_TASKS = 32

#: Components of an eigenvalue below this share of the greatest have no direction of their own.
FLAT = 1e-12

#: Rows worked on at a time.
ROWS = 4096


class Fit:
    """Count, exact sums (of whole numbers), mean and sum of centred outer products of vectors.

    Means are kept relative to the first vector seen, which is exact, so that a large offset costs no digits.
    """

    def __init__(self, n: int = 0, sums: list[int] | None = None, shift: np.ndarray | None = None, mean: np.ndarray | None = None, spread: np.ndarray | None = None):
        self.n, self.sums, self.shift, self.mean, self.spread = n, sums, shift, mean, spread

    def add(self, vectors: np.ndarray) -> None:
        """Welford's update by each row: the mean moves, and the outer product of the deviation joins the spread."""
        if not len(vectors):
            return
        if not self.n:
            d = vectors.shape[1]
            self.sums, self.shift, self.mean, self.spread = [0] * d, vectors[0].copy(), np.zeros(d), np.zeros((d, d))
        for v in (vectors - self.shift).astype(np.float64):
            self.n += 1
            off = v - self.mean
            self.mean += off / self.n
            self.spread += np.multiply.outer(off, off * ((self.n - 1) / self.n))
        if vectors.dtype == np.int64:
            self.sums = [a + b for a, b in zip(self.sums, _column_sums(vectors), strict=True)]

    def merge(self, other: Fit) -> None:
        """The parallel update: spreads add, and so does the outer product of the means' difference."""
        if not other.n:
            return
        if not self.n:
            self.__init__(other.n, other.sums, other.shift, other.mean, other.spread)
            return
        n = self.n + other.n
        off = other.mean - self.mean + (other.shift - self.shift)
        self.spread = self.spread + other.spread + np.multiply.outer(off, off * (self.n / n * other.n))
        self.mean = self.mean + off * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n


def _column_sums(vectors: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    small = int(np.abs(vectors).max(initial=0)) < (1 << 62) // max(len(vectors), 1)
    return [int(x) for x in (vectors if small else vectors.astype(object)).sum(axis=0)]


_STATE = "n long, sums array<string>, kind string, shift binary, mean binary, spread binary"


def _state(fit: Fit) -> pa.RecordBatch:
    arrays = [pa.array([fit.n]), pa.array([[str(x) for x in fit.sums]]), pa.array([fit.shift.dtype.str]), *(pa.array([x.tobytes()]) for x in (fit.shift, fit.mean, fit.spread))]
    return pa.RecordBatch.from_arrays(arrays, ["n", "sums", "kind", "shift", "mean", "spread"])


def _fit_of(row: dict) -> Fit:
    mean = np.frombuffer(row["mean"], dtype=np.float64)
    return Fit(row["n"], [int(x) for x in row["sums"]], np.frombuffer(row["shift"], dtype=row["kind"]), mean, np.frombuffer(row["spread"], dtype=np.float64).reshape(len(mean), -1))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = Fit()
    for batch in batches:
        for row in batch.to_pylist():
            whole.merge(_fit_of(row))
    if whole.n:
        yield _state(whole)


def _fit(vectors: DataFrame, decode) -> Fit:
    """The fit of all vectors; each partition streams through its own, and states merge in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fit()
        for batch in batches:
            own.add(decode(batch))
        if own.n:
            yield _state(own)

    states = vectors.mapInArrow(run, _STATE).repartition(MERGE_TASKS).mapInArrow(_merge, _STATE).repartition(1).mapInArrow(_merge, _STATE)
    found = states.collect()  # one row at most
    return _fit_of(found[0].asDict()) if found else Fit()


def _usable(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, ...]:
    """The places of rows whose vector isn't null or empty and has finite entries only; all rows' lengths, entries and first entry (and the end)."""
    lists = batch.column(batch.schema.get_field_index(column))
    lists = lists.cast(pa.large_list(lists.type.value_type))
    values = lists.flatten()
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(numbers))))
    return np.flatnonzero((size > 0) & (bad[begin[1:]] == bad[begin[:-1]])), size, numbers, begin


def grid(values: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 as whole numbers; beyond 2**62 an entry stays there."""
    return np.clip(np.floor(GRID * values), -(2.0**62), 2.0**62).astype(np.int64) + OFFSET


def _vectors(column: str, dimension: int):
    """The rows (as places) with a usable vector of the dimension, and their grid vectors."""

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        places, size, numbers, begin = _usable(batch, column)
        places = places[size[places] == dimension]
        at = begin[places][:, None] + np.arange(dimension)
        return places, grid(numbers[at])

    return run


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix: Householder's reduction to three diagonals, then QR steps with Wilkinson's shift."""
    a = np.array(v, dtype=np.float64)
    d = len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        if (size := np.linalg.norm(x)) == 0:
            continue
        u = x / size
        a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    diagonal, off = np.diag(a).copy(), np.append(np.diag(a, 1), 0.0).copy()
    vectors = np.ascontiguousarray(q.T)  # row i belongs to diagonal i
    tiny = np.finfo(float).eps
    high, rounds = d - 1, 0
    while high > 0:
        small = np.abs(off[:high]) <= tiny * (np.abs(diagonal[:high]) + np.abs(diagonal[1 : high + 1]))
        off[:high][small] = 0.0
        if off[high - 1] == 0.0:
            high, rounds = high - 1, 0
            continue
        if (rounds := rounds + 1) > 100 * d:
            raise ArithmeticError("QR steps did not settle")
        low = high - 1
        while low > 0 and off[low - 1] != 0.0:
            low -= 1
        half = (diagonal[high - 1] - diagonal[high]) / 2
        shift = diagonal[high] - off[high - 1] ** 2 / (half + np.copysign(np.hypot(half, off[high - 1]), half))
        # chase the bulge from low to high
        x, z = diagonal[low] - shift, off[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                off[k - 1] = r
            a0, a1, b = diagonal[k], diagonal[k + 1], off[k]
            diagonal[k], diagonal[k + 1] = c * c * a0 + 2 * c * s * b + s * s * a1, s * s * a0 - 2 * c * s * b + c * c * a1
            off[k] = c * s * (a1 - a0) + (c * c - s * s) * b
            if k < high - 1:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            vectors[[k, k + 1]] = c * vectors[k] + s * vectors[k + 1], c * vectors[k + 1] - s * vectors[k]
    order = np.argsort(-diagonal, kind="stable")
    out = vectors[order]
    return diagonal[order], (out / np.linalg.norm(out, axis=1, keepdims=True)).T


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: count, exact sums, mean as shift plus rest, components (rows) and their eigenvalues, the trace."""

    n: int
    sums: tuple[int, ...]
    shift: np.ndarray
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each component over the root of its eigenvalue."""
        return ((x - self.shift).astype(np.float64) - self.mean) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)**2; none where 64 bits can't hold it."""
        sums = np.array(self.sums, dtype=object)
        greatest = max((self.n * int(np.abs(x).max(initial=0)), *(abs(s) for s in self.sums)), default=0)
        if greatest < 1 << 61:
            off = self.n * x - sums.astype(np.int64)
            if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
                return (off * off).sum(axis=1).tolist()
        found = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(y) if y < 1 << 63 else None for y in found]


def fit(points: DataFrame, components: int) -> Whitening | None:
    """The whitening of distinct grid vectors ``points`` (x as bytes); none without two different ones."""
    decode = lambda batch: np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int64).reshape(batch.num_rows, -1)
    found = _fit(points, decode)
    if found.n < 2:
        return None
    values, vectors = eigen(found.spread / found.n)
    real = int((values[:components] > FLAT * values[0]).sum())
    rest = np.array([float((s - found.n * int(h)) / found.n) for s, h in zip(found.sums, found.shift, strict=True)])
    return Whitening(found.n, tuple(found.sums), found.shift, rest, vectors.T[:real].copy(), values[:real], float(np.trace(found.spread) / found.n))


def whiten(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = 16) -> DataFrame:
    """Each usable row of ``rows`` on each component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    A vector that is null or empty or has a null, infinite or NaN entry is left out, and so is one of
    another length than the most frequent (of several, the least), which no covariance can hold. Each
    distinct grid vector counts once in the fit. Components follow falling eigenvalues; one whose
    eigenvalue is below 1e-12 of the greatest has no direction and is left out, so that fewer than two
    different vectors give no rows. deviation is null where 64 bits can't hold it. identity_error is
    measured: the covariance of the whitened fit list against the identity. Null and repeated ids are
    kept row by row; other columns are ignored. Entries beyond 2**56 lie at the grid's end.
    """
    kind = rows.schema[row_id].dataType
    given = rows.select(F.col(row_id).alias("vec_id"), F.col(vector).alias("v"))
    result = StructType([StructField("vec_id", kind), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, size, _, _ = _usable(batch, "v")
            length, n = np.unique(size[places], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length.astype(np.int64)), pa.array(n.astype(np.int64))], ["length", "n"])

    usual = given.select("v").mapInArrow(lengths, "length long, n long").groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").first()
    nothing = rows.sparkSession.createDataFrame([], result)
    if usual is None:
        return nothing
    read = _vectors("v", usual["length"])

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.unique(read(batch)[1], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], ["x"])

    listed = checkpointed(given.select("v").mapInArrow(points, "x binary").distinct())
    model = fit(listed, components)
    if model is None:
        return nothing
    seen = _fit(listed, lambda batch: model.project(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int64).reshape(batch.num_rows, -1)))
    error = float(np.abs(seen.spread / seen.n - np.eye(len(model.values))).max())
    k = len(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                places, x = read(batch)
                ids = batch.column(0).take(pa.array(np.repeat(places, k)))
                deviation = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                each = lambda v: pa.array(np.tile(v, len(x)))
                m = len(x) * k
                arrays = [ids, each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(m, model.n)), deviation, pa.array(model.project(x).ravel()), each(model.values / model.trace), pa.array(np.full(m, error))]
                yield pa.RecordBatch.from_arrays(arrays, result.names)

    return given.mapInArrow(apply, result)
