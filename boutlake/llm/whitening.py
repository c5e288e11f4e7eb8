"""Whitening of vectors by a covariance from polarisation.

Entries become whole numbers on a fixed grid, so that all sums are exact. The
variance of every dimension and of every sum of two dimensions is aggregated, and

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2

gives the covariances as exact fractions, rounded once when the matrix is put
together for eigh. Rows are centred before anything is squared: by the whole part
of the mean in the tasks, and by its fraction, exactly, when the sums are joined.
What is gathered is a number for each pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlake.llm.common import quoted

SCALE, SHIFT = 1024, 100_000
FEW = 4096


@dataclass(frozen=True)
class Whitening:
    """The fit of one vector length: ``n`` rows with sums ``total`` per dimension; unit eigenvectors as columns, eigenvalues falling."""

    n: int
    total: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def real(self) -> np.ndarray:
        """Which eigenvalues are not zero to double precision; other components carry nothing."""
        return self.values > len(self.total) * np.finfo(float).eps * max(self.trace, 0.0)


def grid(column: pa.Array, dim: int) -> np.ndarray:
    """Entries of vectors of one length as whole numbers floor(SCALE * c) + SHIFT."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim) * SCALE)
    if x.size and np.abs(x).max() >= 2.0**62:
        raise OverflowError("an entry is beyond the grid of 64-bit whole numbers")
    return x.astype(np.int64) + SHIFT


def _exact(z: np.ndarray, terms: int) -> np.ndarray:
    """``z`` itself where ``terms`` squares of sums of two of its entries fit 64 bits, else as unbounded integers."""
    top = int(np.abs(z).max(initial=0))
    return z if 4 * top * top * terms < 2**63 else z.astype(object)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is neither null nor holds a null or non-finite entry."""
    finite = F.forall(F.col(quoted(vec_col)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vec_col)).alias("v"))


def _by_length(batch: pa.RecordBatch, column: int):
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
        for lo in range(0, part.num_rows, FEW):
            some = part.slice(lo, FEW)
            yield dim, some, grid(some.column(column), dim)


def _sums(v: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of rows and sum of every dimension, for each vector length."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for dim, _, x in _by_length(b, 0):
                n, s = held.setdefault(dim, [0, np.zeros(dim, object)])
                held[dim] = [n + len(x), s + (x - SHIFT).astype(object).sum(axis=0) + SHIFT * len(x)]
        for dim, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()), pa.array([str(x) for x in (n, *s)])], names=["dim", "i", "s"])

    out: dict[int, tuple[int, list[int]]] = {}
    parts = v.select("v").mapInArrow(run, "dim int, i int, s string").groupBy("dim", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for r in parts.orderBy("dim", "i").collect():  # a number for each dimension
        if r.i < 0:
            out[r.dim] = (int(r.s), [])
        else:
            out[r.dim][1].append(int(r.s))
    return out


def _squares(v: DataFrame, whole: dict[int, np.ndarray]) -> dict[int, dict[tuple[int, int], int]]:
    """Sums of squares of every centred dimension (i, i) and of every sum of two (i, j)."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in _by_length(b, 0):
                z = x - whole[dim]
                z = _exact(z, len(z))
                q = held.setdefault(dim, np.zeros((dim, dim), object))
                for i in range(dim):
                    q[i, i] += int((z[:, i] * z[:, i]).sum())
                    if i + 1 < dim:
                        two = z[:, i + 1 :] + z[:, i : i + 1]
                        q[i, i + 1 :] += (two * two).sum(axis=0)
        for dim, q in held.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(x) for x in q[i, j]])], names=["dim", "i", "j", "q"])

    out: dict[int, dict[tuple[int, int], int]] = {dim: {} for dim in whole}
    parts = v.select("v").mapInArrow(run, "dim int, i int, j int, q string").groupBy("dim", "i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q"))
    for r in parts.toLocalIterator():  # a number for each pair of dimensions
        out[r.dim][r.i, r.j] = int(r.q)
    return out


def covariance(n: int, total: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix (divisor n) from sums of squares about the whole part of the mean, each entry rounded once."""
    d = len(total)
    rest = [s % n for s in total]  # n times the fraction of the mean
    var = lambda i, j: n * squares[i, j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2  # noqa: E731  n^2 times a variance
    out = np.zeros((d, d))
    single = [var(i, i) for i in range(d)]
    for i in range(d):
        out[i, i] = float(Fraction(single[i], n * n))
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = float(Fraction(var(i, j) - single[i] - single[j], 2 * n * n))
    return out


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> dict[int, Whitening]:
    """The whitening of each vector length among the usable rows; lengths have lists of their own."""
    v = usable(vectors, id_col, vec_col)
    sums = _sums(v)
    squares = _squares(v, {dim: np.array([s // n for s in total], np.int64) for dim, (n, total) in sums.items()})
    out = {}
    for dim, (n, total) in sums.items():
        cov = covariance(n, total, squares[dim])
        values, axes = np.linalg.eigh(cov)
        out[dim] = Whitening(n, tuple(total), values[::-1].copy(), axes[:, ::-1].copy(), float(np.trace(cov)))
    return out


def apply(vectors: DataFrame, models: dict[int, Whitening], components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, n, deviation, whitened, explained) of every usable row, the last two as arrays over the first ``components``.

    deviation (sum over dimensions of (n*x - S)^2) is exact, as decimal(38). A component
    whose eigenvalue is zero to double precision has a null whitened value; without any
    variance explained is null too. A length that wasn't fitted raises.
    """
    v = usable(vectors, id_col, vec_col)

    def run(batches):
        for b in batches:
            for dim, part, x in _by_length(b, 1):
                m = models[dim]
                k, total = min(components, dim), np.array(m.total, object)
                small = int(np.abs(x).max(initial=0)) * m.n < 2**62 and max(map(abs, m.total)) < 2**62
                y = x * m.n - total.astype(np.int64) if small else x.astype(object) * m.n - total
                sq = _exact(y, dim)
                w = (y / m.n).astype(np.float64) @ (m.vectors[:, :k] / np.sqrt(np.where(m.real[:k], m.values[:k], 1.0)))
                w[:, ~m.real[:k]] = np.nan
                part_of = [float(e) / m.trace if m.trace > 0 else None for e in m.values[:k]]
                ends = pa.array(np.arange(0, k * len(x) + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.full(len(x), dim), pa.int32()), pa.array(np.full(len(x), m.n), pa.int64()), pa.array([str(d) for d in (sq * sq).sum(axis=1)]),
                        pa.ListArray.from_arrays(ends, pa.array(w.ravel(), from_pandas=True)), pa.ListArray.from_arrays(ends, pa.array(part_of * len(x), pa.float64())),
                    ],
                    names=["id", "dim", "n", "deviation", "whitened", "explained"],
                )

    id_type = v.schema["id"].dataType.simpleString()
    return v.mapInArrow(run, f"id {id_type}, dim int, n long, deviation string, whitened array<double>, explained array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(applied: DataFrame, components: int = 8) -> DataFrame:
    """(dim, identity_error): the largest absolute entry of the whitened values' covariance (divisor n) minus the identity. Null components are left out."""
    w = [F.try_element_at("whitened", F.lit(i + 1)) for i in range(components)]
    off = {f"c{i}_{j}": F.abs(F.covar_pop(w[i], w[j]) - float(i == j)) for i in range(components) for j in range(i, components)}
    return applied.groupBy("dim").agg(*[c.alias(name) for name, c in off.items()]).select("dim", F.array_max(F.array(*off)).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error of every usable row.

    Rows whose vector is null or holds a null or non-finite entry are left out, and take
    no part in the fit; an empty vector has no component and so no row. Repeated rows and
    null ids count as rows. Vectors of each length are a list of their own. Other columns
    are not read. An empty table gives no row. The vectors are read four times: for the
    sums, the squares, the check of the result and the result.
    """
    applied = apply(vectors, fit(vectors, id_col, vec_col), components, id_col, vec_col)
    checked = applied.join(F.broadcast(identity_error(applied, components)), "dim")  # a row per vector length
    each = checked.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
