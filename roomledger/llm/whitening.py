"""Whitening of embeddings by mixed-precision refined eigenvectors.

Every entry c of a vector becomes the integer ``x = floor(SCALE * c) + SHIFT``.

1. Tasks sum the x-vectors; the rounded mean m is taken off, and tasks sum
   ``y = x - m`` and the products ``y y'`` of whole batches.  All sums are
   integers (double products below 2**53, else Python integers), added up by
   Spark as decimals, so they are exact and the same in any partitioning; with
   them ``n**2`` times the covariance is an exact integer matrix.
2. Its eigenvectors are first found in single precision.  Iterations of Ogita
   and Aishima correct them by matrix products in extended precision: each
   gives ``E`` with ``X (I + E)`` nearer to orthonormal eigenvectors, at
   quadratic speed where eigenvalues are apart.
3. Where they are not (closer than the present error bound), the vectors of a
   cluster are made orthonormal and turned by the eigenvectors of the small
   problem ``X' (V - mu I) X``, in which the cluster's eigenvalues are apart;
   then the iterations go on.
4. Tasks project the centred vectors on the components over the square roots
   of their eigenvalues, and the covariance of what they wrote is compared
   with the identity.

The driver holds matrices of dimension x dimension, whatever the number of
rows; it asks for ``d * (d + 1) / 2`` sums.

Defined results: null vectors, those with null or non-finite components or ones
of 2**53 / SCALE or more, and those of another length than most (ties: the
longer) take no part; rows of one vec_id are rows of their own; equal
eigenvalues share any orthonormal vectors of their space, the same for all
rows; components without variance (within rounding, ``RANK`` of the largest)
can't be whitened and are left out, so one vector or equal vectors give no
rows; an empty table gives an empty result; ``deviation`` is null beyond a
long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.llm.common import save

SCALE = 64  # fixed by the contract, as SHIFT
SHIFT = 1_000_000
EXACT = 1 << 53
RANK = 1e-13  # of the largest eigenvalue, per dimension: below, a component has no variance
ROUNDS = 60
HIGH = np.longdouble
BATCH = 4_096  # vectors handled at a time in a task


# ---------------------------------------------------------------- rows

def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that take part, as (vec_id, x)."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(EXACT // SCALE)))
    some = vectors.where(v.isNotNull()).where(fine)
    sizes = some.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT).cast("long"))
    return some.where(F.size(v) == (sizes["size"] if sizes else 0)).select("vec_id", x.alias("x"))


def rows_of(column) -> np.ndarray:
    """Rows of an Arrow list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cut(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


# ---------------------------------------------------------------- exact sums

def product(y: np.ndarray) -> np.ndarray:
    """``y' y`` of integers, exact: as doubles if no sum can reach 2**53, else as Python integers."""
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < EXACT:
        d = y.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    some = y.astype(object)
    return some.T @ some


SUMS = "i int, j int, total decimal(38,0), n long"


def _sums(mean: np.ndarray | None):
    """One row for each i <= j of a task: the sum of y_i * y_j; rows with j = -1 hold the sums of y_i."""
    def run(batches):
        n, line, square = 0, None, None
        for batch in _cut(batches):
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("x"))
            y = x if mean is None else x - mean
            n += len(y)
            part = y.astype(object).sum(0) if np.abs(y).max(initial=0) >= EXACT // BATCH else y.sum(0).astype(object)
            line = part if line is None else line + part
            if mean is not None:
                part = product(y)
                square = part if square is None else square + part
        if not n:
            return
        at = [(i, -1, line[i]) for i in range(len(line))]
        if square is not None:
            at += [(i, j, square[i, j]) for i in range(len(line)) for j in range(i, len(line))]
        i, j, total = zip(*at)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                          pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
                                          pa.array([n] * len(i), pa.int64())], names=["i", "j", "total", "n"])
    return run


def summed(rows: DataFrame, mean: np.ndarray | None) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """n, the sums of y = x - mean for each dimension, and those of the products (i <= j) if there is a mean."""
    found = (rows.select("x").mapInArrow(_sums(mean), SUMS).groupBy("i", "j")
             .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())  # d * (d + 3) / 2 rows
    line = {r["i"]: int(r["total"]) for r in found if r["j"] < 0}
    n = found[0]["n"] if found else 0
    return n, [line[i] for i in range(len(line))], {(r["i"], r["j"]): int(r["total"]) for r in found if r["j"] >= 0}


def scatter(n: int, line: list[int], square: dict[tuple[int, int], int]) -> np.ndarray:
    """``n**2`` times the covariance, of exact integers."""
    out = np.empty((len(line), len(line)), object)
    for (i, j), total in square.items():
        out[i, j] = out[j, i] = n * total - line[i] * line[j]
    return out


# ---------------------------------------------------------------- eigenvectors

def norm(a: np.ndarray) -> float:
    """A bound of the 2-norm."""
    return float(np.sqrt(np.abs(a).sum(0).max(initial=0) * np.abs(a).sum(1).max(initial=0)))


def correction(a: np.ndarray, x: np.ndarray):
    """One step of Ogita and Aishima: the eigenvalues of ``x``, by how far they may be off, and E, in the precision of ``a``.

    Pairs of eigenvalues that are not farther apart than that only get their
    part of making ``x`` orthonormal.
    """
    r = np.eye(x.shape[1], dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = 2 * (norm(s - np.diag(np.diag(s))) + norm(a) * norm(r))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= off
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
    return values, off, e


def clusters(values: np.ndarray, off: float) -> list[np.ndarray]:
    """Places of eigenvalues that are chained by gaps of at most ``off``, two at least."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order]) > off) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def orthonormal(x: np.ndarray) -> np.ndarray:
    """The nearest orthonormal columns, by Newton's iteration in the precision of ``x``."""
    for _ in range(20):
        r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
        x = x + x @ r / 2
        if norm(r) < 4 * x.shape[1] * np.finfo(x.dtype).eps:
            break
    return x


def eigen(a: np.ndarray, start=np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors, as columns, of the symmetric ``a``, right to double precision."""
    a = a.astype(HIGH)
    scale = np.abs(a).max(initial=0)
    d = len(a)
    if not scale > 0:
        return np.zeros(d, HIGH), np.eye(d, dtype=HIGH)
    a = a / scale
    x = orthonormal(np.linalg.eigh(a.astype(start))[1].astype(HIGH))
    enough = np.finfo(np.float64).eps / 64
    was = np.inf
    for _ in range(ROUNDS):
        values, off, e = correction(a, x)
        x = x + x @ e
        size = norm(e)
        if size < enough:
            values, off, _ = correction(a, x)
            groups = clusters(values, off)
            if not any(_turn(a, x, values, c, enough) for c in groups):
                break
            was = np.inf
        elif size > was / 2:  # no nearer: turn the clusters
            for c in clusters(values, off):
                _turn(a, x, values, c, enough)
            was = np.inf
        else:
            was = size
    x = orthonormal(x)
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _turn(a: np.ndarray, x: np.ndarray, values: np.ndarray, c: np.ndarray, enough: float) -> bool:
    """Turn the columns ``c`` of ``x`` by the eigenvectors of their own small problem; whether that moved them."""
    some = orthonormal(x[:, c])
    mu = values[c].mean()
    small = some.T @ (a @ some) - mu * np.eye(len(c), dtype=a.dtype)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if not size > 4 * len(a) * np.finfo(a.dtype).eps:  # equal within the precision: any vectors of the space will do
        x[:, c] = some
        return False
    off = norm(small - np.diag(np.diag(small)))
    turn = np.linalg.eigh((small / size).astype(np.float64))[1].astype(a.dtype)
    x[:, c] = some @ orthonormal(turn)
    return off > enough * float(size)


# ---------------------------------------------------------------- the operator

class Whitener(NamedTuple):
    """What whitens: rows ``x`` become ``(x - total / n) . vectors / sqrt(values)``."""

    n: int
    mean: np.ndarray  # rounded
    line: list[int]  # sums of x - mean
    values: np.ndarray  # of the covariance, falling
    vectors: np.ndarray  # columns
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean).astype(HIGH)
        centred = (y * self.n - np.array(self.line, HIGH)) / self.n
        return centred.astype(np.float64) @ (self.vectors / np.sqrt(self.values)).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y = x - self.mean
        line = np.array(self.line, object)
        if float(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.line)) < (1 << 63) ** 0.5 / (2 * len(line)):
            return ((y * self.n - line.astype(np.int64)) ** 2).sum(1).tolist()
        some = ((y.astype(object) * self.n - line) ** 2).sum(1).tolist()
        return [int(v) if v < 1 << 63 else None for v in some]


def fit(rows: DataFrame, components: int | None = None) -> Whitener | None:
    """The whitener of the rows' column ``x``; None without rows."""
    n, line, _ = summed(rows, None)
    if not n:
        return None
    mean = np.array([(2 * s + n) // (2 * n) for s in line], np.int64)
    _, line, square = summed(rows, mean)
    exact = scatter(n, line, square)
    trace = sum(exact[i, i] for i in range(len(line)))
    values, vectors = eigen(high(exact))
    values = values / (HIGH(n) * n)
    full = values > max(float(values.max(initial=0)), 0.0) * RANK * len(line)
    keep = np.flatnonzero(full)[:components]
    return Whitener(n, mean, line, values[keep], vectors[:, keep], float(trace / (n * n)))


def high(exact: np.ndarray) -> np.ndarray:
    """Integers of any size in extended precision: the nearest double, and what it misses."""
    near = exact.astype(np.float64)
    rest = np.frompyfunc(lambda v, d: float(v - int(d)), 2, 1)(exact, near).astype(np.float64)
    return near.astype(HIGH) + rest.astype(HIGH)


def identity_error(table: DataFrame, column: str) -> float:
    """The largest absolute entry of the covariance of ``column`` (arrays of one length) less the identity.

    Each task gives the mean of its rows and the products of what they are off
    it; both are put together as groups of a pooled covariance are.
    """
    def run(batches):
        n, mean, square = 0, 0.0, 0.0
        for batch in _cut(batches):
            if batch.num_rows:
                w = rows_of(batch.column(column))
                m = w.mean(0)
                square = square + (w - m).T @ (w - m) + np.outer(m - mean, m - mean) * (n * len(w) / (n + len(w)))
                mean = mean + (m - mean) * (len(w) / (n + len(w)))
                n += len(w)
        if n:
            d = len(mean)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([n] * len(i), pa.int64()), pa.array(mean[i]),
                                              pa.array(mean[j]), pa.array(square.ravel())], names=["i", "j", "n", "a", "b", "s"])

    parts = table.select(column).mapInArrow(run, "i long, j long, n long, a double, b double, s double")
    n = F.col("n")
    cells = parts.groupBy("i", "j").agg(  # s + n a b adds up; what is taken off again is near 0, as whitened means are
        F.sum(n).alias("n"), F.sum(F.col("s") + n * F.col("a") * F.col("b")).alias("s"),
        F.sum(n * F.col("a")).alias("a"), F.sum(n * F.col("b")).alias("b"))
    entry = F.col("s") / n - F.col("a") / n * (F.col("b") / n) - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return cells.agg(F.max(F.abs(entry))).first()[0]


OUT = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()),
                    T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                    T.StructField("identity_error", T.DoubleType())])


def transform(rows: DataFrame, model: Whitener) -> DataFrame:
    """(vec_id, deviation, whitened) of every row, whitened as an array."""
    def run(batches):
        for batch in _cut(batches):
            if batch.num_rows:
                x = rows_of(batch.column("x"))
                w = model.whitened(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(model.deviation(x), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))],
                    names=["vec_id", "deviation", "whitened"])
    return rows.mapInArrow(run, T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType),
                                              T.StructField("deviation", T.LongType()),
                                              T.StructField("whitened", T.ArrayType(T.DoubleType()))]))


def whiten(vectors: DataFrame, components: int = 32, vector: str = "embedding") -> DataFrame:
    """One row for each row of ``vectors`` that takes part and each of the first ``components``."""
    rows = whole(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector), vector)
    model = fit(rows, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], OUT)
    table = save(transform(rows, model), "whitened")
    share = F.array(*[F.lit(float(v) / model.trace) for v in model.values])
    return (table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", F.element_at(share, (F.col("at") + 1).cast("int")).alias("explained"),
                    F.lit(identity_error(table, "whitened")).alias("identity_error")))
