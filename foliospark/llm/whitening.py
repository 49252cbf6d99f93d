"""Whitening of embeddings by shifted Cholesky QR.

The centred vectors are the rows of a tall matrix A. Each pass adds up the Gram matrix of the rows as they stand
(one small matrix per task, summed by Spark cell by cell), takes its Cholesky factor and goes on with the rows
solved by it. The first factor is of the Gram matrix plus a small shift, so it exists however badly conditioned A is;
two more passes without a shift make the rows orthonormal to machine precision. Rows are never written: a pass
solves them again by the factors so far. The factors compose to R with A = QR, and the singular values and right
vectors of R are those of A: variances and components, without ever squaring the condition number as an
eigendecomposition of the covariance does.

Only d x d matrices and sums over the rows reach the driver; d is the length of a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
PASSES = 3
LARGEST = float(1 << 52)  # of an entry times SCALE; beyond it no integer is exact in a double
LONG = (1 << 63) - 1
_EPS = float(np.finfo(float).eps)


class Fitted(NamedTuple):
    """``n`` rows with sums ``s``; ``axes`` are the columns to project on, ``sizes`` their variances, ``trace`` all variance.

    ``identity_error`` is the largest absolute entry of the whitened rows' covariance less the identity.
    """

    n: int
    s: list[int]
    axes: np.ndarray
    sizes: np.ndarray
    trace: float
    identity_error: float = 0.0


def integers(vector: Column) -> Column:
    """The vector in whole numbers, floor(1024 c) + 100000 of each entry; null if an entry is null, not finite or too large."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < LARGEST, F.lit(False)))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)
    return F.when(usable & (F.size(vector) > 0), whole)


def usable(vectors: DataFrame, vector: str = "embedding", name: str = "_x") -> tuple[DataFrame, int]:
    """The rows whose vector can be used, with it in whole numbers as column ``name``, and its length.

    Left out are rows whose vector is null or empty, has a null or non-finite entry, an entry of 2^42 or more in size,
    or another length than most have (the shorter one on a tie).
    """
    rows = vectors.withColumn(name, integers(F.col(vector))).where(F.col(name).isNotNull())
    common = rows.groupBy(F.size(name).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 0
    return rows.where(F.size(name) == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - s / n, from exact whole numbers where n x fits in 64 bits."""
    if max(int(np.abs(x).max(initial=0)) * n, *map(abs, s), 0) < LONG // 2:
        return (x * n - np.array(s, np.int64)) / n
    return x - np.array([a / n for a in s])


def gram(rows: DataFrame, d: int, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of q'q, where q is a row of ``prepare(x)``; each task adds up its own rows first."""
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                q = prepare(batch.column(0))
                total += q.T @ q
        columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "g"])

    cells = rows.mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros((d, d))
    i, j = cells.column("i").to_numpy(), cells.column("j").to_numpy()
    out[i, j] = out[j, i] = cells.column("g").to_numpy()
    return out


def solved(q: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """q times the inverses of the upper triangular factors, first to last, by forward substitution."""
    for r in factors:
        out = np.empty_like(q)
        for j in range(len(r)):
            out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        q = out
    return q


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor of ``g``; shifted if asked for, or if ``g`` is singular to rounding."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * _EPS * max(float(np.linalg.norm(g, 2)), np.finfo(float).tiny)
    at = shift if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + at * np.eye(d)).T
        except np.linalg.LinAlgError:
            at = at * 10 or shift


def fit(rows: DataFrame, d: int, x: str = "_x", components: int = COMPONENTS) -> Fitted | None:
    """Mean, variances and components of all rows of ``usable``; None for an empty table.

    Directions without variance (up to rounding) give no component, so there are fewer than ``components`` for few
    rows, short vectors or a table of one repeated row.
    """
    only = rows.select(x)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, object), 0
        for batch in batches:
            found = matrix(batch.column(0), d)
            fits = np.abs(found).max(initial=0) < LONG // max(len(found), 1)
            total, n = total + (found.sum(axis=0) if fits else found.astype(object).sum(axis=0)), n + len(found)
        columns = [pa.array(range(d), pa.int32()), pa.array([str(v) for v in total]), pa.array([n] * d, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["j", "s", "n"])

    if not d:
        return None
    added = only.mapInArrow(sums, "j int, s string, n bigint").groupBy("j")
    found = added.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("j").collect()
    n, s = found[0]["n"], [int(r["s"]) for r in found]

    factors: list[np.ndarray] = []
    r = np.eye(d)
    variance = np.zeros(d)
    for turn in range(PASSES):
        g = gram(only, d, lambda column: solved(centred(matrix(column, d), n, s), factors))
        if not turn:
            variance = np.diag(g) / n
            if not variance.any():
                return Fitted(n, s, np.zeros((d, 0)), np.zeros(0), 0.0)
        factors = [*factors, factor(g, n, shifted=not turn)]
        r = factors[-1] @ r
    _, values, turned = np.linalg.svd(r)
    sizes = values**2 / n
    kept = min(components, int((values > values[0] * max(n, d) * _EPS).sum()))
    axes = turned[:kept].T / np.sqrt(sizes[:kept])
    found = gram(only, kept, lambda column: centred(matrix(column, d), n, s) @ axes)
    return Fitted(n, s, axes, sizes[:kept], float(variance.sum()), float(np.abs(found / n - np.eye(kept)).max()))


def whiten(
    vectors: DataFrame, keep: list[str], vector: str = "embedding", *, components: int = COMPONENTS
) -> tuple[DataFrame, Fitted | None]:
    """Whiten every usable vector; returns a row per vector with the columns ``keep`` and these, and the fit.

    ``deviation`` bigint is the sum over entries of (n x - s)^2, exact, null where it does not fit; ``whitened``
    array<double> holds the components. ``usable`` says which rows are left out. Repeated rows count and are returned
    each, a null id is kept. Names in ``keep`` may be any but the two of the result; other columns are not read.
    """
    name = "_x_" + "_".join(keep)  # clashes with no kept column, being longer
    rows, d = usable(vectors, vector, name)
    rows = rows.select(name, *keep)
    model = fit(rows, d, name, components)
    fields = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*rows.select(*keep).schema.fields, *fields])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    n, s, axes = model.n, model.s, model.axes

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), d)
            done = centred(x, n, s) @ axes
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * axes.shape[1], pa.int32()), pa.array(done.ravel())
            )
            found = [pa.array(deviations(x, n, s), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], [*keep, "deviation", "whitened"])

    return rows.mapInArrow(project, schema), model


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sum over entries of (n x - s)^2 for each row, in whole numbers; None where it is no 64-bit integer."""
    rough = max(int(np.abs(x).max(initial=0)) * n, *map(abs, s), 1)
    if rough < LONG // 2:
        moved = x * n - np.array(s, np.int64)
        if int(np.abs(moved).max(initial=0)) ** 2 * x.shape[1] < LONG:
            return (moved * moved).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(s, object)) ** 2).sum(axis=1)
    return [v if v <= LONG else None for v in exact.tolist()]
