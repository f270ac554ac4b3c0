"""Embedding whitening by pivoted Cholesky and one-sided Jacobi (operator 12).

Entries become whole numbers x = floor(64 c) + 1,000,000.  Three small
aggregations over the rows give the model: the sums of every dimension, the
scatter of the rows centred at the whole part of the mean (whole numbers again,
so partial sums add up without rounding in any order), and at the end the
covariance of the whitened rows as a check.  A task sends one row for each
pair of dimensions, whatever its rows, and Spark adds them up by pair; what
the driver reads is bounded by the square of the dimension.

The covariance matrix V is factored by Cholesky with diagonal pivoting,
V = A A' with A a permuted lower triangular factor of V's rank.  One-sided
Jacobi rotates the columns of A until they are orthogonal: their squared norms
are the eigenvalues of V and the normalised columns its eigenvectors.  V itself
is never squared or inverted, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Rows turned into one matrix at a time.
ROWS = 4096
#: Entries stay within this, so that whole numbers cannot leave 64 bits.
FAR = float(2**61)
#: Pivots below this share of the largest variance end the factor: V's rank is reached.
RANK = 1e-14
SWEEPS = 60


def quantised(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The batch's vectors as rows of whole numbers."""
    column = batch.column("vector")
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(values * SCALE), -FAR, FAR).astype(np.int64) + OFFSET


def blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _whole_sums(x: np.ndarray) -> list[int]:
    """Exact column sums as Python integers."""
    if not len(x) or float(np.abs(x).max()) * len(x) < 2**62:
        return [int(s) for s in x.sum(axis=0)]
    return [sum(map(int, column)) for column in x.T]


@dataclass
class Fit:
    """Exact sums of the fit list: rows, sums by dimension, the whole part of each mean and what remains of the sums."""

    rows: int
    sums: list[int]

    def __post_init__(self):
        self.base = np.array([s // self.rows for s in self.sums], np.int64)
        self.rest = [s % self.rows for s in self.sums]
        #: Mean minus its whole part, 0 to 1.
        self.part = np.array([float(Fraction(r, self.rows)) for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; the difference to the whole part is exact."""
        return (x - self.base).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null where a long cannot hold it."""
        away = x - self.base
        most = (float(np.abs(away).max(initial=0)) + 1) * self.rows
        if most * most * x.shape[1] < 2**62:
            scaled = away * self.rows - np.array(self.rest, np.int64)
            return (scaled * scaled).sum(axis=1).tolist()
        exact = [sum((int(a) * self.rows - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in away]
        return [v if v < 2**63 else None for v in exact]

    def covariance(self, scatter: np.ndarray) -> np.ndarray:
        """From the scatter about the whole parts; what they leave to the means is taken off in exact fractions."""
        n, out = self.rows, np.empty_like(scatter)
        for i in range(len(out)):
            for j in range(i + 1):
                out[i, j] = out[j, i] = float(Fraction(scatter[i, j]) / n - Fraction(self.rest[i] * self.rest[j], n * n))
        return out


def pivoted_cholesky(v: np.ndarray, least: float = RANK) -> np.ndarray:
    """A (dimension x rank) with A A' = v; the rows of A taken in pivot order are lower triangular."""
    left, factor = np.diag(v).copy(), []
    stop = least * max(left.max(initial=0.0), 0.0)
    for _ in range(len(v)):
        pivot = int(left.argmax())
        if left[pivot] <= stop:
            break
        column = v[:, pivot].copy()
        for done in factor:
            column -= done * done[pivot]
        column /= np.sqrt(left[pivot])
        # Rows that were pivots before have nothing left.
        column[left == -np.inf] = 0.0
        factor.append(column)
        left = left - column * column
        left[pivot] = -np.inf
    return np.column_stack(factor) if factor else np.zeros((len(v), 0))


def one_sided_jacobi(a: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms (falling) and normalised columns of ``a`` rotated until its columns are orthogonal.

    A sweep meets every two columns once, in rounds of disjoint pairs that are
    rotated together.
    """
    a = a.copy()
    m = a.shape[1]
    if m % 2:
        a = np.column_stack([a, np.zeros(len(a))])
    seats = np.arange(a.shape[1])
    half = len(seats) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            i, j = seats[:half], seats[half:][::-1]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), scale, out=np.zeros_like(xy), where=scale > 0)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > 1e-16
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst < 1e-15:
            break
    norms = (a * a).sum(axis=0)
    order = np.argsort(-norms, kind="stable")[:m]
    norms = norms[order]
    lengths = np.sqrt(norms)
    return norms, np.divide(a[:, order], lengths, out=np.zeros((len(a), m)), where=lengths > 0)


def _added_up(rows: DataFrame, cells: Callable[[Iterator[pa.RecordBatch]], tuple[list, pa.DataType]], kind: str) -> dict[int, object]:
    """Sums by cell of what each task has gathered; a task sends each of its cells once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, dtype = cells(batches)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array(values, dtype)], ["cell", "value"])

    sums = rows.mapInArrow(run, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    return {r["cell"]: r["value"] for r in sums.collect()}


def _square(found: dict[int, float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for at, (i, j) in enumerate(zip(*np.tril_indices(size), strict=True)):
        out[i, j] = out[j, i] = found.get(at, 0.0)
    return out


@dataclass
class Whitener:
    """The model: exact sums, eigenvalues (falling) and components as columns."""

    fit: Fit
    values: np.ndarray
    components: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ self.components / np.sqrt(self.values)


def usable(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Rows with a whole finite vector as ``vector`` (doubles) beside the kept columns, and the dimension.

    Null vectors and those with a null or non-finite entry go; so do vectors
    shorter than the longest, which lack entries.
    """
    given = vectors.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = given.where(F.col("vector").isNotNull() & finite)
    dim = given.agg(F.max(F.size("vector")).alias("dim")).first()["dim"] or 0
    return given.where(F.size("vector") == dim), dim


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener | None:
    """The model of :func:`usable` rows; None without rows or dimensions."""
    if not dim:
        return None

    def sums(batches):
        total, n = [0] * dim, 0
        for batch in blocks(batches):
            x = quantised(batch, dim)
            total, n = [a + b for a, b in zip(total, _whole_sums(x), strict=True)], n + len(x)
        return [n, *total], pa.decimal128(38, 0)

    found = _added_up(rows.select("vector"), sums, "decimal(38,0)")
    n = int(found.get(0) or 0)
    if not n:
        return None
    exact = Fit(n, [int(found[1 + i]) for i in range(dim)])
    base, lower = exact.base, np.tril_indices(dim)

    def scatter(batches):
        total = np.zeros((dim, dim))
        for batch in blocks(batches):
            away = (quantised(batch, dim) - base).astype(np.float64)
            total += away.T @ away
        return total[lower].tolist(), pa.float64()

    v = exact.covariance(_square(_added_up(rows.select("vector"), scatter, "double"), dim))
    norms, columns = one_sided_jacobi(pivoted_cholesky(v))
    count = min(components, int((norms > 0).sum()))
    return Whitener(exact, norms[:count], columns[:, :count], float(np.trace(v)))


def identity_error(rows: DataFrame, dim: int, model: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity: their means first, then the centred scatter."""
    count, n = len(model.values), model.fit.rows
    lower = np.tril_indices(count)

    def totals(batches):
        total = np.zeros(count)
        for batch in blocks(batches):
            total += model.project(quantised(batch, dim)).sum(axis=0)
        return total.tolist(), pa.float64()

    found = _added_up(rows.select("vector"), totals, "double")
    means = np.array([found[i] / n for i in range(count)])

    def scatter(batches):
        total = np.zeros((count, count))
        for batch in blocks(batches):
            away = model.project(quantised(batch, dim)) - means
            total += away.T @ away
        return total[lower].tolist(), pa.float64()

    covariance = _square(_added_up(rows.select("vector"), scatter, "double"), count) / n
    return float(np.abs(covariance - np.eye(count)).max(initial=0.0))


def whiten(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, numbered from 1 by falling eigenvalue.

    The id, component, n (usable rows), deviation, whitened, explained (share
    of the trace) and identity_error (one value).  Other columns are ignored,
    whatever their names.  Null vectors, vectors with null or non-finite
    entries and vectors shorter than the longest have no rows; a null id and
    repeated rows count like any other.  Components without variance cannot be
    whitened and are left out, so equal vectors alone, like an empty table,
    give an empty table.  Entries beyond 2^61 / 64 count as that; a deviation
    that a long cannot hold is null.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    rows, dim = usable(vectors, vector, (id_column,))
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, dim, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, dim, model)
    count, explained = len(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x = quantised(batch, dim)
            size = len(x) * count
            which = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column).take(which),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, model.fit.rows, np.int64)),
                    pa.array(model.fit.deviations(x), pa.int64()).take(which),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(size, error)),
                ],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
