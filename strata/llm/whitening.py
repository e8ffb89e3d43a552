"""Whitening of vectors: leading eigenpairs of their covariance by spectrum slicing.

Tasks count, sum and multiply; the driver holds one symmetric matrix of the vectors'
dimension. The number of positive pivots of the LDL' factors of V - sI is the number of
eigenvalues above s (Sylvester), so bisection on such counts isolates each eigenvalue,
Rayleigh quotient iteration refines it, and two counts beside it certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import Scratch

SCALE, SHIFT = 64, 1_000_000
#: integers beyond this are taken as this: doubles are exact up to here
LARGEST = 2**53
_SPLIT = 2**27
_BUNCH = (1 + 17**0.5) / 8


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of LDL' with complete pivoting (1x1 and 2x2)."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        size = np.abs(a)
        diagonal = np.diagonal(size)
        r = int(diagonal.argmax())
        p, q = divmod(int(size.argmax()), len(a))
        if size[p, q] == 0:
            break
        if diagonal[r] >= _BUNCH * size[p, q]:
            pivot, column = a[r, r], np.delete(a[:, r], r)
            positive += pivot > 0
            a = np.delete(np.delete(a, r, 0), r, 1) - np.outer(column, column / pivot)
        else:  # the block's largest entry is off the diagonal: one root above zero, one below
            block = a[np.ix_((p, q), (p, q))]
            columns = np.delete(a[:, (p, q)], (p, q), 0)
            positive += 1
            a = np.delete(np.delete(a, (p, q), 0), (p, q), 1) - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return positive


class Spectrum:
    """Leading eigenpairs of a symmetric positive semidefinite matrix, found one by one."""

    def __init__(self, matrix: np.ndarray):
        self.scale = float(np.abs(matrix).max()) or 1.0
        self.matrix = matrix / self.scale
        n = len(matrix)
        bound = float(np.abs(self.matrix).sum(1).max())  # Gershgorin
        self.tolerance = 8 * n * np.finfo(float).eps * bound
        self.counts = {-bound - 1.0: n, bound + 1.0: 0}
        self.values: list[float] = []
        self.vectors = np.zeros((n, 0))

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.matrix, shift)
        return self.counts[shift]

    def _slice(self, k: int) -> tuple[float, float]:
        """Bounds of the k-th largest eigenvalue from the counts so far."""
        low = max(s for s, c in self.counts.items() if c >= k)
        return low, min(s for s, c in self.counts.items() if c < k and s > low)

    def _halve(self, k: int) -> None:
        low, high = self._slice(k)
        self.above((low + high) / 2)

    def _apart(self, vector: np.ndarray) -> np.ndarray:
        for _ in range(2):
            vector = vector - self.vectors @ (self.vectors.T @ vector)
        return vector / np.linalg.norm(vector)

    def _solve(self, shift: float, vector: np.ndarray) -> np.ndarray:
        shifted = self.matrix - shift * np.eye(len(vector))
        try:
            out = np.linalg.solve(shifted, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            out = np.linalg.solve(shifted + self.tolerance * np.eye(len(vector)), vector)
        return self._apart(out)

    def next(self) -> None:
        k = len(self.values) + 1
        rng = np.random.default_rng(k)
        while True:
            low, high = self._slice(k)
            tight = high - low <= self.tolerance
            if not tight and self.above(low) - self.above(high) > 1:
                self._halve(k)
                continue
            middle = (low + high) / 2
            vector = self._apart(rng.normal(size=len(self.matrix)))
            for _ in range(2):  # inverse iteration leads into the slice
                vector = self._solve(middle, vector)
            value, last = float(vector @ self.matrix @ vector), np.inf
            for _ in range(20):
                residual = float(np.linalg.norm(self.matrix @ vector - value * vector))
                if residual >= last / 2 and residual <= self.tolerance or residual == 0:
                    break
                last = residual
                vector = self._solve(value, vector)
                value = float(vector @ self.matrix @ vector)
            off = max(self.tolerance, 2 * residual)
            if residual <= 4 * self.tolerance and self.above(value - off) >= k and self.above(value + off) < k:
                self.values.append(value)
                self.vectors = np.column_stack([self.vectors, vector])
                return
            if tight:
                raise ArithmeticError(f"eigenvalue {k} is not certified")
            self._halve(k)


def eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns; fewer if the rest are zero."""
    found = Spectrum(matrix)
    for _ in range(min(k, len(matrix))):
        if found.above(found.tolerance) <= len(found.values):
            break
        found.next()
    return np.array(found.values) * found.scale, found.vectors


def _integers(vector: Column) -> Column:
    """x = floor(64 c) + 1000000 for each entry, exact up to 2**53 and held there beyond."""

    def one(c: Column) -> Column:
        x = F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST))))
        return F.least(x + SHIFT, F.lit(LARGEST))

    return F.transform(vector, one)


def _finite(vector: Column) -> Column:
    limit = F.lit(float("inf"))
    return F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < limit, F.lit(False)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
    for batch in batches:
        x = _matrix(batch.column("x"), d)
        n += len(x)
        high += (x // _SPLIT).sum(0)
        low += (x % _SPLIT).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high.tolist()]), pa.array([low.tolist()])], ["n", "high", "low"])


class _Centre:
    """x - S/n in doubles: whole parts are subtracted as integers."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest


def _products(batches: Iterator[pa.RecordBatch], d: int, centre: _Centre, basis: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of this task's sum of outer products of centred vectors, or of their whitened projections."""
    k = d if basis is None else basis.shape[1]
    total = np.zeros((k, k))
    for batch in batches:
        y = centre(_matrix(batch.column("x"), d))
        if basis is not None:
            y = y @ basis
        total += y.T @ y
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows with one number, whichever the task holds."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
            row = np.asarray(row.values)
            sums[i] = sums[i] + row if i in sums else row
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([r.tolist() for r in sums.values()], pa.list_(pa.float64()))], ["i", "row"]
    )


def _product(fit: DataFrame, d: int, centre: _Centre, basis: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list, as a matrix: tasks add their vectors, then one task a row adds the tasks."""
    kind = "i int, row array<double>"
    rows = fit.mapInArrow(lambda b: _products(b, d, centre, basis), kind).repartition("i").mapInArrow(_added, kind).collect()
    out = np.array([r.row for r in sorted(rows, key=lambda r: r.i)])
    return (out + out.T) / 2


def _whitened(
    batches: Iterator[pa.RecordBatch], d: int, n: int, sums: list[int], centre: _Centre, basis: np.ndarray, explained: list[float], error: float
) -> Iterator[pa.RecordBatch]:
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    k = len(explained)
    rest = [s % n for s in sums]
    for batch in batches:
        x = _matrix(batch.column("x"), d)
        y = centre(x) @ basis
        whole = x - centre.whole
        # n x - S = n (x - S//n) - S%n; sums of squares beyond 64 bits take Python's integers
        if len(x) and d * (float(n) * (float(np.abs(whole).max()) + 1)) ** 2 < 2**62:
            deviation = ((whole * n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        else:
            deviation = [sum((n * w - r) ** 2 for w, r in zip(row, rest, strict=True)) for row in whole.tolist()]
            deviation = [v if v < 2**63 else None for v in deviation]
        size = len(x) * k
        whitened = np.full((len(x), k), np.nan)
        whitened[:, : y.shape[1]] = y
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, n)),
                pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                pa.array(whitened.ravel(), from_pandas=True),
                pa.array(np.tile(np.array(explained, float), len(x)), from_pandas=True),
                pa.array(np.full(size, error), from_pandas=True),
            ],
            names,
        )


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, scratch: Scratch, components: int = 16) -> DataFrame:
    """Whitened coordinates of every usable row: one row per row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and
    so are vectors of another length than most usable rows have (of two such lengths the
    longer counts). Entries become integers x = floor(64 c) + 1000000, held within 2**53.
    Statistics are over the distinct integer vectors: n of them, sums S, covariance V
    (divisor n, centred first). ``component`` counts eigenvectors from 1 by falling
    eigenvalue e, up to ``components`` or the dimension; ``whitened`` is x - S/n projected
    and divided by the root of e, ``explained`` e / trace(V), ``deviation`` the exact sum
    of (n x - S)**2 (null beyond 64 bits), ``identity_error`` how far the covariance of
    ``whitened`` over the distinct vectors is from the identity. Components without
    variance have null ``whitened`` and explain 0; without any variance (a single distinct
    vector) explained is null, and without a component with variance so is the error.

    Equal rows give equal rows, vec_id may be null; other columns are ignored, an empty
    table gives no rows. The driver holds one matrix of the dimension and its sums.
    """
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & _finite(F.col("embedding")))
    sizes = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    d = sizes.d
    rows = usable.where(F.size("embedding") == d).select(F.col("vec_id").cast("long").alias("vec_id"), _integers(F.col("embedding")).alias("x"))
    fit = scratch.table(rows.select("x").distinct(), "fit")
    partial = fit.mapInArrow(lambda b: _sums(b, d), "n long, high array<long>, low array<long>")
    each = partial.select("n", F.posexplode(F.arrays_zip("high", "low")))
    found = each.groupBy("pos").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(a) for a, c in (("n", "n"), ("high", "col.high"), ("low", "col.low")))).collect()
    found = sorted(found, key=lambda r: r.pos)
    n, sums = int(found[0].n), [int(r.high) * _SPLIT + int(r.low) for r in found]
    centre = _Centre(n, sums)
    covariance = _product(fit, d, centre) / n
    trace = float(np.trace(covariance))
    k = min(components, d)
    values, basis = eigenpairs(covariance, k)
    basis = basis / np.sqrt(values)
    explained: list[float | None] = [None] * k if trace == 0 else [*(values / trace).tolist(), *[0.0] * (k - len(values))]
    error = float("nan")
    if len(values):
        error = float(np.abs(_product(fit, d, centre, basis) / n - np.eye(len(values))).max())
    shown = [float("nan") if v is None else v for v in explained]
    return rows.mapInArrow(lambda b: _whitened(b, d, n, sums, centre, basis, shown, error), RESULT)
