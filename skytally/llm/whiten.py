"""Whitening of embeddings by spectrum slicing of their covariance.

Vectors become whole numbers, and each distinct one counts once. Sums are exact; the
covariance is summed from centred vectors in tasks and reduced in
Spark, so that only the matrix (its side is the length of a vector) reaches the
driver. There a symmetric factorisation L D L' of the matrix less a shift tells
by the signs of D how many eigenvalues lie above the shift. Bisection with
these counts isolates each leading eigenvalue, Rayleigh quotient iteration
converges on it, and two more counts certify its number.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.lineage import stash

SCALE, COMPONENTS = 256, 4
#: Larger entries have no place in sums that are to be exact.
MOST = float(1 << 40)
_EPS = np.finfo(float).eps


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are at or above the shift.

    Complete pivoting with pivots of one or two rows; one of two rows has one
    eigenvalue of each sign. What is left of a singular matrix counts as above.
    """
    a = matrix - shift * np.eye(len(matrix))
    negative = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        beside = np.abs(a - np.diag(np.diag(a)))
        r, s = np.unravel_index(beside.argmax(), a.shape)
        p = int(diagonal.argmax())
        if diagonal[p] == 0 and beside[r, s] == 0:
            break
        if diagonal[p] >= 0.64 * beside[r, s]:
            rest = np.delete(np.arange(len(a)), p)
            negative += a[p, p] < 0
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, p], a[rest, p]) / a[p, p]
        else:
            rest = np.delete(np.arange(len(a)), [r, s])
            pivot, c = a[np.ix_([r, s], [r, s])], a[np.ix_(rest, [r, s])]
            negative += 1
            a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(pivot, c.T)
    return len(matrix) - int(negative)


def _refined(matrix: np.ndarray, lo: float, hi: float, found: list[np.ndarray], norm: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval; None if it leaves the interval."""
    def solved(shift, v):
        for nudge in (0.0, 4 * _EPS * norm, 64 * _EPS * norm):
            try:
                w = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(w).all():
                break
        return beside(w)

    def beside(w):
        # twice, as the first time cancels most of a vector near those found
        for f in found + found:
            w = w / np.linalg.norm(w)
            w = w - (f @ w) * f
        return w / np.linalg.norm(w)

    v = beside(np.cos((len(found) + 1) * np.arange(1, len(matrix) + 1) ** 2.0))
    for _ in range(3):
        v = solved((lo + hi) / 2, v)
    e, room = v @ matrix @ v, 64 * _EPS * norm
    for _ in range(50):
        if not lo - room <= e <= hi + room:
            return None
        residual = np.linalg.norm(matrix @ v - e * v)
        if residual <= 16 * _EPS * norm:
            break
        w = solved(e, v)
        better = w @ matrix @ w
        if np.linalg.norm(matrix @ w - better * w) >= residual and residual <= 1024 * _EPS * norm:
            break
        v, e = w, better
    return e, v


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `k` largest eigenvalues, falling, with unit eigenvectors as rows; none that is 0 within rounding.

    An eigenvector's largest entry is positive.
    """
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    values, vectors, room = [], [], 1e-12 * norm
    if not norm:
        k = 0
    for i in range(1, min(k, len(matrix)) + 1):
        lo, hi = -norm * (1 + 8 * _EPS), norm * (1 + 8 * _EPS)
        n_lo, n_hi, got = len(matrix), 0, None
        while got is None:
            isolated = n_lo == i and n_hi == i - 1
            tight = hi - lo <= 32 * _EPS * norm
            if isolated or tight:
                got = _refined(matrix, lo, hi, vectors, norm)
                # a neighbour at the interval's edge has another number
                if got is not None and not above(matrix, got[0] - room) >= i > above(matrix, got[0] + room):
                    got = None
                if got is not None or tight:
                    break
            mid = (lo + hi) / 2
            n = above(matrix, mid)
            if n >= i:
                lo, n_lo = mid, n
            else:
                hi, n_hi = mid, n
        if hi <= 64 * len(matrix) * _EPS * norm or (got is not None and got[0] <= 64 * len(matrix) * _EPS * norm):
            break
        if got is None:
            raise ArithmeticError(f"eigenvalue {i} could not be certified")
        e, v = got
        values.append(e)
        vectors.append(v * np.sign(v[np.abs(v).argmax()]))
    return np.array(values), np.array(vectors).reshape(len(values), len(matrix))


@dataclass
class Whitening:
    """A fit: distinct vectors, exact sums, eigenvalues, eigenvectors as rows, and the error measured on the fit list."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision; the whole part is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - whole).astype(float) - part

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row; None where it passes 64 bits."""
        most = 2 * self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        if most * most * max(x.shape[1], 1) < 1 << 63:
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """`vec_id, x` with x = floor(scale * entry), of the sound vectors of the commonest length.

    Left out are vectors that are NULL or empty or hold an entry that is NULL, not finite or of
    2^40 or more in size, and those of another length (of equally common ones the longest stays).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < MOST), F.lit(False)))
    rows = rows.filter(sound)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common.d if common else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def _summed(rows: DataFrame, add, width: int) -> np.ndarray:
    """A matrix of `width` columns summed over all batches: one part a task, then by Spark; `add(x)` gives a batch's part."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = add(_matrix(batch.column(0), batch.num_rows))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    got = rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r.cell] = r.v
    return out.reshape(-1, width)


def fit(whole: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of `whole(x)`, each distinct x once; None without rows."""
    xs = stash(whole.select("x").distinct(), "distinct")

    def sums(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                # entries are below 2^48, so a batch's sum is exact; Python's integers have no bound
                part = _matrix(batch.column(0), batch.num_rows).sum(axis=0).tolist()
                total = part if total is None else [a + b for a, b in zip(total, part)]
        for at, s in enumerate(total or ()):
            yield pa.RecordBatch.from_pydict({"at": [at], "n": [n], "s": pa.array([s], pa.decimal128(38, 0))})

    got = xs.mapInArrow(sums, "at long, n long, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("at").collect()
    if not got:
        return None
    n, d = got[0].n, len(got)
    w = Whitening(n, [int(r.s) for r in got], np.zeros(0), np.zeros((0, d)), 0.0)

    def products(x):
        c = w.centred(x)
        return c.T @ c

    v = _summed(xs, products, d) / n
    v = (v + v.T) / 2
    values, vectors = leading(v, k)
    w = Whitening(n, w.sums, values, vectors, float(np.trace(v)))
    if len(values):
        def white(x):
            y = w.apply(x)
            return np.vstack([y.sum(axis=0), y.T @ y])

        m = _summed(xs, white, len(values)) / n
        w.error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(len(values))).max())
    return w


def whitened(whole: DataFrame, w: Whitening) -> DataFrame:
    """`vec_id, deviation, whitened` (an array of the components) for each row of `whole(vec_id, x)`."""
    shared = whole.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch.column(1), batch.num_rows), shared.value
                y = w.apply(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, max(y.shape[1], 1))[:len(y) + 1] if y.size else np.zeros(len(y) + 1), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return whole.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def components(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error` of each row of `vectors(vec_id, embedding, ...)` and component.

    Components whose eigenvalue is 0 within rounding can't be whitened and are
    left out, so fewer than `k` come from few or equal vectors. Repeated rows
    and NULL ids are kept; repeated vectors are fitted once. `deviation` is NULL
    beyond 64 bits. Other columns are not read; an empty table gives no rows.
    """
    whole = stash(whole_vectors(vectors), "whole")
    w = fit(whole, k)
    if w is None:
        w = Whitening(1, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    share = F.array(*[F.lit(float(e / w.trace)) for e in w.values]) if len(w.values) else F.array().cast("array<double>")
    rows = whitened(whole, w).select("vec_id", "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return rows.select("vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(share, F.col("c") + 1).alias("explained"), F.lit(w.error).alias("identity_error"))
