"""Embedding whitening: compensated covariance and an eigen-solve by divide and conquer.

Entries become whole numbers, ``x = floor(64 * c) + 1000000``.  The fit is over distinct vectors:
their number ``n`` and sums ``S`` are exact.  Each task centres its vectors (``x - S / n``, held as
a high and a low part), cuts them into slices so short that the matrix products of slices are exact in
double precision, and adds the products up in double-double by error-free sums.  High and low
parts of the tasks are merged matrix row by matrix row, so the driver gets one matrix whatever the data's size.
The matrix is brought to tridiagonal form and solved by divide and conquer.

Rows whose vector is null, or holds a null or an entry that isn't finite, are dropped, and so are those
shorter than the longest (an empty vector has no component to speak of).  Repeated vectors count once in the
fit and are each returned; identifiers may be null or repeat.  Where a component has no variance (one vector, equal
vectors) its ``whitened`` is null.  An empty table gives no rows.  Only the two named columns are read.
``deviation`` is a decimal of 38 digits: from some millions of distinct vectors on it may not fit a long.
The driver holds a few square matrices of a vector's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlog.llm.common import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Vectors of a block; products of slices of SLICE bits stay exact over so many.
BLOCK, SLICE = 1024, 21
EPS = np.finfo(float).eps


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as the rounded sum and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class DoubleDouble:
    """A sum of matrices as a high and a low part."""

    def __init__(self, shape: tuple[int, ...]):
        self.high, self.low = np.zeros(shape), np.zeros(shape)

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, e = two_sum(self.high, high)
        self.high, self.low = two_sum(s, e + (self.low + low))


@dataclass(frozen=True)
class Centre:
    """S / n as a whole number and a remainder of two parts."""

    n: int
    sums: tuple[int, ...]

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = [round_half(s, self.n) for s in self.sums]
        rest = [s - self.n * w for s, w in zip(self.sums, whole)]
        high = [r / self.n for r in rest]  # whole numbers divide with one rounding
        low = []
        for r, h in zip(rest, high):
            p, q = h.as_integer_ratio()
            low.append((r * q - p * self.n) / (self.n * q))
        return np.array(whole, np.int64), np.array(high), np.array(low)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S / n, high and low."""
        whole, high, low = self.parts()
        h, e = two_sum((x - whole).astype(float), -high)
        return two_sum(h, e - low)


def round_half(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """A block as a sum of three matrices; the first two have at most SLICE bits, of one exponent for each column."""
    out, rest = [], high
    for _ in range(2):
        top = np.abs(rest).max(axis=0, initial=0.0)
        step = np.ldexp(0.75, np.frexp(np.where(top > 0, top, 1.0))[1] + 53 - SLICE)
        part = (rest + step) - step
        out.append(part)
        rest = rest - part
    return [*out, rest + low]


def add_products(total: DoubleDouble, high: np.ndarray, low: np.ndarray) -> None:
    """Add the outer products of centred vectors."""
    for at in range(0, len(high), BLOCK):
        a, b, c = slices(high[at : at + BLOCK], low[at : at + BLOCK])
        cross, far = a.T @ b, a.T @ c + b.T @ c
        for exact in (a.T @ a, cross, cross.T, b.T @ b):
            total.add(exact)
        total.add(far + far.T + c.T @ c)


def tridiagonal(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and basis of a symmetric matrix, by Householder's reflections."""
    a, d = m.copy(), len(m)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z**2 / (poles - t)), rho > 0, poles rising; as values, nearest pole and distance from it."""
    n, z2 = len(poles), z * z
    ends = np.append(poles[1:], poles[-1] + rho * z2.sum())
    gap = ends - poles
    middle = 1 + rho * (z2 / (poles - (poles + gap / 2)[:, None])).sum(axis=1)
    right = (middle < 0) & (np.arange(n) < n - 1)  # the root is nearer to the next pole
    origin = np.arange(n) + right
    shifted = poles[None, :] - poles[origin][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / np.where(np.arange(n) < n - 1, 2, 1))
    # Distances are bisected as floats of one sign: over exponents first, so that tiny ones are found to full precision.
    sign = np.where(right, -1.0, 1.0)
    near, far = np.full(n, 1e-300), np.maximum(np.abs(low), np.abs(high))
    far = np.maximum(far, near)
    for _ in range(140):
        t = np.where(far > 4 * near, np.sqrt(near) * np.sqrt(far), (near + far) / 2)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            f = 1 + rho * (z2 / (shifted - (sign * t)[:, None])).sum(axis=1)
        rises = f > 0  # the function rises between poles: positive right of the root
        inward = np.where(right, ~rises, rises)  # the root is nearer to the origin than t
        far, near = np.where(inward, t, far), np.where(inward, near, t)
    distance = sign * (near + far) / 2
    return poles[origin] + distance, origin, distance


def merged(values: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(values) + rho * z z'."""
    if rho < 0:
        e, v = merged(-values, z, -rho)
        return -e, v
    n = len(values)
    order = np.argsort(values, kind="stable")
    d, w, basis = values[order], z[order].copy(), np.eye(n)[:, order]
    rho, w = rho * (w @ w), w / (np.linalg.norm(w) or 1.0)
    least = 8 * EPS * max(np.abs(d).max(initial=0.0), rho, 1e-300)
    last = -1
    for i in range(n):  # deflation: parts without weight, and values that can't be told apart
        if rho * abs(w[i]) <= least:
            w[i] = 0.0
        elif last >= 0 and d[i] - d[last] <= least:
            r = np.hypot(w[i], w[last])
            c, s = w[i] / r, w[last] / r
            w[i], w[last] = r, 0.0
            one, two = basis[:, last].copy(), basis[:, i].copy()
            basis[:, last], basis[:, i] = c * one - s * two, s * one + c * two
            last = i
        else:
            last = i
    live = np.flatnonzero(w)
    out, vectors = d.copy(), basis.copy()
    if len(live):
        p = d[live]
        e, origin, distance = secular(p, w[live], rho)
        gaps = (p[None, :] - p[origin][:, None]) - distance[:, None]  # poles minus roots, exact near the pole
        # Weights for which the roots are exact, so that the vectors are orthogonal.
        k = len(live)
        ratio = np.ones(k)
        for j in range(k):
            over = p[j] - p
            over[j] = 1.0
            near = -gaps[:, j]  # roots minus the pole
            ratio[j] = np.abs(near[j] * np.prod(np.delete(near, j) / np.delete(-over, j))) / rho
        weight = np.sign(w[live]) * np.sqrt(ratio)
        u = weight[None, :] / gaps
        u /= np.linalg.norm(u, axis=1)[:, None]
        out[live], vectors[:, live] = e, basis[:, live] @ u.T
    return out, vectors


def conquered(diagonal: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric tridiagonal matrix: halves are solved and merged by a change of rank one."""
    n = len(diagonal)
    if n == 1:
        return diagonal.copy(), np.eye(1)
    m = n // 2
    b = beside[m - 1]
    first, second = diagonal[:m].copy(), diagonal[m:].copy()
    first[-1] -= abs(b)
    second[0] -= abs(b)
    (e1, v1), (e2, v2) = conquered(first, beside[: m - 1]), conquered(second, beside[m:])
    values = np.concatenate([e1, e2])
    basis = np.zeros((n, n))
    basis[:m, :m], basis[m:, m:] = v1, v2
    if b == 0:
        return values, basis
    e, v = merged(values, np.concatenate([v1[-1], np.sign(b) * v2[0]]), abs(b))
    return e, basis @ v


def eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    size = np.abs(m).max(initial=0.0) or 1.0
    d, e, q = tridiagonal(m / size)
    values, v = conquered(d, e)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, (q @ v)[:, order]


def whole(embedding: Column) -> Column:
    """An embedding's entries as whole numbers."""
    return F.transform(embedding, lambda c: F.floor(SCALE * c.cast("double")) + F.lit(SHIFT).cast("long"))


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of rows with a vector of finite entries."""
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(v.isNotNull() & (F.size(v) > 0)).where(~odd).select(F.col(f"`{id_col}`").alias("id"), whole(v).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A batch's vectors as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def parts_of(fit: DataFrame, centre: Centre, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the summed outer products of centred vectors, or of their projections on weights."""
    k = len(centre.sums) if weights is None else weights.shape[1]
    kind = "i int, high array<double>, low array<double>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = DoubleDouble((k, k)), False
        for batch in batches:
            if batch.num_rows:
                high, low = centre.apply(matrix_of(batch.column(0)))
                if weights is not None:
                    high, low = (high + low) @ weights, np.zeros((len(high), k))
                add_products(total, high, low)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total.high)), pa.array(list(total.low))], ["i", "high", "low"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, DoubleDouble] = {}  # k rows of a matrix at most
        for batch in batches:
            for i, high, low in zip(batch.column(0).to_pylist(), matrix_of(batch.column(1)), matrix_of(batch.column(2))):
                sums.setdefault(i, DoubleDouble((k,))).add(high, low)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.high for s in sums.values()]), pa.array([s.low for s in sums.values()])], ["i", "high", "low"])

    rows = fit.select("x").mapInArrow(add, kind).repartition("i").mapInArrow(merge, kind).collect()  # k rows
    rows.sort()
    return np.array([r["high"] for r in rows]), np.array([r["low"] for r in rows])


@dataclass(frozen=True)
class Whitening:
    """What a fit found."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    def weights(self) -> np.ndarray:
        """Components over the roots of their eigenvalues, as columns; NaN without variance."""
        flat = self.values <= len(self.centre.sums) * EPS * max(self.trace, 1e-300)
        return self.vectors / np.sqrt(np.where(flat, np.nan, self.values))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of (id, x); None where there are none."""
    wide = vectors.agg(F.max(F.size("x"))).first()[0]
    if wide is None:
        return None
    distinct = written(vectors.where(F.size("x") == wide).groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit-list")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * wide
        for batch in batches:
            x = matrix_of(batch.column(0)) if batch.num_rows else np.zeros((0, wide), np.int64)
            n, sums = n + len(x), [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(wide), pa.int32()), pa.array([n] * wide, pa.int64()), pa.array(sums, pa.int64())], ["i", "n", "s"])

    sums = distinct.mapInArrow(add, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # as many as a vector's entries
    centre = Centre(sums[0]["n"], tuple(int(r["s"]) for r in sums))
    high, low = parts_of(distinct, centre)
    v = (high + low) / centre.n
    values, basis = eigen((v + v.T) / 2)
    k = min(components, wide)
    found = Whitening(centre, values[:k], basis[:, :k], float(np.trace(v)), None)
    w = found.weights()
    live = np.isfinite(w).all(axis=0)
    if not live.any():
        return found
    high, low = parts_of(distinct, centre, w[:, live])
    error = float(np.abs((high + low) / centre.n - np.eye(int(live.sum()))).max())
    return Whitening(centre, found.values, found.vectors, found.trace, error)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = usable(table, id_col, vector_col).withColumn("id", F.col("id").cast("long"))
    found = fit(vectors, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], kind)
    centre, weights, k, wide = found.centre, found.weights(), len(found.values), len(found.centre.sums)
    explained = found.values / found.trace if found.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = centre.parts()[0]
        rest = [s - centre.n * int(w) for s, w in zip(centre.sums, middle)]
        nulls = lambda a: pa.array(a, pa.float64(), mask=~np.isfinite(a))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix_of(part.column(1))
                m = len(x)
                high, low = centre.apply(x)
                y = high @ weights + low @ weights
                away = x - middle
                fits = wide * (centre.n * (int(np.abs(away).max()) + 1)) ** 2 < 1 << 62
                kind_of = np.int64 if fits else object
                deviation = ((centre.n * away.astype(kind_of) - np.array(rest, kind_of)) ** 2).sum(axis=1).tolist()
                each = pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k)))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n, np.int64)), each,
                        nulls(y.ravel()), nulls(np.tile(explained, m)), pa.array([found.identity_error] * (m * k), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.where(F.size("x") == wide).select("id", "x").mapInArrow(run, kind)
