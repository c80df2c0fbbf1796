"""Embedding whitening by spectrum slicing.

1. Entries are put on a grid (x = floor(256 c), an integer), so that equal
   vectors are equal byte strings and sums are exact. The fit list is each
   distinct vector once.
2. Two passes over the fit list: exact sums per dimension, then the covariance
   of the centred vectors. Each task adds up its own part of the matrix, and the
   parts are added row by row of the matrix in two rounds, so that no task and
   never the driver holds more than a few matrices.
3. The driver works on the covariance alone, a matrix whose size does not grow
   with the table. It is brought to tridiagonal form T by reflections. The LDL'
   factors of T - s have as many positive pivots as there are eigenvalues above s
   (and no pivoting is needed for that on a tridiagonal matrix): slicing the
   spectrum by such counts isolates the k-th eigenvalue in an interval that holds
   no other one. From a vector of the interval, Rayleigh quotient iteration on
   the covariance itself converges cubically to the eigenvector. A quotient that
   leaves the interval is thrown back to its middle. At last the counts just above and just below
   the value found certify that it is number k.
   Eigenvalues too near each other to be told apart at double precision stay in one interval; their vectors are kept
   apart by projecting out those found before.
4. One pass over all rows projects them; one over the fit list measures the
   covariance of what came out against the identity.

Defined results: rows whose vector is null or holds null, NaN or infinite
entries are dropped; vectors of each length are a table of their own, with their
own fit; a row with an empty vector has no component and gives no row; a vector of fewer dimensions than
``components`` has as many components as dimensions; a component without variance
(all vectors equal, or fewer distinct vectors than components) has null
``whitened``, explained 0 and no part in identity_error, which is 0 if no
component has variance; entries beyond 2**63 / 256 are held at the ends of the long range; ``deviation`` is null where the exact value
is no long; rows without vec_id and repeated rows are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, tidy

#: Components that are returned, and points of the grid per unit.
COMPONENTS, GRID = 4, 256
#: Rows of an intermediate sum that meet in one task.
FAN_IN = 64
#: Vectors that are multiplied at once.
STEP = 1024
SEED = 12
LONG = np.iinfo(np.int64)
#: Integers are kept in the narrowest of these types that holds a vector.
WIDTHS = (("<i1", 1), ("<i2", 2), ("<i4", 4), ("<i8", 8))


# --- vectors on the grid


def _gridded(batches):
    """(vec_id, embedding) -> vec_id, dim, x (integers as bytes, the width first); rows that are not whole numbers are dropped."""
    for batch in batches:
        ids, dims, xs = [], [], []
        for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not v or any(c is None for c in v):
                continue
            c = np.array(v, dtype=np.float64)
            if not np.isfinite(c).all():
                continue
            with np.errstate(over="ignore"):
                scaled = np.floor(c * GRID)
            inside = np.abs(scaled) < 2.0**63
            x = np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled > 0, LONG.max, LONG.min))
            ids.append(vec_id)
            dims.append(len(x))
            xs.append(pack(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())], names=["vec_id", "dim", "x"])


def pack(x: np.ndarray) -> bytes:
    """Integers as bytes; equal vectors have equal bytes."""
    low, high = int(x.min()), int(x.max())
    kind, width = next(w for w in WIDTHS if np.iinfo(w[0]).min <= low and high <= np.iinfo(w[0]).max)
    return bytes([width]) + x.astype(kind).tobytes()


def unpack(xs: list[bytes]) -> np.ndarray:
    """Vectors of one length -> int64 matrix."""
    kinds = {width: kind for kind, width in WIDTHS}
    return np.stack([np.frombuffer(b, dtype=kinds[b[0]], offset=1) for b in xs]).astype(np.int64)


def grid_vectors(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(tidy(_gridded), "vec_id long, dim int, x binary")


def _by_dim(batch, step: int = STEP):
    """Blocks of rows of one length: (dim, rows, int64 matrix)."""
    for k in range(0, batch.num_rows, step):
        some = batch.slice(k, step)
        dims = some.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            rows = some.take(pa.array(np.flatnonzero(dims == dim)))
            yield int(dim), rows, unpack(rows.column("x").to_pylist())


# --- sums over the fit list


def _part_sums(batches):
    """(dim, x) -> dim, i, n, total (decimal string of the exact sum of entry i): one set of rows per task."""
    sums: dict[int, list] = {}
    for batch in batches:
        for dim, _, x in _by_dim(batch):
            n, total = sums.get(dim, (0, np.zeros(dim, dtype=object)))
            # halves keep the sum of a block within a long
            high, low = x >> 32, x & 0xFFFFFFFF
            sums[dim] = (n + len(x), total + high.sum(axis=0).astype(object) * 2**32 + low.sum(axis=0).astype(object))
    for dim, (n, total) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])],
            names=["dim", "i", "n", "total"],
        )


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Fit list -> per length (n, exact integer sums); as many numbers as a vector has come to the driver."""
    parts = fit.select("dim", "x").mapInArrow(_part_sums, "dim int, i int, n long, total string")
    rows = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim", "i").collect()
    out: dict[int, tuple[int, list]] = {}
    for r in rows:
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["total"]))
    return {dim: (n, np.array(total, dtype=object)) for dim, (n, total) in out.items()}


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exact: int64 where it fits, else Python integers."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(t)) for t in total)
    return n * x - total.astype(np.int64) if most < 2**62 else n * x.astype(object) - total


def _part_gram(sums: dict):
    """(dim, x) -> dim, i, part, row (entries of row i of the task's sum of products of centred vectors)."""

    def work(batches):
        from pyspark import TaskContext

        grams: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                n, total = sums[dim]
                y = centred(x, n, total).astype(np.float64) / n
                grams[dim] = grams.get(dim, 0) + y.T @ y
        part = TaskContext.get().partitionId()
        for dim, g in grams.items():
            same = lambda value: pa.array([value] * dim, pa.int32())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(dim), pa.array(range(dim), pa.int32()), same(part), pa.array([r.tobytes() for r in g], pa.binary())], names=["dim", "i", "part", "row"])

    return work


def _added(table: pa.Table) -> pa.Table:
    """Rows of one place of the matrix -> their sum."""
    rows = [np.frombuffer(b, dtype=np.float64) for b in table.column("row").to_pylist()]
    first = table.slice(0, 1).select(["dim", "i", "part"])
    return first.append_column("row", pa.array([np.sum(rows, axis=0).tobytes()], pa.binary()))


def covariances(fit: DataFrame, sums: dict) -> dict[int, np.ndarray]:
    """Fit list -> per length the covariance matrix, divisor n."""
    kind = "dim int, i int, part int, row binary"
    parts = fit.select("dim", "x").mapInArrow(_part_gram(sums), kind)
    # parts of many tasks are added in two rounds, a bounded number at a time as long as there are at most FAN_IN ** 2 tasks
    some = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("dim", "i", "part").applyInArrow(_added, kind)
    rows = some.groupBy("dim", "i").applyInArrow(_added, kind).orderBy("dim", "i").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["dim"], []).append(np.frombuffer(r["row"], dtype=np.float64))
    covs = {dim: np.array(g) / sums[dim][0] for dim, g in out.items()}
    return {dim: (g + g.T) / 2 for dim, g in covs.items()}


# --- spectrum slicing


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with the eigenvalues of the symmetric matrix ``v``."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * rest @ x
        w = p - (p @ x) * x
        rest -= np.outer(x, w) + np.outer(w, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
    return a.diagonal().copy(), np.array([a[k + 1, k] for k in range(d - 1)])


def count_above(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: positive pivots of the LDL' factors of T - shift."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    pivot, above = 1.0, 0
    squares = np.concatenate([[0.0], side**2]).tolist()
    for t, square in zip(diagonal.tolist(), squares, strict=True):
        pivot = t - shift - square / pivot
        if abs(pivot) < least:
            pivot = -least
        above += pivot > 0
    return above


class Component(NamedTuple):
    value: float
    vector: np.ndarray


def leading(v: np.ndarray, k: int = COMPONENTS) -> list[Component]:
    """The ``k`` largest eigenvalues of a symmetric matrix that has none below 0, falling, with unit vectors; those
    without variance (no more than rounding) have value 0.

    Each one is certified: fewer than its number of eigenvalues lie above it, and as many as its number above what lies
    just below it.
    """
    d = len(v)
    scale = float(np.abs(v).sum(axis=1).max())
    if scale == 0 or not np.isfinite(scale):
        return [Component(0.0, e) for e in np.eye(d)[:k]]
    unit = v / scale
    diagonal, side = tridiagonal(unit)
    eps = np.finfo(float).eps
    slack = 8 * d * eps
    found: list[Component] = []
    rng = np.random.default_rng(SEED)
    for number in range(1, min(k, d) + 1):
        # slices: at least `number` eigenvalues above low, fewer above high, until the interval holds one only
        low, high, width = -slack, 1.0 + slack, 1e-2
        while True:
            while high - low > 2 * slack:
                alone = count_above(diagonal, side, low) == number and count_above(diagonal, side, high) == number - 1
                if alone and high - low < width * max(low, slack):
                    break
                mid = (low + high) / 2
                if count_above(diagonal, side, mid) >= number:
                    low = mid
                else:
                    high = mid
            value, vector, residual = _iterated(unit, (low, high), [c.vector for c in found], rng)
            if residual <= slack and count_above(diagonal, side, value + 2 * slack) < number <= count_above(diagonal, side, value - 2 * slack):
                break
            # a neighbour just outside drew the iteration away: slice on
            if high - low <= 2 * slack:
                raise ArithmeticError(f"eigenvalue {number} is not certified by the counts")
            width /= 100
        found.append(Component(value, vector))
    return [Component(c.value * scale if c.value > slack else 0.0, c.vector) for c in sorted(found, key=lambda c: -c.value)]


def _iterated(v: np.ndarray, interval: tuple[float, float], known: list[np.ndarray], rng, most: int = 30) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration for the eigenvalue of the interval, apart from the known vectors: value, vector, residual."""
    d, eps = len(v), np.finfo(float).eps
    low, high = interval
    basis = np.array(known).reshape(-1, d)

    def apart(x):
        for _ in range(2):
            x = x - basis.T @ (basis @ x)
        return x / np.linalg.norm(x)

    x = apart(rng.standard_normal(d))
    shift, best = (low + high) / 2, (np.inf, 0.0, x)
    for _ in range(most):
        try:
            y = np.linalg.solve(v - shift * np.eye(d), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(v - (shift + d * eps) * np.eye(d), x)
        if not np.isfinite(y).all() or not np.linalg.norm(y):
            break
        x = apart(y)
        value = float(x @ (v @ x))
        residual = float(np.linalg.norm(v @ x - value * x))
        inside = low - 8 * d * eps <= value <= high + 8 * d * eps
        if inside and residual < best[0]:
            best = (residual, value, x)
        elif inside and best[0] <= 8 * d * eps:
            break  # no better at the precision of doubles
        shift = value if inside else (low + high) / 2
    return best[1], best[2], best[0]


# --- the operator


class Fit(NamedTuple):
    n: int
    total: np.ndarray
    trace: float
    parts: list[Component]


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Distinct vectors (dim, x) -> per length their number, sums, trace of the covariance and leading components."""
    sums = exact_sums(fit)
    covs = covariances(fit, sums)
    return {dim: Fit(n, total, float(np.trace(covs[dim])), leading(covs[dim], components)) for dim, (n, total) in sums.items()}


def _whitened(x: np.ndarray, of: Fit) -> np.ndarray:
    """(rows, components): projections over the root of the variance, NaN where there is none."""
    y = centred(x, of.n, of.total).astype(np.float64) / of.n
    values = np.array([c.value for c in of.parts])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(values > 0, y @ np.array([c.vector for c in of.parts]).T / np.sqrt(values), np.nan)


def _part_products(fits: dict[int, Fit]):
    """(dim, x) -> dim, n, sums and products of the whitened values: one row per task and length."""

    def work(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                w = np.nan_to_num(_whitened(x, fits[dim]))
                s = held.setdefault(dim, [0.0, 0.0])
                s[0], s[1] = s[0] + w.sum(axis=0), s[1] + w.T @ w
        for dim, (total, products) in held.items():
            flat = [*total.tolist(), *products.reshape(-1).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["dim", "i", "value"])

    return work


def identity_error(fit: DataFrame, fits: dict[int, Fit]) -> float:
    """Largest absolute entry of the whitened fit lists' covariance minus the identity."""
    parts = fit.select("dim", "x").mapInArrow(_part_products(fits), "dim int, i int, value double")
    rows = parts.groupBy("dim", "i").agg(F.sum("value").alias("value")).orderBy("dim", "i").collect()
    worst = 0.0
    for dim, of in fits.items():
        flat, k = np.array([r["value"] for r in rows if r["dim"] == dim]), len(of.parts)
        mean = flat[:k] / of.n
        cov = flat[k:].reshape(k, k) / of.n - np.outer(mean, mean)
        real = [i for i, c in enumerate(of.parts) if c.value > 0]
        if real:
            worst = max(worst, float(np.abs(cov[np.ix_(real, real)] - np.eye(len(real))).max()))
    return worst


def _projected(fits: dict[int, Fit]):
    """(vec_id, dim, x) -> one row per vector and component."""

    def work(batches):
        for batch in batches:
            for dim, rows, x in _by_dim(batch):
                of = fits[dim]
                k = len(of.parts)
                y = centred(x, of.n, of.total)
                if y.dtype != object and dim * int(np.abs(y).max()) ** 2 < 2**63:
                    deviation = (y * y).sum(axis=1).tolist()
                else:
                    whole = (y.astype(object) ** 2).sum(axis=1)
                    deviation = [int(s) if s <= LONG.max else None for s in whole]
                w = _whitened(x, of)
                ids = rows.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
                share = [c.value / of.trace if of.trace > 0 else 0.0 for c in of.parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array([of.n] * (k * len(x)), pa.int64()),
                        pa.array([s for s in deviation for _ in range(k)], pa.int64()),
                        pa.array(w.reshape(-1), pa.float64(), from_pandas=True),
                        pa.array(share * len(x), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return work


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, embedding) rows -> vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = materialize(grid_vectors(vectors), "grid")
    fit = materialize(rows.select("dim", "x").distinct(), "fit-list")
    fits = fitted(fit, components)
    error = identity_error(fit, fits)
    out = rows.mapInArrow(_projected(fits), "vec_id long, component int, n long, deviation long, whitened double, explained double")
    return out.withColumn("identity_error", F.lit(error))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every vector on the four leading components of the fit list."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
