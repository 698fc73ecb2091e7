"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become integers x, so that every centred entry x - S/n is (n x - S)/n with an exact numerator. A pass over the
table multiplies a block Q of vectors by the covariance: every task adds up X'(XQ) of its centred rows, Spark adds the
tasks' sums by row of the result, and the driver gets one matrix of dimensions by block. The Chebyshev polynomial of
the interval from 0 to the block's least Ritz value, built by its three-term recurrence from such passes, damps that
part of the spectrum and lets the rest grow; QR and Rayleigh-Ritz follow. The covariance has no negative eigenvalue, so
the interval needs no other bound. When the wanted residuals are at rounding level, the block's other vectors are
replaced by random ones and a further cycle must find the same eigenvalues; then the components are certified.

Vectors that are null, or hold null or non-finite entries, are dropped. So are vectors of another length than most (of
equally frequent ones the longest stays), the empty one included. Repeated rows count as often as they are there, and
keys may be of any type, null or repeated. Directions of no variance can't be whitened and are left out, so one row,
equal rows and an empty table have no components. Entries so large that n x leaves 62 bits fail with a message.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.session import written

#: Fixed values of the quantisation: x = floor(GRID * c) + SHIFT.
GRID, SHIFT = 1024, 100_000
#: Block of vectors for k components; most steps of one polynomial; logarithm of the growth it may cause.
BLOCK_PER_COMPONENT, MOST_DEGREE, MOST_GROWTH = 6, 16, 23.0
#: Residual, relative to the largest eigenvalue, at which components are right to double precision; cycles until then.
TOLERANCE, MOST_CYCLES = 1e-13, 200
#: Eigenvalues below this share of the largest one are rounding of zero.
RANK = 1e-12


@dataclass(frozen=True)
class Whitening:
    """components: one column for each; values: eigenvalues, falling; trace: of the covariance; passes over the table."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the vectors that can be used."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).alias("key"), entries.alias("c")).where(F.col("c").isNotNull() & ~bad)
    x = F.transform("c", lambda c: F.floor(c * GRID) + F.lit(SHIFT).cast("long"))
    rows = written(rows.select("key", x.alias("x")), "quantised")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).select("d").first()
    return rows.where(F.size("x") == (usual[0] if usual else 0)).where(F.size("x") > 0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return x.reshape(batch.num_rows, -1)


def _sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(number of vectors, sum of each entry); refuses entries that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                columns = [np.arange(x.shape[1]), np.full(x.shape[1], len(x)), x.sum(0), np.abs(x.astype(np.float64)).max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "n", "s", "most"])

    found = rows.mapInArrow(run, "i long, n long, s long, most double").groupBy("i")
    found = found.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")).orderBy("i").collect()
    if not found:
        return 0, np.zeros(0, np.int64)
    n = found[0].n
    if n * max(r.most for r in found) >= 2.0**62:
        raise ValueError("entries are too large for exact sums")
    return n, np.array([r.s for r in found], np.int64)


class _Passes:
    """Products with the covariance; ``done`` counts passes over the table."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray):
        self.rows, self.n, self.sums, self.done = rows, n, sums, 0

    def _sum(self, partial, size: int, width: int) -> np.ndarray:
        """Sum over all tasks of the (size, width) matrices that ``partial`` makes of centred rows."""
        n, sums = self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, width))
            for batch in batches:
                total += partial((n * _matrix(batch) - sums) / n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * width)), pa.array(total.ravel())], ["place", "value"])

        found = self.rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        self.done += 1
        return np.array([r.value for r in sorted(found)]).reshape(size, width) / n

    def variances(self) -> np.ndarray:
        return self._sum(lambda x: (x * x).sum(0)[:, None], len(self.sums), 1)[:, 0]

    def times(self, q: np.ndarray) -> np.ndarray:
        return self._sum(lambda x: x.T @ (x @ q), *q.shape)

    def covariance(self, to: np.ndarray) -> np.ndarray:
        """Covariance of the centred rows times ``to``; their means are zero."""
        k = to.shape[1]

        def products(x: np.ndarray) -> np.ndarray:
            y = x @ to
            return y.T @ y

        return self._sum(products, k, k)


def _rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(falling Ritz values, Ritz vectors, the covariance times them)."""
    h = q.T @ vq
    values, u = np.linalg.eigh((h + h.T) / 2)
    u = u[:, ::-1]
    return values[::-1], q @ u, vq @ u


def _filtered(passes: _Passes, q: np.ndarray, vq: np.ndarray, bound: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of [0, bound] of the covariance, times q, scaled to 1 at ``top``."""
    half = bound / 2
    steepness = np.arccosh(max(top / half - 1, 1 + 1e-9))
    degree = int(np.clip(MOST_GROWTH / steepness, 1, MOST_DEGREE))
    sigma = first = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (passes.times(now) - half * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 8, seed: int = 20240611) -> Whitening:
    """The first ``k`` components of all usable vectors."""
    return fit_quantised(quantised(vectors, vector, vector), k, seed)


def fit_quantised(rows: DataFrame, k: int = 8, seed: int = 20240611) -> Whitening:
    n, sums = _sums(rows)
    d = len(sums)
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0.0, 1)
    if n == 0:
        return none
    passes = _Passes(rows, n, sums)
    trace = float(passes.variances().sum())
    if trace == 0:
        return none
    k, block = min(k, d), min(d, BLOCK_PER_COMPONENT * k)
    random = np.random.Generator(np.random.PCG64(seed))
    q = np.linalg.qr(random.standard_normal((d, block)))[0]
    values, q, vq = _rayleigh_ritz(q, passes.times(q))
    probed = None
    for _ in range(MOST_CYCLES):
        residual = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max() / values[0]
        if residual <= TOLERANCE:
            if block == d or (probed is not None and np.abs(values[:k] - probed).max() <= 1e-10 * values[0]):
                break
            probed = values[:k].copy()  # a vector that was missed would now come in through the fresh ones
            q = np.linalg.qr(np.hstack([q[:, :k], random.standard_normal((d, block - k))]))[0]
            bound = values[-1]
            values, q, vq = _rayleigh_ritz(q, passes.times(q))
            values[-1] = bound
        bound = max(values[-1], RANK * values[0])
        q = np.linalg.qr(_filtered(passes, q, vq, bound, values[0]))[0]
        values, q, vq = _rayleigh_ritz(q, passes.times(q))
    else:
        raise RuntimeError(f"no convergence: residual {residual:.1e} after {passes.done} passes")
    real = values[:k] > RANK * values[0]
    values, q = values[:k][real], q[:, :k][:, real]
    error = np.abs(passes.covariance(q / np.sqrt(values)) - np.eye(len(values))).max()
    return Whitening(n, sums, q, values, trace, float(residual), float(error), passes.done)


def _deviations(centred: np.ndarray) -> pa.Array:
    """Exact sums of squares of integers, as decimals."""
    if centred.size and centred.shape[1] * float(np.abs(centred).max()) ** 2 < 2.0**62:
        return pa.array((centred * centred).sum(1)).cast(pa.decimal128(38, 0))
    wide = centred.astype(object)
    return pa.array([int(x) for x in (wide * wide).sum(1)], pa.decimal128(38, 0))


def whiten(rows: DataFrame, model: Whitening, key: str) -> DataFrame:
    """(key, component, deviation, whitened, explained) of quantised rows; deviation is the sum of (n x - S)**2."""
    k = len(model.values)
    to = model.components / np.sqrt(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            centred = model.n * _matrix(batch) - model.sums
            row = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(row),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    _deviations(centred).take(row),
                    pa.array(((centred / model.n) @ to).ravel()),
                    pa.array(np.tile(explained, batch.num_rows)),
                ],
                ["key", "component", "deviation", "whitened", "explained"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, component int, deviation decimal(38,0), whitened double, explained double")
    return found.withColumnRenamed("key", key)
