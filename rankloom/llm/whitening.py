"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration over distributed passes.

Entries become integers x = floor(256 * c). The covariance V of the distinct x-vectors is never formed: a pass over them
returns V Q for a block of columns Q, each row centred by the exact mean before anything is multiplied. A Chebyshev
polynomial of V, by its three-term recurrence (one pass a degree), damps the spectrum below the block's smallest Ritz value;
QR and Rayleigh-Ritz (one more pass) then give values, vectors and residuals. The leading components are certified when
every residual |V q - e q| is within `tolerance` of the largest eigenvalue, and another filtered round, which starts from
them and fresh random columns, finds the same values: a direction that the first columns missed would surface there.

Scale: copies of a vector are one row before the first pass (a hot vector is folded by the partial aggregate). A pass reads
the table once and sends one d x block sum a task, added up by entry in a shuffle; only d x block sums reach the driver,
whatever the number of rows. Sums are exact (decimals); n * x - S is exact in longs, or in big integers beyond them.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; vectors shorter than the longest
count as ending in zeros; entries beyond a long saturate; repeated rows and null ids are kept, each row with its own result;
components of eigenvalue zero can't be scaled to one and aren't returned, so fewer distinct vectors than components give
fewer of them, and one distinct vector or an empty table an empty result; a deviation beyond a long is null; components that
share an eigenvalue may be any orthonormal basis of their space; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

COMPONENTS, BLOCK, DEGREE, TOLERANCE, ROUNDS = 4, 32, 12, 1e-13, 100
_GAIN = 1e8  # of the filter between the ends of a block, so that no column drowns in another
_ROWS = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def entries(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) for each row whose vector is sound."""
    sound = F.expr("forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    rows = vectors.select(F.col(id_).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & sound)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * 256)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d) < np.asarray(column.value_lengths())[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Centre:
    """The mean S / n, taken off exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.most = n, sums, max(map(abs, sums), default=0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in longs where they hold it and in Python's integers else."""
        safe = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + self.most < 2**62
        return x * self.n - np.array(self.sums, np.int64) if safe else x.astype(object) * self.n - np.array(self.sums, object)

    def off(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = self.scaled(x)
        if y.dtype != object and (not y.size or y.shape[1] * int(np.abs(y).max()) ** 2 < 2**63):
            return (y * y).sum(axis=1).tolist()
        y = y.astype(object)
        return [int(s) if s < 2**63 else None for s in (y * y).sum(axis=1)]


def _centre(vectors: DataFrame, d: int) -> Centre:
    def each(batches):
        total, n = [0] * d, 0
        for b in batches:
            x = _matrix(b.column(0), d)
            if len(x):
                wide = int(max(x.max(), -x.min())) * len(x) >= 2**62
                total = [t + int(s) for t, s in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *total]], pa.list_(pa.decimal128(38, 0)))], names=["s"])

    found = vectors.mapInArrow(each, "s array<decimal(38,0)>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    n, *sums = (int(r.v) for r in found.orderBy("i").collect())  # d + 1 sums
    return Centre(n, sums)


def _mean(vectors: DataFrame, d: int, centre: Centre, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One pass: `of` centred rows, a sum over them, divided by n."""

    def each(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = of(centre.off(_matrix(b.column(0), d))).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    found = vectors.mapInArrow(each, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return found.orderBy("i").toArrow().column("v").to_numpy() / centre.n


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial that is at most 1 on [0, cut], scaled to about 1 at top, of V times q."""
    c = e = cut / 2
    first = sigma = e / (top - c)
    before, y = q, (product(q) - c * q) * (sigma / e)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        before, y = y, (product(y) - c * y) * (2 * new / e) - before * (sigma * new)
        sigma = new
    return y


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, count: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the `count` largest eigenvalues; `product` multiplies by V."""
    k, count, random = min(max(block, count), d), min(count, d), np.random.default_rng(seed)
    q, held = np.linalg.qr(random.normal(size=(d, k)))[0], None
    for _ in range(rounds):
        w = product(q)
        t = q.T @ w
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w, top = q @ turn, w @ turn, values[0]
        if top <= 0:
            return np.zeros(0), np.zeros((d, 0))
        small = np.linalg.norm(w[:, :count] - q[:, :count] * values[:count], axis=0).max() <= tolerance * top
        if small and (k == d or (held is not None and np.abs(values[:count] - held).max() <= 100 * tolerance * top)):
            return values[:count], q[:, :count] / np.linalg.norm(q[:, :count], axis=0)
        held = values[:count] if small else None
        if k == d:  # the block is the whole space: nothing to damp, only to repeat
            q = np.linalg.qr(w)[0] if values[-1] > 1e-6 * top else np.linalg.qr(q)[0]
            continue
        cut = max(values[-1], 1e-6 * top)
        if small:
            q = np.concatenate([q[:, :count], random.normal(size=(d, k - count))], axis=1)
        gain = np.arccosh(max(2 * top / cut - 1, 1 + 1e-9))
        q = np.linalg.qr(filtered(product, q, cut, top, int(np.clip(np.log(2 * _GAIN) / gain, 2, degree))))[0]
    raise ArithmeticError(f"the leading {count} components aren't certified after {rounds} rounds")


class Whitening:
    """What a fit keeps: the exact mean, eigenvalues, unit axes scaled to unit variance, each one's share of the trace, and
    how far the covariance of the whitened fit list is from the identity."""

    def __init__(self, d: int, centre: Centre, values: np.ndarray, axes: np.ndarray, trace: float, error: float):
        self.d, self.centre, self.values, self.axes, self.explained, self.error = d, centre, values, axes, values / trace, error


def fit(rows: DataFrame, count: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, tolerance: float = TOLERANCE) -> Whitening | None:
    """The leading components of distinct vectors, from entries(); None where nothing varies."""
    distinct = materialise(rows.select("x").distinct(), "fit")
    d = distinct.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return None
    centre = _centre(distinct, d)
    trace = float(_mean(distinct, d, centre, lambda y: np.array([(y * y).sum()]))[0])
    values, axes = leading(lambda q: _mean(distinct, d, centre, lambda y: y.T @ (y @ q)).reshape(q.shape), d, count, block, degree, tolerance)
    some = values > 1e-12 * max(trace, 1e-300)
    values, axes, k = values[some], axes[:, some] / np.sqrt(values[some]), int(some.sum())
    if not k:
        return None
    square = _mean(distinct, d, centre, lambda y: np.concatenate([(y @ axes).sum(axis=0), ((y @ axes).T @ (y @ axes)).ravel()]))
    error = float(np.abs(square[k:].reshape(k, k) - np.outer(square[:k], square[:k]) - np.eye(k)).max())
    discard(distinct)
    return Whitening(d, centre, values, axes, trace, error)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, whitened array<double>, deviation) of entries()."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def each(batches):
        for b in batches:
            x = _matrix(b.column(1), model.d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(model.centre.off(x) @ model.axes), pa.list_(pa.float64())), pa.array(model.centre.deviations(x), pa.int64())], names=["vec_id", "whitened", "deviation"])

    return rows.mapInArrow(each, f"vec_id {kind}, whitened array<double>, deviation long")


def whiten(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS, **options) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each sound row and leading component."""
    rows = entries(vectors, id_, vector)
    model = fit(rows, count, **options)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _ROWS.format(id=rows.schema["vec_id"].dataType.simpleString()))
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    long = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(model.error).alias("identity_error"))
