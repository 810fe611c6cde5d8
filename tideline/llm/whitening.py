"""Embedding whitening from exact covariances, which come from variances of sums.

1. Entries become integers x. One pass gives n and the sums S of every dimension.
2. A second pass centres each entry by the whole part of its mean and adds up, exactly, the
   squares of every dimension and of the sum of every two dimensions. With the remainders of
   the means these are variances as exact fractions, and the polarisation identity
   ``2 cov(a, b) = var(a + b) - var(a) - var(b)`` gives every covariance, rounded once.
3. The matrix of dimension x dimension goes to the driver for its eigenvectors; rows are
   projected where they lie, and a last pass measures the covariance of what came out.

A task holds one batch and d (d + 1) / 2 sums, whatever the number of rows; nothing is
shuffled but a row per task and pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024.0
SHIFT = 100_000
COMPONENTS = 8
_SAFE = 1 << 62


@dataclass
class Model:
    """A fitted whitening: ``axes`` are columns, numbered by falling variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def length(self) -> int:
        return len(self.sums)

    def scores(self) -> np.ndarray:
        """Factors of the projections; 0 for a component along which no row varies."""
        least = self.trace * self.length * np.finfo(float).eps
        with np.errstate(divide="ignore"):
            return np.where(self.variances > least, 1 / np.sqrt(np.maximum(self.variances, 0)), 0.0)


def sound(vector: str | Column) -> Column:
    """True where a vector has entries, all of them finite numbers; never null."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the sound vectors (the larger of equally frequent ones), 0 without any."""
    found = rows.filter(sound(vector)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def whole(values: np.ndarray, scale: float = SCALE, shift: int = SHIFT) -> np.ndarray:
    """``floor(scale * c) + shift`` as 64-bit integers, or as Python's where those may be too small."""
    x = np.floor(scale * values)
    if not len(x) or np.abs(x).max() < 2.0**52:
        return x.astype(np.int64) + shift
    return np.array([int(a) for a in x.ravel()], object).reshape(x.shape) + shift


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def exact_squares(y: np.ndarray) -> np.ndarray:
    """Sums over rows of ``(y_i + y_j)^2`` for i < j and of ``y_i^2`` for i = j, as Python integers."""
    rows, d = y.shape
    out = np.zeros((d, d), object)
    top = int(np.abs(y).max()) if y.size else 0
    step = _SAFE // max(1, 4 * top * top)
    if step < 1:
        y, step = y.astype(object), rows
    for at in range(0, rows, step):
        part = y[at : at + step]
        for i in range(d):
            pair = part[:, i:] + part[:, i : i + 1]
            pair[:, 0] = part[:, i]
            out[i, i:] += (pair * pair).sum(axis=0).astype(object)
    return out


def _valid(rows: DataFrame, vector: str, length: int, *keep: Column) -> DataFrame:
    return rows.filter(sound(vector) & (F.size(vector) == length)).select(*keep, F.col(vector).cast("array<double>").alias("v"))


def _added(rows: DataFrame, length: int, cells, of) -> dict[tuple[int, int], int]:
    """Exact totals over all rows of the ``of`` each batch, a matrix whose ``cells`` are asked for; under (-1, -1) the rows.

    Integers of any size travel as digits of 32 bits, whose sums are longs.
    """
    at = list(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = None, 0
        for batch in batches:
            if batch.num_rows:
                new, n = of(matrix(batch.column(0), length)), n + batch.num_rows
                sums = new if sums is None else sums + new
        if n:
            out = []
            for (i, j), value in [((-1, -1), n), *((c, int(sums[c])) for c in at)]:
                digit, sign = 0, 1 if value >= 0 else -1
                value = abs(value)
                while value:
                    out.append((i, j, digit, sign * (value & 0xFFFFFFFF)))
                    value, digit = value >> 32, digit + 1
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["i", "j", "digit", "s"])

    parts = rows.mapInArrow(run, "i int, j int, digit int, s long")
    total = dict.fromkeys([(-1, -1), *at], 0)
    for r in parts.groupBy("i", "j", "digit").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] += r["s"] << (32 * r["digit"])
    return total


def fit(rows: DataFrame, vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> Model | None:
    """Means, variances and axes of all sound vectors of the usual length; None without any."""
    d = usual_length(rows, vector)
    if not d:
        return None
    values = _valid(rows, vector, d)
    # the sums of both passes are exact, so what a retried task adds again is the same
    sums = _added(values, d, [(0, i) for i in range(d)], lambda v: whole(v, scale, shift).astype(object).sum(axis=0)[None, :])
    n = sums[-1, -1]
    total = [sums[0, i] for i in range(d)]
    centre = [s // n for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    middle = np.array(centre, np.int64 if max(map(abs, centre)) < 1 << 52 else object)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    squares = _added(values, d, pairs, lambda v: exact_squares(whole(v, scale, shift) - middle))
    # n^2 times the variance of each dimension, and of each sum of two
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(d)]
    cov = np.zeros((d, d))
    for i, j in pairs:
        both = n * squares[i, j] - (rest[i] + rest[j]) ** 2 if i < j else 4 * own[i]
        cov[i, j] = cov[j, i] = (both - own[i] - own[j]) / (2 * n * n)
    e, u = np.linalg.eigh(cov)
    return Model(n, total, e[::-1], u[:, ::-1], sum(own) / (n * n))


def project(x: np.ndarray, model: Model, components: int) -> np.ndarray:
    """Whitened rows: distance to the mean along each component over its standard deviation."""
    # n x - S is exact before the one division
    centred = _from_mean(x, model).astype(float) / model.n
    return centred @ (model.axes[:, :components] * model.scores()[:components])


def _from_mean(x: np.ndarray, model: Model) -> np.ndarray:
    """``n x - S`` exactly."""
    top = max(max(map(abs, model.sums)), model.n * (int(np.abs(x).max()) if x.size else 0))
    kind = np.int64 if top < _SAFE // 2 else object
    return model.n * x.astype(kind) - np.array(model.sums, kind)


def _deviation(x: np.ndarray, model: Model) -> pa.Array:
    gap = _from_mean(x, model)
    top = int(np.abs(gap).max()) if gap.size else 0
    if model.length * top * top < _SAFE:
        return pa.array((gap * gap).sum(axis=1)).cast(pa.decimal128(38, 0))
    gap = gap.astype(object)
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in (gap * gap).sum(axis=1)], pa.decimal128(38, 0))


def identity_error(rows: DataFrame, model: Model, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> float:
    """Largest entry, signs apart, of the whitened rows' covariance minus the identity.

    Components without variance are left out; 0 if there is no other.
    """
    d, k = model.length, min(components, model.length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = project(whole(matrix(batch.column(0), d), scale, shift), model, k)
            sums += w.sum(axis=0)
            products += w.T @ w
        table = np.concatenate([sums[None, :], products])
        i, j = np.indices(table.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(table.ravel())], names=["i", "j", "s"])

    found = _valid(rows, vector, d).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    table = np.zeros((k + 1, k))
    for r in found:
        table[r["i"], r["j"]] = r["s"]
    mean = table[0] / model.n
    live = model.scores()[:k] > 0
    gap = np.abs(table[1:] / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]
    return float(gap.max()) if gap.size else 0.0


def whiten(rows: DataFrame, model: Model | None, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained): a row per sound row and component.

    Null vectors, empty ones and those with a null, NaN or infinite entry are dropped, as are
    vectors of another length than the model's. Rows with a null id and repeated rows take part
    like any other. ``deviation`` is decimal(38,0), exact, and null beyond that. Along a component without variance
    (equal rows, fewer rows than dimensions) ``whitened`` and ``explained`` are 0.
    """
    out = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    d, k = model.length, min(components, model.length)
    explained = np.where(model.scores()[:k] > 0, model.variances[:k] / (model.trace or 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = part.num_rows
                x = whole(matrix(part.column(1), d), scale, shift)
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, model.n)),
                        _deviation(x, model).take(again),
                        pa.array(project(x, model, k).ravel()),
                        pa.array(np.tile(explained, rows)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained"],
                )

    return _valid(rows, vector, d, F.col(id).cast("long").alias("id")).mapInArrow(run, out)


def op11(spark, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every embedding; ``deviation`` is null where a long cannot hold it."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(rows)
    error = identity_error(rows, model) if model else 0.0
    found = whiten(rows, model)
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))
