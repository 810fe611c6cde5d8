"""Logistic regression over a whole grid of penalties and folds in one fit.

All (strength, ratio, fold) models are the columns of one coefficient matrix. A step is one
map-only pass over the written rows: scores of all models are one matrix product, residuals
with the left-out fold set to 0 another, second derivatives a third. Sums are added inside
tasks and by slices of the matrix, and the driver, which holds (p + 1)(p + 2) / 2 numbers per
model at most, solves the penalised quadratic problems of all models together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_uniform
from ..sources.sinks import stage
from .blocks import SLICES, slices, summed
from .metrics_cls import auroc_ap

#: Numbers that one job may send to the driver.
PAYLOAD = 1 << 23
#: Scores that a task computes at a time.
SCORES = 1 << 21
METRICS = ("accuracy", "f1", "log_loss", "areaUnderROC", "areaUnderPR")


def penalty_grid(n: int, inverse: Sequence[float], ratios: Sequence[float]) -> list[tuple[float, float]]:
    """(strength, ratio) settings of inverse penalties C: a strength is 1 / (C n)."""
    return [(1.0 / (float(c) * n), float(r)) for r in ratios for c in inverse]


@dataclass
class GridFit:
    """``scores[i, k]``: setting i on held-out fold k (log loss: negated). ``coefficients[i]``: intercept first, fitted on all rows."""

    columns: list[str]
    settings: list[tuple[float, float]]
    metric: str
    scores: np.ndarray
    coefficients: np.ndarray
    steps: int

    @property
    def means(self) -> np.ndarray:
        return np.nanmean(self.scores, axis=1) if self.scores.size else np.full(len(self.settings), np.nan)

    def best(self, among: Sequence[int] | None = None) -> int:
        """Number of the best setting; the first of equally good ones."""
        among = list(range(len(self.settings)) if among is None else among)
        mean = np.where(np.isnan(self.means), -np.inf, self.means)
        return max(among, key=lambda i: (mean[i], -i))

    def table(self, spark) -> DataFrame:
        """(strength, ratio, mean, sd, nonzero) by setting: score over folds, and coefficients that are not 0."""
        sd = np.nanstd(self.scores, axis=1)
        rows = [(s, r, float(m), float(v), int((c[1:] != 0).sum())) for (s, r), m, v, c in zip(self.settings, self.means, sd, self.coefficients)]
        return spark.createDataFrame(rows, "strength double, ratio double, mean double, sd double, nonzero int")

    def probability(self, setting: int) -> Column:
        b = self.coefficients[setting]
        score = F.lit(float(b[0]))
        for c, v in zip(self.columns, b[1:]):
            if v:
                score = score + F.lit(float(v)) * F.col(c)
        return 1 / (1 + F.exp(-score))


def _passed(rows: DataFrame, of, size: int, p: int, step: int) -> np.ndarray:
    """Sum of the vectors ``of(fold, y, x)`` over blocks of at most ``step`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, p)
            for at in range(0, batch.num_rows, step):
                total += of(fold[at : at + step], y[at : at + step], np.column_stack([np.ones(len(y[at : at + step])), x[at : at + step]]))
        yield from slices(total)

    return summed(rows.select("fold", "y", "x").mapInArrow(run, SLICES), size)


def _derivatives(rows: DataFrame, beta: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log loss (m), gradient (m x q) and second derivatives (m x q x q) of the models in the rows of ``beta``, summed over rows."""
    m, q = beta.shape
    i, j = np.triu_indices(q)
    # settings at the same coefficients, as all are at the start, ask once
    once, back = np.unique(np.column_stack([out, beta]), axis=0, return_inverse=True)
    if len(once) < m:
        return tuple(v[back] for v in _derivatives(rows, once[:, 1:], once[:, 0].astype(out.dtype)))
    per = max(1, PAYLOAD // (1 + q + len(i)))
    if m > per:
        parts = [_derivatives(rows, beta[at : at + per], out[at : at + per]) for at in range(0, m, per)]
        return tuple(np.concatenate(v) for v in zip(*parts))

    def of(fold, y, x):
        z = x @ beta.T
        # columns of a left-out row are 0
        seen = fold[:, None] != out[None, :]
        # one exponential for the loss, the probability and its spread
        e = np.exp(-np.abs(z))
        r = 1 / (1 + e)
        residual = np.where(z >= 0, r, e * r)
        residual -= y[:, None]
        residual *= seen
        r *= e * r
        r *= seen
        loss = np.log1p(e, out=e)
        loss += np.maximum(z, 0)
        z *= y[:, None]
        loss -= z
        loss *= seen
        return np.concatenate([loss.sum(axis=0), (x.T @ residual).ravel(), ((x[:, i] * x[:, j]).T @ r).ravel()])

    v = _passed(rows, of, m * (1 + q + len(i)), q - 1, max(1, SCORES // m))
    h = np.zeros((m, q, q))
    h[:, i, j] = h[:, j, i] = v[m * (1 + q) :].reshape(len(i), m).T
    return v[:m], v[m : m * (1 + q)].reshape(q, m).T, h


def _solve(g: np.ndarray, h: np.ndarray, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray, rounds: int = 20, sweeps: int = 20) -> np.ndarray:
    """Minimum of ``g (b - beta) + (b - beta) h (b - beta) / 2 + l1 |b| + l2 b^2 / 2`` for many models; the first coordinate has no penalty.

    Coordinate sweeps find which coordinates are 0; between them the others are solved for at
    once, since sweeps alone creep where inputs depend on each other.
    """
    b, target = beta.copy(), np.einsum("mij,mj->mi", h, beta) - g
    q = beta.shape[1]
    own = np.diagonal(h, axis1=1, axis2=2)
    l1, l2 = np.outer(l1, np.arange(q) > 0), np.outer(l2, np.arange(q) > 0)
    whole = h + np.eye(q) * (l2 + 1e-10 * (own.max(axis=1, initial=0.0) + 1e-300)[:, None])[:, None, :]
    for _ in range(rounds):
        for _ in range(sweeps):
            moved = 0.0
            for c in range(q):
                rest = target[:, c] - np.einsum("mj,mj->m", h[:, c], b) + own[:, c] * b[:, c]
                with np.errstate(divide="ignore", invalid="ignore"):
                    new = np.sign(rest) * np.maximum(np.abs(rest) - l1[:, c], 0) / (own[:, c] + l2[:, c])
                new = np.where(np.isfinite(new), new, 0.0)
                moved = max(moved, float(np.abs(new - b[:, c]).max(initial=0.0)))
                b[:, c] = new
            if moved < 1e-11:
                return b
        on = (b != 0) | (np.arange(q) == 0)
        exact = np.linalg.solve(np.where(on[:, :, None] & on[:, None, :], whole, np.eye(q)), np.where(on, target - l1 * np.sign(b), 0.0)[..., None])[..., 0]
        # up to where the first of them becomes 0, if one does
        flips = on & (l1 > 0) & (np.sign(exact) != np.sign(b))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(flips, b / (b - exact), 1.0)
        part = share.min(axis=1, keepdims=True)
        b = np.where(flips & (share == part), 0.0, b + part * (exact - b))
    return b


def fit_grid(
    df: DataFrame, columns: Sequence[str], label: str, settings: Sequence[tuple[float, float]], *, id: str, seed, folds: int = 5, metric: str = "accuracy",
    max_iter: int = 100, tol: float = 1e-7,
) -> GridFit:
    """Every setting on all rows and on all but each fold (keyed by entity), scored on the fold.

    A setting (strength s, ratio a) adds ``s (a |b|_1 + (1 - a) |b|_2^2 / 2)`` to the mean log loss;
    inputs should be standardised. Rows with a missing or NaN input or label take no part. A model whose loss
    rises goes half the way back; one that still moves by ``tol`` after ``max_iter`` steps ends the fit with an error (separable rows
    without a penalty). ``metric`` is one of ``METRICS``; a fold on which it is not defined leaves the mean.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    columns, settings = list(columns), [(float(s), float(a)) for s, a in settings]
    x = F.array(*[F.col(c).cast("double") for c in columns])
    fold = F.floor(keyed_uniform(seed, "fold", F.col(id)) * folds).cast("int")
    rows = df.select(fold.alias("fold"), F.col(label).cast("double").alias("y"), x.alias("x"))
    rows = stage(rows.filter(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))))
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # one row per fold
    total, used = sum(sizes.values()), [-1, *sorted(sizes)]
    if not total:
        raise ValueError("no rows to fit")
    if len(used) < 3:
        used = [-1]
    out = np.repeat(used, len(settings))
    n = np.array([total - sizes.get(f, 0) for f in out], float)
    s, a = np.tile(np.array(settings).T, len(used))
    l1, l2 = s * a, s * (1 - a)
    beta = np.zeros((len(out), len(columns) + 1))
    back, before, last = beta.copy(), np.full(len(out), np.inf), np.full(len(out), np.inf)
    steps, whole = 0, np.flatnonzero(out == -1)
    for left in (whole, np.flatnonzero(out != -1)):
        # a fold is left out from where the fit on all rows ended
        beta[left] = np.tile(beta[whole], (len(left) // len(whole), 1))
        back[left], step = beta[left], 0
        while len(left):
            step += 1
            if step > max_iter:
                raise ArithmeticError(f"{len(left)} models have not converged after {max_iter} steps: an estimate may be infinite")
            loss, g, h = _derivatives(rows, beta[left], out[left])
            b = beta[left]
            value = loss / n[left] + l1[left] * np.abs(b[:, 1:]).sum(axis=1) + l2[left] * (b[:, 1:] ** 2).sum(axis=1) / 2
            worse = value > before[left] + 1e-12 * np.abs(before[left], where=np.isfinite(before[left]), out=np.zeros(len(left)))
            new = _solve(g / n[left][:, None], h / n[left][:, None, None], b, l1[left], l2[left])
            new[worse] = (b[worse] + back[left[worse]]) / 2
            good = left[~worse]
            back[good], before[good] = beta[good], value[~worse]
            # along inputs that depend on each other coefficients may go on moving after the loss has settled
            settled = np.abs(value - last[left]) <= 1e-14 * np.abs(value)
            last[left] = value
            still = (np.abs(new - b).max(axis=1) > tol * np.maximum(1, np.abs(new).max(axis=1))) & ~settled
            beta[left] = np.where(settled[:, None], b, new)
            left = left[still]
        steps += step
    scores = _scores(rows, beta, out, len(settings), used[1:], metric)
    return GridFit(columns, settings, metric, scores, beta[: len(settings)], steps)


def _scores(rows: DataFrame, beta: np.ndarray, out: np.ndarray, k: int, used: list[int], metric: str) -> np.ndarray:
    """Score of each setting (rows) on each held-out fold (columns)."""
    if not used:
        return np.zeros((k, 0))
    of_fold = {f: beta[out == f] for f in used}
    p = beta.shape[1] - 1
    if metric.startswith("area"):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold, x = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, p)
                for f in np.unique(fold):
                    mine = np.flatnonzero(fold == f)
                    for at in range(0, len(mine), max(1, SCORES // k)):
                        some = mine[at : at + max(1, SCORES // k)]
                        z = np.column_stack([np.ones(len(some)), x[some]]) @ of_fold[int(f)].T
                        again = pa.array(np.repeat(some, k))
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k, dtype=np.int32), len(some))), batch.column(0).take(again), batch.column(1).take(again), pa.array(z.ravel())], names=["s", "fold", "y", "score"])

        found = auroc_ap(rows.select("fold", "y", "x").mapInArrow(run, "s int, fold int, y double, score double"), ["s", "fold"], "y", "score")
        name = "auroc" if metric == "areaUnderROC" else "average_precision"
        result = np.full((k, len(used)), np.nan)
        for r in found.collect():  # one row per setting and fold
            if r[name] is not None:
                result[r["s"], used.index(r["fold"])] = r[name]
        return result

    def of(fold, y, x):
        """Per fold and setting: hits of either class, said and true positives, log loss, rows."""
        sums = np.zeros((len(used), 5, k))
        for i, f in enumerate(used):
            mine = fold == f
            if mine.any():
                z, t = x[mine] @ of_fold[f].T, y[mine][:, None] == 1
                said = z > 0
                sums[i] = (said == t).sum(axis=0), (said & t).sum(axis=0), said.sum(axis=0) + t.sum(), (np.logaddexp(0, z) - t * z).sum(axis=0), np.full(k, mine.sum())
        return sums.ravel()

    ok, both, either, loss, n = _passed(rows, of, len(used) * 5 * k, p, max(1, SCORES // k)).reshape(len(used), 5, k).transpose(1, 2, 0)
    if metric == "accuracy":
        return ok / n
    return np.where(either > 0, 2 * both / np.maximum(either, 1), 0.0) if metric == "f1" else -loss / n
