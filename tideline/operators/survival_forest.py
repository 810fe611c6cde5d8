"""Forest on left-truncated intervals, split by log-rank scores.

Rows are intervals ``(start, end]`` with an event flag. A node's risk set (rows entered minus
rows left) gives its cumulative hazard H; a row's score is its events minus H(end) - H(start).
Over the rows left of a split the scores add up to the log-rank numerator, observed minus
expected events, so that one histogram of scores by covariate value serves all splits of a node;
its permutation variance standardises it. Trees grow level by level in passes over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import poisson_cdf
from ..sources.sinks import stage
from .blocks import SLICES, slices, summed
from .intervals import in_force, stabbing_join
from .ordered import ordered_scan
from .quantiles import grouped_quantiles

#: Numbers that one pass over the rows adds up; a level with more nodes takes several passes.
CELLS = 1 << 22
#: Different event times at most: they are known to the driver and to every task.
MOST_TIMES = 1 << 20


@dataclass
class Tree:
    """Nodes as lists; ``feature`` is -1 at leaves. Codes up to ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    #: Leaf -> (numbers of the event times with an event in it, cumulative hazard after each).
    hazard: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1)):
            column += [empty, empty]
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature) - 2, len(self.feature) - 1
        return self.left[node], self.right[node]


@dataclass
class SurvivalForest:
    covariates: list[str]
    #: By covariate, ascending: values up to a cut go left of it.
    cuts: list[np.ndarray]
    #: All different event times, ascending.
    times: np.ndarray
    trees: list[Tree]


def _nodes(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """The leaf, as far as the tree is grown, of each row."""
    feature, cut, left, right = map(np.array, (tree.feature, tree.cut, tree.left, tree.right))
    at = np.zeros(len(codes), np.int64)
    moving = np.arange(len(codes))
    while True:
        moving = moving[feature[at[moving]] >= 0]
        if not len(moving):
            return at
        node = at[moving]
        at[moving] = np.where(codes[moving, feature[node]] <= cut[node], left[node], right[node])


def _codes(x: Sequence[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value; a missing value is above all of them."""
    return np.column_stack([np.searchsorted(c, v, side="left") for v, c in zip(x, cuts)])


def _weights(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Poisson(1) draws that depend on entity, seed and tree alone."""
    z = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(np.array(poisson_cdf()), u, side="right").astype(float)


def covariate_cuts(df: DataFrame, covariates: Sequence[str], bins: int = 32) -> list[np.ndarray]:
    """Different exact quantiles of each covariate, the minimum included and the maximum left out."""
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(covariates)])
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    found = {r["j"]: r for r in grouped_quantiles(df.select(F.inline(each)), ["j"], "v", probs).collect()}
    rows = [np.unique([found[j][q] for q in probs]) if j in found else np.zeros(0) for j in range(len(covariates))]
    return [r[:-1] for r in rows]


def _coded(df: DataFrame, covariates: Sequence[str], cuts: list[np.ndarray], times: np.ndarray, id: str, start: str, end: str, event: str) -> DataFrame:
    """(key, a, b, e, codes): at risk at the event times number a to b - 1 (from 0), a byte or two per covariate."""
    p = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, a, b, e, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            codes = _codes([v.astype(float) for v in x], cuts).astype(np.int16) if p else np.zeros((len(key), 0), np.int16)
            packed = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), *(pa.array(np.searchsorted(times, t, side="right").astype(np.int32)) for t in (a, b)), pa.array(e), packed], names=["key", "a", "b", "e", "codes"]
            )

    columns = [F.xxhash64(id), F.col(start).cast("double"), F.col(end).cast("double"), F.coalesce(F.col(event) > 0, F.lit(False)).cast("double"), *[F.col(c).cast("double") for c in covariates]]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return stage(rows.mapInArrow(run, "key long, a int, b int, e double, codes binary"))


def _pass(coded: DataFrame, trees: list[Tree], slots: list[tuple[int, int]], size: int, seed: int, bootstrap: bool, add) -> np.ndarray:
    """``add(total, slot, weight, a, b, e, codes)`` for every tree's rows in the nodes of ``slots``, summed over all rows."""
    used = sorted({k for k, _ in slots})
    where = {k: np.full(len(trees[k].feature), -1) for k in used}
    for i, (k, node) in enumerate(slots):
        where[k][node] = i
    grown = {k: trees[k] for k in used}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            key, a, b, e = (batch.column(i).to_numpy() for i in range(4))
            codes = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int16).reshape(len(key), -1)
            for k, tree in grown.items():
                w = _weights(key, seed, k) if bootstrap else np.ones(len(key))
                rows = np.flatnonzero(w)
                slot = where[k][_nodes(tree, codes[rows])]
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                add(total, slot, w[rows], a[rows], b[rows], e[rows], codes[rows])
        yield from slices(total)

    return summed(coded.mapInArrow(run, SLICES), size)


def _best_split(sums: np.ndarray, spread: float, features: np.ndarray, min_leaf: float, min_events: float, least: float) -> tuple[int, int] | None:
    """The split of largest standardised log-rank statistic; ``sums`` is features x codes x (rows, scores, events)."""
    below = sums[features].cumsum(axis=1)[:, :-1]
    all_rows, all_events = sums[0, :, 0].sum(), sums[0, :, 2].sum()
    n, u, e = below[..., 0], below[..., 1], below[..., 2]
    fits = (n >= min_leaf) & (all_rows - n >= min_leaf) & (e >= min_events) & (all_events - e >= min_events)
    if spread <= 0 or not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = np.where(fits, u * u * all_rows * (all_rows - 1) / (n * (all_rows - n) * spread), -1.0)
    worth = np.round(worth, 9)  # sums of another order choose the same split
    if worth.max() <= least:
        return None
    f, cut = np.unravel_index(worth.argmax(), worth.shape)
    return int(features[f]), int(cut)


def fit_survival_forest(
    df: DataFrame, covariates: Sequence[str], *, id: str, start: str = "start", end: str = "end", event: str = "event", trees: int = 100, depth: int = 6, tries: int | None = None,
    min_leaf: float = 15, min_events: float = 3, least: float = 0.0, bins: int = 32, bootstrap: bool = True, seed: int = 0,
) -> SurvivalForest:
    """Forest of ``trees`` trees on all event times.

    Entities are drawn with Poisson(1) weights, all their rows together. A node looks at
    ``tries`` covariates (default: the square root of their number, rounded up) and splits where
    the standardised log-rank statistic is largest and above ``least``, if both sides keep
    ``min_leaf`` rows and ``min_events`` events; of equal splits the first covariate's lowest cut
    is taken. Rows that end not after their start, or miss either, are left out; a missing event is none;
    a missing covariate is above all values. Without any event a tree is one leaf of hazard 0.

    Covariates and event times are coded once and written. A level takes two map-only passes
    (risk sets, then score histograms) for each ``CELLS`` numbers of its nodes; they alone reach the driver.
    """
    covariates, p = list(covariates), len(covariates)
    if not p:
        raise ValueError("at least one covariate is needed")
    to, happened = F.col(end).cast("double"), F.nanvl(F.col(event).cast("double"), F.lit(0.0))
    rows = df.filter((to > F.col(start)) & ~F.isnan(to)).withColumn(event, happened)
    seen = stage(rows.filter(F.col(event) > 0).select(F.col(end).cast("double").alias("t")).distinct())
    if seen.count() > MOST_TIMES:
        raise ValueError(f"more than {MOST_TIMES} different event times: round them first")
    times = np.sort(np.array([r["t"] for r in seen.collect()], float))
    cuts = covariate_cuts(rows, covariates, bins)
    coded = _coded(rows, covariates, cuts, times, id, start, end, event)
    T, B = len(times) + 1, max(map(len, cuts)) + 1
    tries = min(p, tries or int(np.ceil(np.sqrt(p))))
    model = SurvivalForest(covariates, cuts, times, [Tree() for _ in range(trees)])
    open_nodes = [(k, 0) for k in range(trees)]

    def add_risk(total, slot, w, a, b, e, codes):
        at = slot * 2 * T
        for place, weight in ((at + a, w), (at + b, -w), (at + T + b - 1, w * e)):
            np.add.at(total, np.maximum(place, 0), weight)

    for level in range(depth + 1):
        children = []
        step = max(1, CELLS // max(2 * T, 3 * p * B + 1))
        for first in range(0, len(open_nodes), step):
            slots = open_nodes[first : first + step]
            risk = _pass(coded, model.trees, slots, len(slots) * 2 * T, seed, bootstrap, add_risk).reshape(len(slots), 2, T)
            at_risk, dead = risk[:, 0].cumsum(axis=1)[:, :-1], risk[:, 1, :-1]
            rate = np.divide(dead, at_risk, out=np.zeros_like(dead), where=dead > 0)
            total_hazard = np.concatenate([np.zeros((len(slots), 1)), rate.cumsum(axis=1)], axis=1)
            split = [None] * len(slots)
            if level < depth:

                def add_scores(total, slot, w, a, b, e, codes):
                    score = e - (total_hazard[slot, b] - total_hazard[slot, a])
                    by = total[: -len(slots)].reshape(3, p, len(slots) * B)
                    for i, value in enumerate((w, w * score, w * e)):
                        for j in range(p):
                            np.add.at(by[i, j], slot * B + codes[:, j], value)
                    np.add.at(total[-len(slots) :], slot, w * score * score)

                sums = _pass(coded, model.trees, slots, len(slots) * (3 * p * B + 1), seed, bootstrap, add_scores)
                spread = sums[-len(slots) :]
                table = sums[: -len(slots)].reshape(3, p, len(slots), B).transpose(2, 1, 3, 0)
                for i, (k, node) in enumerate(slots):
                    features = np.sort(np.random.default_rng([seed, k, node]).choice(p, tries, replace=False))
                    split[i] = _best_split(table[i], spread[i], features, min_leaf, min_events, least)
            for i, (k, node) in enumerate(slots):
                if split[i] is None:
                    steps = np.flatnonzero(dead[i] > 0)
                    model.trees[k].hazard[node] = steps + 1, total_hazard[i, steps + 1]
                else:
                    children += [(k, c) for c in model.trees[k].split(node, *split[i])]
        open_nodes = children
    return model


def added_hazard(model: SurvivalForest, lower: Column, upper: Column) -> Column:
    """Mean over trees of the cumulative hazard between two times, at the row's covariates.

    The model travels with the expression: a number per leaf and event time with an event in it.
    """
    T, flat = len(model.times) + 1, []
    for tree in model.trees:
        keys, values = [], []
        for leaf in sorted(tree.hazard):
            steps, h = tree.hazard[leaf]
            keys += [[leaf * T], leaf * T + steps]
            values += [[0.0], h]
        flat.append((np.concatenate(keys).astype(np.int64), np.concatenate(values)))
    cuts, times, trees = model.cuts, model.times, model.trees

    @F.pandas_udf("double")
    def hazard(a: pd.Series, b: pd.Series, *x: pd.Series) -> pd.Series:
        codes = _codes([v.to_numpy(float) for v in x], cuts)
        a, b = (np.searchsorted(times, t.to_numpy(float), side="right") for t in (a, b))
        total = np.zeros(len(codes))
        for tree, (keys, values) in zip(trees, flat):
            leaf = _nodes(tree, codes) * T
            total += values[np.searchsorted(keys, leaf + b, side="right") - 1] - values[np.searchsorted(keys, leaf + a, side="right") - 1]
        return pd.Series(total / len(trees))

    return hazard(lower.cast("double"), upper.cast("double"), *[F.col(c).cast("double") for c in model.covariates])


def forest_survival(model: SurvivalForest, df: DataFrame, points: DataFrame, *, id: str, start: str = "start", end: str = "end", hot: Sequence | None = None) -> DataFrame:
    """(id, eval_t, surv): survival since the entity's first start at each time of ``points`` that an interval holds.

    An interval is in force in ``[start, end)``, an entity's last one for ever. Hazard adds up
    over the entity's intervals, each at its own covariates.
    """
    rows = in_force(df, id=id, start=start, end=end, until="end", hot=hot).withColumn("__own", added_hazard(model, F.col(start), F.col(end)))
    rows = ordered_scan(rows, [id], [start, end], sums={"__upto": "__own"}, hot=hot)
    met = stabbing_join(rows, points, lower=start, upper="until_t", at="eval_t").withColumn("__part", added_hazard(model, F.col(start), F.col("eval_t")))
    return met.select(id, "eval_t", F.exp(-(F.col("__upto") - F.col("__own") + F.col("__part"))).alias("surv"))
