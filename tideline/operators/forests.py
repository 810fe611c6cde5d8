"""Regression and classification forests for imputation, grown level by level over coded columns.

A fit packs its rows once: a byte or two per input, the target and a key, in blocks that stay with the
tasks. A level takes one map-only pass, in which a task finds the node of each drawn row in
every tree and adds up histograms of the target by value of the covariates that the node tries; only
these sums are shuffled. Splits are those of a random forest: the largest drop of the squared
error (numbers) or of the Gini impurity (texts). Rows are drawn with Poisson(1) weights that depend on the
row and the tree alone, whatever the layout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import poisson_cdf
from .blocks import SLICE

#: Numbers that one pass over the rows adds up; a level with more nodes takes several passes.
CELLS = 1 << 22
#: Rows of a packed block, and of a task at least.
BLOCK_ROWS = 1 << 15
TASK_ROWS = 2_000
#: Values by which a numeric input is cut.
BINS = 32
#: Texts with up to so many levels are parted in every way when there are more than two classes.
FEW = 5
#: Poisson(1) draw for each number of 16 bits.
DRAWS = np.searchsorted(np.array(poisson_cdf()), (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


@dataclass
class Forest:
    """Nodes of all trees in one numbering, the roots first. A leaf is its own child, and no code goes right of it."""

    inputs: list[str]
    #: By input: ascending cuts of a number (values up to a cut are left of it), or the number of a text's levels.
    codings: list[np.ndarray | int]
    trees: int
    depth: int
    #: Codes of an input at most.
    width: int
    feature: np.ndarray
    child: np.ndarray
    #: Nodes x codes: 1 where the code goes to the right child, ``child + 1``.
    right: np.ndarray
    #: Nodes x 1 (means) or nodes x classes (shares).
    value: np.ndarray


def numeric_cuts(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, np.ndarray]:
    """Cuts of each column: all different values but the largest if they are ``bins`` at most, otherwise quantiles."""
    columns = list(columns)
    if not columns:
        return {}
    probs = [i / bins for i in range(1, bins)]
    each = [F.struct(F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias("q"), F.approx_count_distinct(c).alias("n")).alias(f"c{i}") for i, c in enumerate(columns)]
    found = df.agg(*each).first()
    few = [i for i in range(len(columns)) if found[i]["n"] <= 2 * bins]
    sets = df.agg(*[F.collect_set(F.col(columns[i]).cast("double")).alias(f"c{i}") for i in few]).first() if few else ()  # some 2 x bins values
    known = {i: np.sort(np.array(v, float)) for i, v in zip(few, sets)}
    return {c: known[i][:-1] if i in known and len(known[i]) <= bins else np.unique(np.array(found[i]["q"] or [], float)) for i, c in enumerate(columns)}


def _code(columns: Sequence[np.ndarray], codings: Sequence[np.ndarray | int], kind) -> np.ndarray:
    """Rows x inputs: the number of cuts below a value, or a text's number."""
    return np.column_stack([(v if isinstance(c, int) else np.searchsorted(c, v, side="left")).astype(kind) for v, c in zip(columns, codings)])


def _kind(codings: Sequence[np.ndarray | int]) -> tuple[int, type]:
    width = max([c if isinstance(c, int) else len(c) + 1 for c in codings], default=1)
    return max(1, width), np.uint8 if width <= 256 else np.uint32


def _weights(key: np.ndarray, seed: int, four: int) -> np.ndarray:
    """Rows x 4: Poisson(1) draws of four trees from one hash of the key, to 1 in 65,536."""
    z = key.view(np.uint64) + np.uint64((seed * 1_000_003 + four + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return DRAWS.take((z ^ (z >> np.uint64(31))).view(np.uint16)).reshape(-1, 4)


def _descend(at: np.ndarray, base: np.ndarray, codes: np.ndarray, forest: Forest, steps: int) -> np.ndarray:
    """The nodes that rows reach from ``at``; ``base`` is where a row's codes begin."""
    for _ in range(steps):
        code = codes.take(base + forest.feature.take(at))
        at = forest.child.take(at) + forest.right.take(at * forest.width + code)
    return at


def _pack(df: DataFrame, target: str, forest: Forest, key: Column, centre: float, rows: int) -> DataFrame:
    """Blocks (n, key, y, codes), dealt over the tasks and kept there."""
    codings, kind = forest.codings, _kind(forest.codings)[1]

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        key, y, *x = (c.to_numpy() for c in t.columns)
        parts = key.tobytes(), (y - centre).tobytes(), _code(x, codings, kind).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([len(key)]), *(pa.array([v], pa.binary()) for v in parts)], names=["n", "key", "y", "codes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS))
    columns = [key.alias("__key"), F.col(target).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(forest.inputs)]]
    return df.select(*columns).repartition(tasks, "__key").mapInArrow(pack, "n long, key binary, y binary, codes binary")


def _pass(blocks: DataFrame, forest: Forest, open_: np.ndarray, owner: np.ndarray, tried: np.ndarray, level: int, classes: int, seed: int) -> np.ndarray:
    """Open nodes x tried inputs x codes x sums (rows and targets, or rows by class), over all rows."""
    tries, sums = tried.shape[1], classes or 2
    cells = tries * forest.width  # of a node
    size, slot = len(open_) * cells * sums, np.full(len(forest.feature), -1)
    slot[open_] = np.arange(len(open_))
    first = {int(k): int(i) for k, i in zip(*np.unique(owner, return_index=True))}
    upto = {k: first[k] + int(n) for k, n in zip(*np.unique(owner, return_counts=True))}
    by_try, p, kind = np.ascontiguousarray(tried.T), len(forest.inputs), _kind(forest.codings)[1]

    def add(total: np.ndarray, k: int, w: np.ndarray, y: np.ndarray, codes: np.ndarray) -> None:
        rows = np.flatnonzero(w)
        base = rows * p
        s = slot.take(_descend(np.full(len(rows), k), base, codes, forest, level))
        inside = np.flatnonzero(s >= 0)
        if len(inside) < len(s):
            rows, base, s = rows[inside], base[inside], s[inside]
        at = ((s - first[k]) * tries + np.arange(tries)[:, None]) * forest.width + codes.take(base + by_try.take(s, axis=1))
        own = total[first[k] * cells * sums : upto[k] * cells * sums]
        weight, y = w.take(rows).astype(float), y.take(rows)
        if classes:
            own += np.bincount((at * classes + y.astype(np.int64)).ravel(), np.tile(weight, tries), len(own))
        else:
            own[0::2] += np.bincount(at.ravel(), np.tile(weight, tries), len(own) // 2)
            own[1::2] += np.bincount(at.ravel(), np.tile(weight * y, tries), len(own) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                key, y, codes = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in ((1, np.int64), (2, float), (3, kind)))
                for four, own in itertools.groupby(sorted(first), lambda k: k // 4):
                    w = _weights(key, seed, four)
                    for k in own:
                        add(total, k, np.ascontiguousarray(w[:, k % 4]), y, codes)
        cut = range(0, size, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut))), pa.array([total[a : a + SLICE].tobytes() for a in cut], pa.binary())], names=["i", "v"])

    def added(key: tuple, group: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(v.as_buffer(), float) for v in group["v"]], axis=0)
        return pa.table({"i": [key[0].as_py()], "v": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros(size)
    for r in blocks.mapInArrow(run, "i long, v binary").groupBy("i").applyInArrow(added, "i long, v binary").collect():
        out[r["i"] * SLICE : r["i"] * SLICE + len(r["v"]) // 8] = np.frombuffer(r["v"], float)
    return out.reshape(len(open_), tries, forest.width, sums)


def _worth(s: np.ndarray, classes: int) -> np.ndarray:
    """What the split criterion adds up over the parts of a node, from their sums."""
    n = s.sum(axis=-1) if classes else s[..., 0]
    square = (s * s).sum(axis=-1) if classes else s[..., 1] ** 2
    return np.divide(square, n, out=np.zeros_like(n), where=n > 0)


def _parted(table: np.ndarray, coding: np.ndarray | int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node, of one input: the best split's gain, sums of its left part, and the codes that go right."""
    n, width, _ = table.shape
    total = table.sum(axis=1)
    rows = table.sum(axis=2) if classes else table[..., 0]
    if isinstance(coding, int) and classes > 2 and coding <= FEW:
        masks = np.array([m for m in itertools.product((0.0, 1.0), repeat=coding) if m[0] and not all(m)]).reshape(-1, coding)
        masks = np.pad(masks, ((0, 0), (0, width - coding)))
        left = np.einsum("cb,nbs->ncs", masks, table)
        goes_right = lambda best: masks[best] == 0
    elif isinstance(coding, int):  # levels in the order of their targets' mean, or, of several classes, impurity
        level = table[..., 1] if not classes or classes == 2 else rows - _worth(table, classes)
        order = np.argsort(np.divide(level, rows, out=np.full(rows.shape, np.inf), where=rows > 0), axis=1, kind="stable")
        left = np.take_along_axis(table, order[..., None], axis=1).cumsum(axis=1)[:, :-1]
        goes_right = lambda best: np.argsort(order, axis=1) > best[:, None]
    else:
        left = table.cumsum(axis=1)[:, :-1]
        goes_right = lambda best: np.arange(width) > best[:, None]
    if not left.shape[1]:
        return np.full(n, -1.0), total, np.zeros((n, width), bool)
    both = _worth(left, classes) + _worth(total[:, None] - left, classes)
    gain = both - _worth(total, classes)[:, None]
    count = left.sum(axis=-1) if classes else left[..., 0]
    # sums of another order choose the same split, and leave pure nodes alone
    valid = (count >= 0.5) & (rows.sum(axis=1)[:, None] - count >= 0.5) & (gain > 1e-9 * both)
    gain = np.where(valid, np.round(gain / np.where(valid, both, 1.0), 9) * both, -1.0)
    best = gain.argmax(axis=1)
    at = np.arange(n)
    return gain[at, best], left[at, best], goes_right(best)


def fit_forest(
    df: DataFrame, target: str, inputs: Sequence[str], codings: Sequence[np.ndarray | int], *, key: Column, rows: int, classes: int = 0, centre: float = 0.0, trees: int = 100, depth: int = 8, seed: int = 0
) -> Forest:
    """Forest for ``target`` (a number, or with ``classes`` a class number) from ``inputs`` without gaps.

    ``codings``: cuts of each numeric input, number of levels of each text, whose values are numbers from 0. A node tries a
    third of the inputs (classes: the square root of their number), rounded up, and splits if that is any gain.
    ``rows`` is about the number of rows; ``centre`` a number near the target's mean, for precision.
    """
    inputs, p = list(inputs), len(inputs)
    width, _ = _kind(codings)
    sums = classes or 2
    tries = p if trees == 1 else int(np.ceil(np.sqrt(p) if classes else p / 3))
    roots = np.arange(trees)
    forest = Forest(inputs, list(codings), trees, depth, width, np.zeros(trees, np.int64), roots.copy(), np.zeros(trees * width, np.uint8), np.zeros((trees, sums)))
    open_, owner = roots, roots
    blocks = _pack(df, target, forest, key, centre, rows).persist(StorageLevel.MEMORY_AND_DISK)
    for level in range(max(depth, 1)):
        step = max(1, CELLS // (tries * width * sums))
        draw = np.random.default_rng([seed, level, p]).random((len(open_), p))
        tried_all = np.sort(np.argsort(draw, axis=1)[:, :tries], axis=1)
        new = {"owner": [], "node": [], "feature": [], "right": [], "left": [], "total": []}  # entered after the level's last pass
        for a in range(0, len(open_), step):
            nodes, own, tried = open_[a : a + step], owner[a : a + step], tried_all[a : a + step]
            table = _pass(blocks, forest, nodes, own, tried, level, classes, seed)
            total = table[:, 0].sum(axis=1)
            gain, left, right = np.full((len(nodes), tries), -1.0), np.zeros((len(nodes), tries, sums)), np.zeros((len(nodes), tries, width), bool)
            for f in range(p if depth else 0):
                i, j = np.nonzero(tried == f)
                if len(i):
                    gain[i, j], left[i, j], right[i, j] = _parted(table[i, j], forest.codings[f], classes)
            if level == 0:
                forest.value[nodes] = total
            best = gain.argmax(axis=1)
            at = np.flatnonzero(gain[np.arange(len(nodes)), best] > 0)
            best = best[at]
            for name, v in (("owner", own[at]), ("node", nodes[at]), ("feature", tried[at, best]), ("right", right[at, best]), ("left", left[at, best]), ("total", total[at])):
                new[name].append(v)
        own, node, feature, right, left, total = map(np.concatenate, new.values())
        if not len(node):
            break
        size = len(forest.feature)
        open_, owner = size + np.arange(2 * len(node)), np.repeat(own, 2)
        table = forest.right.reshape(-1, width).copy()
        table[node] = right
        forest.feature[node], forest.child[node] = feature, open_[::2]
        forest.feature = np.concatenate([forest.feature, np.zeros(len(open_), np.int64)])
        forest.child = np.concatenate([forest.child, open_])
        forest.right = np.concatenate([table, np.zeros((len(open_), width), np.uint8)]).ravel()
        forest.value = np.concatenate([forest.value, np.stack([left, total - left], axis=1).reshape(-1, sums)])
    blocks.unpersist()
    n = forest.value.sum(axis=1, keepdims=True) if classes else forest.value[:, :1]
    top = forest.value if classes else forest.value[:, 1:]
    forest.value = np.divide(top, n, out=np.zeros_like(top), where=n > 0) + (0.0 if classes else centre)
    return forest


def predicted(forest: Forest) -> Column:
    """The trees' mean, or the class of the largest mean share (of equal ones the first)."""
    kind, p = _kind(forest.codings)[1], len(forest.inputs)

    def run(columns: Sequence[np.ndarray], n: int) -> np.ndarray:
        codes, base = _code(columns, forest.codings, kind).ravel(), np.arange(n) * p
        total = np.zeros((n, forest.value.shape[1]))
        for k in range(forest.trees):
            total += forest.value.take(_descend(np.full(n, k), base, codes, forest, forest.depth), axis=0)
        return total[:, 0] / forest.trees if total.shape[1] == 1 else total.argmax(axis=1).astype(float)

    @F.pandas_udf("double")
    def of(*x: pd.Series) -> pd.Series:
        return pd.Series(run([v.to_numpy(float) for v in x], len(x[0])))

    return of(*[F.col(c).cast("double") for c in forest.inputs])
