"""Quality rules: gradient-boosted trees over statistics of a document.

The statistics are computed from whole texts in Arrow batches. The trees are fitted on a
bounded sample of labelled documents, with monotonic constraints on chosen features, and
flattened into numpy node arrays that score a batch of documents level by level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import documents, stage

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Statistics that every document gets, beside its id.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_stops", "n_bangs", "n_distinct")

#: Feature of the trees -> sign by which the chance of quality may change with it (0: freely).
FEATURES = {
    "symbols_per_word": -1,
    "repeat_share": -1,
    "dup_line_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "bangs_per_word": -1,
    "word_length": 0,
    "log_words": 0,
    "words_per_line": 0,
    "stops_per_word": 0,
    "distinct_share": 0,
}


def statistics(text: str) -> tuple[int, ...]:
    """The numbers of ``STATS`` for one text."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    repeated = 0
    hashes = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    if n >= WINDOW:
        windows = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + (hashes[i : n - WINDOW + 1 + i] ^ (hashes[i : n - WINDOW + 1 + i] >> np.uint64(29)))
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        hit = np.zeros(len(windows), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int64)
        edge[: len(hit)] += hit
        edge[WINDOW : WINDOW + len(hit)] -= hit
        repeated = int((np.cumsum(edge) > 0).sum())
    return (
        n,
        len(text) - count(SPACE),
        count(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(text),
        len(lines),
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        count(b"0123456789"),
        count(b".,;:?"),
        count(b"!"),
        len(set(words)),
    )


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The statistics of each document beside ``row``, a struct of the columns ``keep``.

    A null text counts as empty. Names in ``keep`` may be those of statistics.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = ", ".join([f"row {rows.schema['row'].dataType.simpleString()}", *(f"{s} long" for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(STATS)))], names=["row", *STATS])

    return rows.mapInArrow(run, out)


def features(stats: np.ndarray) -> np.ndarray:
    """Columns of ``STATS`` to columns of ``FEATURES``."""
    s = dict(zip(STATS, stats.astype(np.float64).T))
    words, chars, lines = (np.maximum(s[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.column_stack([
        s["n_symbols"] / words,
        s["n_repeat_words"] / words,
        s["n_dup_lines"] / lines,
        s["n_upper"] / chars,
        s["n_digits"] / chars,
        s["n_bangs"] / words,
        s["word_chars"] / words,
        np.log1p(s["n_words"]),
        s["n_words"] / lines,
        s["n_stops"] / words,
        s["n_distinct"] / words,
    ])


@dataclass
class Forest:
    """Nodes of all trees in one row of arrays; ``feature`` is -1 at a leaf, whose ``value`` counts."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``: all trees go down one level at a time."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return self.bias + self.value[at].sum(axis=1)
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)


def boost(x: np.ndarray, y: np.ndarray, signs: Sequence[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Forest:
    """Boosted trees for the chance of ``y = 1`` by second-order steps on binned features.

    A split on a feature with a sign is allowed only if the two sides' values are in that
    order; both then keep to their side of the middle, so no later split breaks it.
    """
    nodes: list[list[float]] = []
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 1.5)
        return Forest(np.zeros(0, np.int64), *(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, float)), float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))) if len(y) else 1.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    z, roots = np.full(len(y), bias), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rate * value])
        best = (1e-6, None)
        for f, e in enumerate(edges if level < depth and len(rows) >= 2 * least else []):
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            vl, vr = (np.clip(-a / (c + ridge), low, high) for a, c in ((gl, hl), (gs - gl, hs - hl)))
            # gain of the clipped values against one common value
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + ridge) * vr**2) + gs * value + 0.5 * (hs + ridge) * value**2
            bad = (nl < least) | (len(rows) - nl < least) | ((vr - vl) * signs[f] < 0)
            gain[bad] = -1
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (gain[i], (f, i, float(vl[i]), float(vr[i])))
        if best[1] is None:
            z[rows] += rate * value
            return me
        f, i, vl, vr = best[1]
        middle, sign = (vl + vr) / 2, signs[f]
        side = binned[rows, f] <= i
        left = grow(rows[side], g, h, level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
        right = grow(rows[~side], g, h, level + 1, middle if sign > 0 else low, middle if sign < 0 else high)
        nodes[me][:4] = [f, float(edges[f][i]), left, right]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    a = np.array(nodes, float)
    return Forest(np.array(roots), a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], bias)


def fit(stats: DataFrame, labels: DataFrame, sample: int = 20_000, id: str = "doc_id", label: str = "quality") -> Forest:
    """Trees from at most ``sample`` labelled documents, those with the smallest hash of their id.

    Rows without id or label, and ids that two labels contradict, teach nothing.
    """
    known = (
        labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(id).alias("_id"))
        .agg(F.min(label).alias("_y"), F.max(label).alias("_other"))
        .filter("_y = _other")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    joined = stats.join(known, F.col(f"row.{id}") == F.col("_id")).select(*STATS, "_y")
    # Repeated ids could bring back more rows than labels: the bound is taken again.
    rows = joined.orderBy(F.xxhash64(*STATS), *STATS).limit(sample).toPandas().to_numpy(np.float64).reshape(-1, len(STATS) + 1)
    return boost(features(rows[:, :-1]), rows[:, -1], list(FEATURES.values()))


def judge(stats: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """``stats`` with ``base_failed``, ``quality`` (the trees' chance) and ``kept``.

    A document fails the fixed rule with fewer than 10 words, or if more than 20 % of them
    stand in repeated windows; else it is kept if the chance is at least ``least``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.column_stack([batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATS]).reshape(-1, len(STATS))
            chance = 1 / (1 + np.exp(-np.clip(forest.score(features(table)), -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], names=[*batch.schema.names, "quality"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.mapInArrow(run, f"{out}, quality double").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))


def op8(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    stats = stage(measure(documents(spark, sf_dir)))
    judged = judge(stats, fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
