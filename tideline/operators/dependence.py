"""Partial dependence of forests from counts of rows by node."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_dir
from .blocks import SLICES, slices, summed


@dataclass
class FlatTree:
    """A tree of a fitted forest as arrays by node; ``feature`` is -1 at leaves, whose value is the probability of class 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def flat_trees(spark: SparkSession, forest: RandomForestClassificationModel) -> list[FlatTree]:
    """The trees of a binary forest on numeric features, from its saved nodes: as many rows as the model has nodes."""
    path = f"{shared_dir(spark)}/tideline-stage/{uuid.uuid4().hex}"
    forest.save(path)
    saved = spark.read.parquet(f"{path}/data")
    nested = "nodeData." if "nodeData" in saved.columns else ""
    fields = ["id", "impurityStats", "leftChild", "rightChild", "split"]
    rows = saved.select("treeID", *[F.col(nested + f).alias(f) for f in fields]).orderBy("treeID", "id").collect()
    trees = []
    for _, nodes in groupby(rows, key=lambda r: r["treeID"]):
        nodes = list(nodes)
        at = {r["id"]: i for i, r in enumerate(nodes)}
        inner = [r["leftChild"] >= 0 for r in nodes]
        if any(r["split"]["numCategories"] != -1 for r, i in zip(nodes, inner) if i):
            raise ValueError("categorical splits are not supported")
        trees.append(
            FlatTree(
                np.array([r["split"]["featureIndex"] if i else -1 for r, i in zip(nodes, inner)]),
                np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(nodes, inner)]),
                np.array([at.get(r["leftChild"], -1) for r in nodes]),
                np.array([at.get(r["rightChild"], -1) for r in nodes]),
                np.array([r["impurityStats"][1] / sum(r["impurityStats"]) for r in nodes]),
            )
        )
    return trees


def _reached(tree: FlatTree, x: np.ndarray, feature: int) -> np.ndarray:
    """Rows that reach each node when splits on ``feature`` let every row through to both sides."""
    counts = np.zeros(len(tree.feature))
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        counts[node] = len(rows)
        f = tree.feature[node]
        if f < 0 or not len(rows):
            continue
        low = x[rows, f] <= tree.threshold[node]
        todo.append((tree.left[node], rows if f == feature else rows[low]))
        todo.append((tree.right[node], rows if f == feature else rows[~low]))
    return counts


def _of_leaves(tree: FlatTree, feature: int, grid: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the leaf values over rows, for each value of ``feature``."""
    total = np.zeros(len(grid))
    todo = [(0, np.ones(len(grid), bool))]
    while todo:
        node, here = todo.pop()
        f = tree.feature[node]
        if f < 0:
            total[here] += counts[node] * tree.value[node]
        else:
            low = grid <= tree.threshold[node]
            todo.append((tree.left[node], here & low if f == feature else here))
            todo.append((tree.right[node], here & ~low if f == feature else here))
    return total


def forest_dependence(forest: RandomForestClassificationModel, df: DataFrame, columns: Sequence[str], feature: str, points: int = 100, block: int = 4096) -> DataFrame:
    """Average score with ``feature`` set to each of ``points`` values over its range, without repeating rows.

    One pass counts, for every tree, the rows that reach each node once splits on ``feature``
    are left open; the leaves below a grid value then give its average. A task holds a block
    of rows and one number per node; as many go to the driver.
    """
    spark, columns = df.sparkSession, list(columns)
    j, trees = columns.index(feature), flat_trees(spark, forest)
    found = df.agg(F.min(feature).cast("double").alias("lo"), F.max(feature).cast("double").alias("hi"), F.count("*").alias("n")).first()
    if not found["n"]:
        raise ValueError("no rows")
    grid = found["lo"] + (found["hi"] - found["lo"]) * np.arange(points) / float(points - 1)
    ends = np.cumsum([0, *(len(t.feature) for t in trees)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1])
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = np.column_stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))])
                for k, tree in enumerate(trees):
                    total[ends[k] : ends[k + 1]] += _reached(tree, x, j)
        yield from slices(total)

    counts = summed(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, SLICES), int(ends[-1]))
    average = sum(_of_leaves(t, j, grid, counts[a:b]) for t, a, b in zip(trees, ends, ends[1:])) / found["n"] / len(trees)
    rows = [(feature, i, float(g), float(a)) for i, (g, a) in enumerate(zip(grid, average))]
    return spark.createDataFrame(rows, "feature string, point int, grid_value double, average double")
