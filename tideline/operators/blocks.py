"""Sums of long vectors that tasks compute, by slices, so that no row is long and tasks share the adding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of one slice.
SLICE = 1 << 16
SLICES = "i int, v array<double>"


def slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's vector as rows (i, v)."""
    cut = range(0, len(total), SLICE)
    if len(cut):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), pa.array([total[a : a + SLICE] for a in cut], pa.list_(pa.float64()))], names=["i", "v"])


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        v = group["v"].combine_chunks()
        whole = v.flatten().to_numpy().reshape(len(v), -1).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([whole], pa.list_(pa.float64()))})

    out = np.zeros(size)
    for r in parts.groupBy("i").applyInArrow(add, SLICES).collect():
        out[r["i"] * SLICE : r["i"] * SLICE + len(r["v"])] = r["v"]
    return out
