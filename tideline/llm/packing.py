"""Best-fit packing of pieces into sequences, planned on a histogram of lengths.

Lengths are whole numbers up to the capacity, so the whole packing problem is a table of
at most ``capacity`` counts, whatever the corpus. The plan made from it says which lengths
share a sequence and how often; pieces then find their places by their rank among the
pieces of the same length.

Of the lengths above a third of the capacity at most two share a sequence: the largest is
matched with the largest that still fits. The shorter ones go, longest first, into the
tightest gap that takes them, and only then into new sequences.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import documents, stage
from tideline.llm.tokens import pieces

#: Bits of a rank below the length in a slot's key.
RANK_BITS = 40


@dataclass
class Plan:
    """Slots sorted by ``key`` = length and first rank; rank r of the slot goes to sequence ``base`` + r at ``offset``."""

    key: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def arrange(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(sequences, [(length, times), ...])``: how many sequences hold which lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    gaps: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            fits = np.flatnonzero(left[third + 1 : min(a, capacity - a) + 1])
            b = int(fits[-1]) + third + 1 if len(fits) else 0
            if b == a and left[a] == 1:
                b = int(fits[-2]) + third + 1 if len(fits) > 1 else 0
            n = int(left[a]) if not b else int(left[a]) // 2 if a == b else int(min(left[a], left[b]))
            left[a] -= n
            if b:
                left[b] -= n
            gaps[capacity - a - b].append((n, ((a, 1), (b, 1)) if b else ((a, 1),)))
    for a in range(third, 0, -1):
        n = int(left[a])
        for gap in range(a, capacity) if n else ():
            while n and gaps[gap]:
                room, (bins, held) = gap // a, gaps[gap].pop()
                full = min(bins, n // room)
                rest = n - full * room if full < bins else 0
                if rest >= room:
                    rest = 0
                if full:
                    gaps[gap - room * a].append((full, (*held, (a, room))))
                if rest:
                    gaps[gap - rest * a].append((1, (*held, (a, rest))))
                if bins - full - bool(rest):
                    gaps[gap].append((bins - full - bool(rest), held))
                n -= full * room + rest
        room = capacity // a
        if n // room:
            gaps[capacity - room * a].append((n // room, ((a, room),)))
        if n % room:
            gaps[capacity - n % room * a].append((1, ((a, n % room),)))
    return [(n, list(held)) for _, groups in sorted(gaps.items()) for n, held in groups]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    used: dict[int, int] = defaultdict(int)
    slots, sequences = [], 0
    for n, held in arrange(counts, capacity):
        offset = 0
        for length, times in held:
            for _ in range(times):
                slots.append(((length << RANK_BITS) + used[length], sequences - used[length], offset))
                used[length] += n
                offset += length
        sequences += n
    table = np.array(sorted(slots), np.int64).reshape(-1, 3)
    return Plan(table[:, 0], table[:, 1], table[:, 2], sequences)


def pack(items: DataFrame, capacity: int = 1024, length: str = "length") -> DataFrame:
    """(row, sequence_id, offset): every row of ``items``, whole in ``row``, with its place.

    Lengths run from 1 to ``capacity``; longer ones raise an error, null, 0 and below take no
    place (both columns null). An empty table gives an empty result.
    """
    valid = F.when(F.col(length) > capacity, F.raise_error(F.lit(f"a length exceeds the capacity of {capacity}"))).otherwise(F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)))
    rows = items.select(F.struct("*").alias("row"), valid.cast("long").alias("length"))
    kind = rows.schema["row"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            order = np.argsort(lengths, kind="stable")
            ranked = lengths[order]
            first = np.searchsorted(ranked, ranked, side="left")
            index = np.empty(len(lengths), np.int64)
            index[order] = np.arange(len(lengths)) - first + seen[ranked]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(index)], names=["row", "length", "part", "index"])

    numbered = stage(rows.mapInArrow(number, f"row {kind}, length long, part int, index long"))
    by_part = stage(numbered.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in by_part.filter("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(counts, capacity)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = numbered.join(offsets, ["part", "length"]).select("row", "length", (F.col("index") + F.col("ahead")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            slot = np.searchsorted(made.key, (lengths << RANK_BITS) + ranks, side="right") - 1
            none = lengths == 0
            slot[none] = 0
            base, offset = (made.base[slot], made.offset[slot]) if len(made.key) else (np.zeros(len(slot), np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base + ranks, mask=none), pa.array(offset, mask=none)], names=["row", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"row {kind}, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack(pieces(docs, capacity), capacity).select("row.*", "sequence_id", "offset")


def op6(spark, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids that hold all documents."""
    return packed(documents(spark, sf_dir))
