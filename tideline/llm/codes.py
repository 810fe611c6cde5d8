"""Vector code compression: four codebooks refined by rounds, nearest entries found with pivots.

A vector of integers is cut into parts; the codebook of each part position starts from the
vectors of smallest id and moves to the means of the parts assigned to its entries. The
nearest entry is found as in LAESA:

* Pivots are fixed vectors of a part position, spread over its first codebook. The distance
  of every part to every pivot is computed once and written beside the part.
* Each round computes distances from pivots to entries only. ``|d(part, pivot) - d(pivot,
  entry)|``, at its largest over pivots, is a lower bound of the distance to an entry. Entries
  are taken by rising bound and evaluated exactly, in integers, until the next bound exceeds
  the best distance found.

Codebooks (256 entries) and their sums are all that a round sends to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stage
from tideline.llm.whitening import matrix, sound, usual_length, whole

SCALE = 1024.0
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 8
#: Entries evaluated between two looks at the bounds, and rows that are worked on together.
STEP = 16
ROWS = 2048


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    top = max(int(np.abs(a).max()) if a.size else 0, int(np.abs(b).max()) if b.size else 0)
    if a.shape[-1] * 4 * top * top >= 1 << 62:
        a, b = a.astype(object), b.astype(object)
    gap = a - b
    return (gap * gap).sum(axis=-1)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows to all pivots."""
    return np.stack([np.sqrt(squared(rows, p[None, :]).astype(float)) for p in pivots], axis=1)


def choose_pivots(book: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: each next one is the farthest from those chosen."""
    at = [0]
    away = squared(book, book[:1])
    while len(at) < min(pivots, len(book)):
        at.append(int(away.argmax()))
        away = np.minimum(away, squared(book, book[at[-1]][None, :]))
    return book[at]


def nearest(rows: np.ndarray, known: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry (ties: lower index), and the number of exact evaluations.

    ``known``: distances of ``rows`` to ``pivots``.
    """
    n, m = len(rows), len(book)
    spread = distances(book, pivots)
    bound = np.abs(known[:, :1] - spread[None, :, 0])
    for p in range(1, len(pivots)):
        np.maximum(bound, np.abs(known[:, p : p + 1] - spread[None, :, p]), out=bound)
    # what rounding may have added to a bound
    bound -= 1e-12 * (known.max(axis=1, initial=0)[:, None] + spread.max(initial=0))
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    entry, best, active, evaluated = np.zeros(n, np.int64), None, np.arange(n), 0
    top = max((int(np.abs(v).max()) for v in (rows, book) if v.size), default=0)
    # below 2^53 products of doubles are exact, and quicker than those of integers
    small = rows.shape[1] * 4 * top * top < 1 << 53
    if small:
        rows, book = rows.astype(float), book.astype(float)
        lengths, sizes = (rows * rows).sum(axis=1), (book * book).sum(axis=1)
    for at in range(0, m, STEP):
        some = order[active, at : at + STEP]
        if small:
            d = (lengths[active, None] + sizes[some] - 2 * np.einsum("nd,nsd->ns", rows[active], book[some])).astype(np.int64)
        else:
            d = squared(rows[active, None, :], book[some])
        evaluated += d.size
        low = d.min(axis=1)
        first = np.where(d == low[:, None], some, m).min(axis=1)
        if best is None:
            best, entry = low, first
        else:
            if low.dtype != best.dtype:
                best, low = best.astype(object), low.astype(object)
            better = (low < best[active]) | ((low == best[active]) & (first < entry[active]))
            best[active[better]], entry[active[better]] = low[better], first[better]
        if at + STEP >= m:
            break
        active = active[bound[active, at + STEP] <= np.sqrt(best[active].astype(float)) * (1 + 1e-12)]
        if not len(active):
            break
    return entry, best if best is not None else np.zeros(n, np.int64), evaluated


def _numbers(values: np.ndarray) -> pa.Array:
    """Integers as decimal(38,0); null beyond."""
    if values.dtype == np.int64:
        return pa.array(values).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


class Codes:
    """Codebooks of the sound vectors of ``rows`` and the pivot distances of their parts.

    Null vectors, empty ones and those with a null, NaN or infinite component are dropped, as are
    vectors of another length than the usual one, which must be a multiple of ``parts``. Rows
    with a null id come last in the first codebooks, rows of one id by their components; with fewer
    than ``entries`` rows a codebook has one entry per row. Sums are exact up to 38 digits; beyond,
    the job ends with an error. Repeated rows count as often as they occur.
    """

    def __init__(self, rows: DataFrame, id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, pivots: int = PIVOTS):
        self.length, self.parts, self.spark = usual_length(rows, vector), parts, rows.sparkSession
        if self.length % parts:
            raise ValueError(f"vectors of {self.length} components cannot be cut into {parts} equal parts")
        self.width = self.length // parts
        kept = rows.filter(sound(vector) & (F.size(vector) == self.length)).select(F.struct(F.col(id).cast("long").alias("id"), *(F.col(c).alias(c) for c in keep)).alias("row"), F.col(vector).cast("array<double>").alias("v"))
        first = kept.orderBy(F.col("row.id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        start = whole(np.array([r["v"] for r in first], float).reshape(len(first), self.length), SCALE, 0)
        self.books = [start[:, p * self.width : (p + 1) * self.width] for p in range(parts)]
        self.pivots = [choose_pivots(b, pivots) for b in self.books] if len(first) else []
        self.rows = stage(self._measured(kept)) if len(first) else None

    def _measured(self, kept: DataFrame) -> DataFrame:
        """(row, v, far): ``far`` are the distances of each part to the pivots of its position."""
        pivots, width, length = self.pivots, self.width, self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = whole(matrix(batch.column(1), length), SCALE, 0)
                far = np.concatenate([distances(x[:, p * width : (p + 1) * width], v) for p, v in enumerate(pivots)], axis=1)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * far.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], names=["row", "v", "far"])

        return kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, v array<double>, far array<double>")

    def _assigner(self):
        books, pivots, width, length = self.books, self.pivots, self.width, self.length
        ends = np.cumsum([0, *(len(p) for p in pivots)])

        def assign(v: pa.Array, far: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            """(part, its integers, nearest entries, squared distances) of each part position."""
            x, away = whole(matrix(v, length), SCALE, 0), matrix(far, int(ends[-1]))
            for p, book in enumerate(books):
                rows = x[:, p * width : (p + 1) * width]
                entry, d, _ = nearest(rows, away[:, ends[p] : ends[p + 1]], book, pivots[p])
                yield p, rows, entry, d

        return assign

    def refine(self) -> None:
        """One round: every part goes to its nearest entry, entries to the floor of their parts' mean."""
        assign, width, parts, size = self._assigner(), self.width, self.parts, len(self.books[0])
        names = [f"s{i}" for i in range(width)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts * size, width), object), np.zeros(parts * size, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    for p, rows, entry, _ in assign(batch.column(0).slice(at, ROWS), batch.column(1).slice(at, ROWS)):
                        counts += np.bincount(p * size + entry, minlength=parts * size)
                        order = np.argsort(entry, kind="stable")
                        used, lo = np.unique(entry[order], return_index=True)
                        sums[p * size + used] += np.add.reduceat(rows[order], lo, axis=0).astype(object)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), *(pa.array([Decimal(c) for c in sums[used, i]], pa.decimal128(38, 0)) for i in range(width))], names=["slot", "n", *names])

        found = self.rows.select("v", "far").mapInArrow(run, "slot int, n long, " + ", ".join(f"{s} decimal(38,0)" for s in names))
        books = [[[int(c) for c in e] for e in b] for b in self.books]
        for r in found.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect():
            books[r["slot"] // size][r["slot"] % size] = [int(r[s]) // r["n"] for s in names]
        small = all(abs(c) < 1 << 52 for b in books for e in b for c in e)
        self.books = [np.array(b, np.int64 if small else object) for b in books]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, as decimals joined by commas."""
        return hashlib.sha256(",".join(str(int(c)) for b in self.books for e in b for c in e).encode()).hexdigest()

    def encode(self) -> DataFrame:
        """(row, code, error): two hexadecimal digits per part, and the squared distances' sum as decimal(38,0)."""
        kind = f"row {self.rows.schema['row'].dataType.simpleString()}, code string, error decimal(38,0)"
        assign = self._assigner()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    found = [(entry, d) for _, _, entry, d in assign(part.column(1), part.column(2))]
                    code = ["".join(f"{e:02x}" for e in row) for row in np.stack([e for e, _ in found], axis=1)]
                    total = sum((d.astype(object) if any(x.dtype == object for _, x in found) else d) for _, d in found)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(code, pa.string()), _numbers(total)], names=["row", "code", "error"])

        return self.rows.select("row", "v", "far").mapInArrow(run, kind)


def compress(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): a row per sound vector; see ``Codes``.

    ``label_error`` is the error summed over rows of the same label, null labels together. Errors are decimal(38,0).
    """
    codes = Codes(rows, id, vector, (label,), entries=entries)
    if codes.rows is None:
        return rows.sparkSession.createDataFrame([], "id long, code string, error decimal(38,0), label_error decimal(38,0), codebooks_sha256 string")
    for _ in range(rounds):
        codes.refine()
    found = stage(codes.encode()).select("row.id", F.col(f"row.{label}").alias("label"), "code", "error")
    # totals are combined before they are shuffled, and written: the join back is of plain tables, which Spark can split or broadcast by size
    totals = stage(found.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of every embedding; an error that a long cannot hold is null."""
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    fits = lambda c: F.expr(f"try_cast({c} AS BIGINT)").alias(c)
    return found.select(F.col("id").alias("vec_id"), "code", fits("error"), fits("label_error"), "codebooks_sha256")


def oracle(parts: int = PARTS, rounds: int = ROUNDS) -> str:
    """All distances of every round; DuckDB."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT id, part, min(w.d) AS d, arg_min(w.e, w.d * 1000 + w.e) AS entry FROM (SELECT x.id, x.part, {{'d': CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS BIGINT), 'e': b.entry}} AS w FROM x JOIN b{r} b ON x.part = b.part) GROUP BY id, part)"
        )
        if r < rounds:
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS v FROM (SELECT part, entry, i, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM (SELECT x.part, a.entry, unnest(range(1, len(x.v) + 1)) AS i, unnest(x.v) AS c FROM x JOIN a{r} a ON x.id = a.id AND x.part = a.part) GROUP BY part, entry, i) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"
            )
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), x AS MATERIALIZED (
  SELECT id, p AS part, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(p)
), b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, v FROM x WHERE id <= {ENTRIES}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (id), h
"""


ORACLE = oracle()
