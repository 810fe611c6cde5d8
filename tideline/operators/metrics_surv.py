"""Survival metrics: Kaplan-Meier, baseline hazard, concordance, risk strata."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import stage
from .ordered import bucket_of, cut_points, lookup, ordered_scan
from .quantiles import grouped_quantiles

Z95 = 1.959963984540054


def _life_table(df: DataFrame, by: Sequence[str], time: str, event: str, copies: str | None = None) -> DataFrame:
    """Events, censorings and numbers at risk per distinct time."""
    k = F.lit(1) if copies is None else F.col(copies)
    happened = F.col(event).cast("double") > 0
    at = df.filter(F.col(time).isNotNull()).groupBy(*by, F.col(time).cast("double").alias("t")).agg(
        F.sum(F.when(happened, k).otherwise(0)).alias("n_event"), F.sum(F.when(happened, 0).otherwise(k)).alias("n_censor")
    )
    at = at.withColumn("__k", F.col("n_event") + F.col("n_censor"))
    run = ordered_scan(at, by, ["t"], sums={"__upto": "__k"}, totals={"__all": ("sum", "__k")}, hot="all")
    return run.withColumn("n_risk", F.col("__all") - F.col("__upto") + F.col("__k")).select(*by, "t", "n_risk", "n_event", "n_censor")


def kaplan_meier(df: DataFrame, by: Sequence[str], time: str, event: str) -> DataFrame:
    """Product-limit curve per group with Greenwood error (log scale) and 95 % bounds.

    From the time on at which everybody left at risk has the event, the curve is 0 and
    its error and bounds are missing.
    """
    table = _life_table(df, by, time, event)
    d, n = F.col("n_event"), F.col("n_risk")
    steps = table.withColumns({
        "__ln": F.when(d < n, F.log1p(-d / n)).otherwise(0.0),
        "__v": F.when(d < n, d / (n * (n - d))).otherwise(0.0),
        "__z": F.when(d < n, 0).otherwise(1),
    })
    run = ordered_scan(steps, by, ["t"], sums={"__cln": "__ln", "__cv": "__v", "__cz": "__z"}, hot="all")
    alive = F.col("__cz") == 0
    se = F.sqrt("__cv")
    band = lambda s: F.when(alive, F.least(F.lit(1.0), F.exp(F.col("__cln") + s * Z95 * se)))
    return run.select(
        *by, "t", "n_risk", "n_event", "n_censor",
        F.when(alive, F.exp("__cln")).otherwise(0.0).alias("surv"),
        F.when(alive, se).alias("std_err"),
        band(-1).alias("lower"), band(1).alias("upper"),
    )


def censoring_survival(df: DataFrame, by: Sequence[str], time: str, event: str, copies: str | None = None) -> DataFrame:
    """Reverse product-limit curve: ``g`` at each time and ``g_before`` just before it.

    Entities with an event at a time are no longer at risk of being censored at it.
    """
    table = _life_table(df, by, time, event, copies)
    c, n = F.col("n_censor"), F.col("n_risk") - F.col("n_event")
    factor = F.when(c < n, F.log1p(-c / n)).otherwise(0.0)
    steps = table.withColumns({"__ln": factor, "__z": F.when((c > 0) & (c >= n), 1).otherwise(0)})
    run = ordered_scan(steps, by, ["t"], sums={"__cln": "__ln", "__cz": "__z"}, hot="all")
    before, zeros = F.col("__cln") - F.col("__ln"), F.col("__cz") - F.col("__z")
    return run.select(
        *by, "t",
        F.when(F.col("__cz") == 0, F.exp("__cln")).otherwise(0.0).alias("g"),
        F.when(zeros == 0, F.exp(before)).otherwise(0.0).alias("g_before"),
    )


def baseline_hazard(df: DataFrame, by: Sequence[str], *, start: str, end: str, event: str, risk: str) -> DataFrame:
    """Cumulative baseline hazard at event times; ``risk`` is ``exp(linear predictor)``.

    At risk at t: ``start < t <= end``, i.e. everything ending at or after t minus
    everything starting at or after t; both are running sums over distinct times.
    """
    happened = F.when(F.col(event) > 0, 1.0).otherwise(0.0)
    leave = F.struct(F.col(end).cast("double").alias("t"), F.col(risk).alias("w_end"), F.lit(0.0).alias("w_start"), happened.alias("d"))
    enter = F.struct(F.col(start).cast("double").alias("t"), F.lit(0.0).alias("w_end"), F.col(risk).alias("w_start"), F.lit(0.0).alias("d"))
    marks = df.select(*by, F.inline(F.array(leave, enter)))
    at = marks.groupBy(*by, "t").agg(*[F.sum(c).alias(c) for c in ("w_end", "w_start", "d")])
    run = ordered_scan(at, by, ["t"], sums={"__e": "w_end", "__s": "w_start"}, hot="all", descending=True)
    steps = run.filter("d > 0").select(*by, "t", "d", (F.col("__e") - F.col("__s")).alias("risk_sum"))
    steps = steps.withColumn("__h", F.col("d") / F.col("risk_sum"))
    return ordered_scan(steps, by, ["t"], sums={"cum_hazard": "__h"}, hot="all").drop("__h")


def risk_strata(df: DataFrame, by: Sequence[str], surv: str, name: str = "risk") -> DataFrame:
    """``low`` risk where survival is above the group median, otherwise ``high``."""
    rows = lookup(df, grouped_quantiles(df, by, surv, {"__median": 0.5}), by, hot="all")
    return rows.withColumn(name, F.when(F.col(surv) > F.col("__median"), "low").otherwise("high")).drop("__median")


#: Cells that ``c_index`` counts in one task at most, and chunks along each of time and risk where a group has more.
CHUNK_CELLS = 1 << 22
CHUNKS = 512
PAIR_SUMS = "usable double, concordant double, tied double"
#: Rows that a task packs at a time.
PACK_ROWS = 1 << 20


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """For each row the first row of its run of equal values."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for v in sorted_by:
        new[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(new)
    return np.repeat(first, np.diff(first, append=len(new)))


def pair_sums(place: np.ndarray, risk: np.ndarray, z: np.ndarray, q: np.ndarray) -> tuple[float, float, float]:
    """Usable, concordant and tied weight of the pairs (i, j) with ``place_j < place_i``.

    ``z`` counts j and ``q`` weights i; concordant: ``risk_i > risk_j``. A pair's lower rank
    shows at one bit: the higher bits agree, i has a 1 and j a 0. So every bit of the ranks is
    one running sum over rows in order of place, after which the rows of each 0 are put before those
    of each 1: a few steps over the rows for each bit, and no sort but the first.
    """
    if not len(place):
        return 0.0, 0.0, 0.0
    order = np.argsort(place, kind="stable")
    rank, place, z, q = np.unique(risk, return_inverse=True)[1].astype(np.int64)[order], place[order], z[order].astype(float), q[order].astype(float)
    before = lambda v: np.concatenate([[0], np.cumsum(v)])
    usable, won, at = before(z)[_starts(place)] @ q, 0.0, np.arange(len(place))
    for bit in reversed(range(int(rank.max()).bit_length())):
        one, node = (rank >> bit) & 1 == 1, _starts(rank >> (bit + 1))
        below, zeros = before(np.where(one, 0.0, z)), before(~one)
        mine = np.flatnonzero(one & (q > 0))
        won += (below[_starts(node, place)[mine]] - below[node[mine]]) @ q[mine]
        first = np.flatnonzero(node == at)
        sizes = np.diff(first, append=len(node))
        low = node + zeros[:-1] - zeros[node]
        to = np.where(one, at - zeros[:-1] + zeros[node] + np.repeat(np.diff(zeros[np.append(first, len(node))]), sizes), low)
        moved = [np.empty_like(v) for v in (rank, place, z, q)]
        for new, v in zip(moved, (rank, place, z, q)):
            new[to] = v
        rank, place, z, q = moved
    same = before(z)
    return float(usable), float(won), float((same[_starts(rank, place)] - same[_starts(rank)]) @ q)


def _packed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, cells): each task's cells (t, f, r) of a group with counts, as arrays in one binary value."""
    names = [f"b{i}" for i in range(len(by))]
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("n", T.LongType()), T.StructField("cells", T.BinaryType())])

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).rename_columns([*names, "t", "f", "r"])
        cells = table.group_by([*names, "t", "f", "r"], use_threads=False).aggregate([([], "count_all")])
        lists = cells.group_by(names, use_threads=False).aggregate([(c, "list") for c in ("t", "r", "count_all", "f")])
        parts = [lists[f"{c}_list"].combine_chunks() for c in ("t", "r", "count_all", "f")]
        at = parts[0].offsets.to_numpy()
        flat = [p.flatten().to_numpy().astype(kind) for p, kind in zip(parts, ("<f8", "<f8", "<i4", "i1"))]
        blocks = [b"".join(v[a:b].tobytes() for v in flat) for a, b in zip(at - at[0], at[1:] - at[0])]
        out = [lists[c].combine_chunks() for c in names] + [pa.array(np.diff(at).astype(np.int64)), pa.array(blocks, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=[*by, "n", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return rows.select(*by, "t", "f", "r").mapInArrow(pack, schema)


def _unpacked(n: pa.ChunkedArray, cells: pa.ChunkedArray) -> list[np.ndarray]:
    """Arrays t, r, k, f of packed cells."""
    parts = []
    for size, raw in zip(n.to_pylist(), cells):
        raw, at, one = raw.as_buffer(), 0, []
        for kind in ("<f8", "<f8", "<i4", "i1"):
            one.append(np.frombuffer(raw, kind, size, at))
            at += one[-1].nbytes
        parts.append(one)
    return [np.concatenate(v) for v in zip(*parts)]


def _heavy(cuts: Column, value: str) -> Column:
    return F.array_contains(cuts["heavy"], F.col(value))


def c_index(df: DataFrame, by: Sequence[str], *, time: str, event: str, risk: str, tau: str | None = None, weights: str = "none", largest: int | None = None) -> DataFrame:
    """Concordance per group: pairs whose earlier member had the event.

    Pair (i, j) is usable when i had the event and j was still under observation: ``T_j >
    T_i``, or ``T_j = T_i`` and j censored.  It is concordant when i has the higher risk;
    equal risks count half.  ``tau`` limits ``T_i``; ``weights="ipcw"`` weights a pair by
    the inverse probability of i and j being uncensored just before and at ``T_i``.
    Rows whose time or risk is NULL or NaN are in no pair; a group of such rows only is not returned.
    ``largest``: rows of a group at most, if the caller knows; it saves writing the cells to count them.

    No pairs are formed. Rows become cells (time, event, risk) with counts, which tasks pack by
    group before they are shuffled. A group of up to ``CHUNK_CELLS`` cells is counted by one task.
    Cells of larger ones lie in a grid of chunks of time and chunks of risk. Pairs in different chunks of both are counted
    from the grid; pairs in one chunk of time by the task that holds it, pairs in one
    chunk of risk (and different ones of time) likewise. So a row is shuffled twice, and a
    chunk holds about ``CHUNK_CELLS`` cells or a ``CHUNKS``-th of all. A time or risk that alone fills a chunk
    is one of its own, in which only one order is left to count; that is an ordered scan, which can be cut.
    """
    if weights not in ("none", "ipcw"):
        raise ValueError("weights must be 'none' or 'ipcw'")
    by = list(by)
    t, r = F.col(time).cast("double"), F.col(risk).cast("double")
    happened = F.coalesce(F.col(event).cast("double"), F.lit(0.0)) > 0
    kept = df.filter(t.isNotNull() & r.isNotNull() & ~F.isnan(t) & ~F.isnan(r))
    limit = F.lit(None).cast("double") if tau is None else F.col(tau).cast("double")
    # a column to group by where there is no other
    key = ["__g", *by]
    schema = "__g int, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*by).schema) + PAIR_SUMS
    one = lambda group, sums: pa.table({**{c: group[c].slice(0, 1) for c in key}, **{f.split()[0]: pa.array([v]) for f, v in zip(PAIR_SUMS.split(", "), sums)}})

    def placed(t: np.ndarray, e: np.ndarray) -> np.ndarray:
        # places from the latest time on; of one time the censored first, who outlive its events
        return 2 * np.unique(-t, return_inverse=True)[1].astype(np.int64) + e

    def in_time(group: pa.Table) -> pa.Table:
        t, e, r, z, q = (group[c].to_numpy() for c in ("t", "e", "r", "z", "q"))
        return one(group, pair_sums(placed(t, e), r, z, q))

    def whole(group: pa.Table) -> pa.Table:
        t, r, k, f = _unpacked(group["n"], group["cells"])
        return one(group, pair_sums(placed(t, f > 0), r, k, np.where(f == 2, k, 0)))

    if weights == "ipcw":
        rows = kept.select(*by, (t + 0.0).alias("t"), happened.alias("e"), (r + 0.0).alias("r"), limit.alias("tau"))
        cells = stage(rows.groupBy(*by, "t", "e", "r").agg(F.count("*").alias("k"), F.max("tau").alias("tau")))
        g = censoring_survival(cells, by, "t", "e", "k")
        cells = lookup(cells, g, [*by, "t"], hot="all", salts=8)
        pair_weight = F.coalesce(F.try_divide(F.lit(1.0), F.col("g") * F.col("g_before")), F.lit(0.0))
        usable, k = F.col("e") & (F.col("tau").isNull() | (F.col("t") <= F.col("tau"))), F.col("k").cast("double")
        cells = stage(cells.select(F.lit(0).alias("__g"), *by, "t", "e", "r", k.alias("z"), F.when(usable, k * pair_weight).otherwise(0.0).alias("q")))
        n = largest = cells.count()
        parts = cells.groupBy(*key).applyInArrow(in_time, schema) if largest <= CHUNK_CELLS else None
    else:
        flag = F.when(happened & (limit.isNull() | (t <= limit)), 2).when(happened, 1).otherwise(0).cast("byte")  # 2: an event that makes pairs
        packed = _packed(kept.select(F.lit(0).alias("__g"), *by, (t + 0.0).alias("t"), flag.alias("f"), (r + 0.0).alias("r")), key)
        if largest is None or largest > CHUNK_CELLS:
            packed = stage(packed)
            sizes = packed.groupBy(*key).agg(F.sum("n").alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("n")).first()
            largest, n = sizes["largest"] or 0, sizes["n"] or 0
        parts = packed.groupBy(*key).applyInArrow(whole, schema) if largest <= CHUNK_CELLS else None
        if parts is None:
            cells = _as_rows(packed, key).groupBy(*key, "t", "e", "r").agg(F.sum("z").alias("z"), F.sum("q").alias("q"))
    if parts is None:
        parts = _by_chunks(cells, key, min(CHUNKS, -(-n // CHUNK_CELLS)), in_time, one, schema)
    sums = (parts.groupBy(*by) if by else parts).agg(*[F.sum(c).alias(c) for c in ("usable", "concordant", "tied")])
    return sums.select(*by, "usable", "concordant", "tied", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("usable")).alias("c_index"))


def _as_rows(packed: DataFrame, key: list[str]) -> DataFrame:
    """Packed cells as rows (t, e, r, z, q)."""
    more = [T.StructField(c, T.BooleanType() if c == "e" else T.DoubleType()) for c in ("t", "e", "r", "z", "q")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                t, r, k, f = _unpacked(own["n"], own["cells"])
                again = pa.array(np.zeros(len(t), np.int32))
                yield pa.RecordBatch.from_arrays([*(own[c].take(again) for c in key), *map(pa.array, (t, f > 0, r, k.astype(float), np.where(f == 2, k, 0.0)))], names=[*key, "t", "e", "r", "z", "q"])

    return packed.mapInArrow(rows, T.StructType([*packed.select(*key).schema.fields, *more]))


def _by_chunks(cells: DataFrame, key: list[str], chunks: int, in_time, one, schema: str) -> DataFrame:
    """Pair sums of cells in a grid of chunks; see ``c_index``."""
    cells = cells.withColumn("__t", cut_points(cells, "t", chunks)).withColumn("__r", cut_points(cells, "r", chunks))
    # chunk 2 b: the heavy value that begins bucket b; 2 b + 1: its other values
    cells = cells.withColumn("p", 2 * bucket_of(F.col("t"), F.col("__t")) + F.when(_heavy(F.col("__t"), "t"), 0).otherwise(1))
    cells = cells.withColumn("s", 2 * bucket_of(F.col("r"), F.col("__r")) + F.when(_heavy(F.col("__r"), "r"), 0).otherwise(1))
    cells = stage(cells.drop("__t", "__r"))

    def in_risk(group: pa.Table) -> pa.Table:
        p, r, z, q = (group[c].to_numpy() for c in ("p", "r", "z", "q"))
        place = p.max() - p
        return one(group, (0.0, *pair_sums(place, r, z, q)[1:]))

    def grid(group: pa.Table) -> pa.Table:
        p, s, z, q = (group[c].to_numpy() for c in ("p", "s", "z", "q"))
        place = p.max() - p
        usable, won, tied = pair_sums(place, s, z, q)
        # of one chunk of risk: decided inside it, or, where it is a single risk, tied
        heavy = s % 2 == 0
        return one(group, (usable, won, pair_sums(place[heavy], s[heavy], z[heavy], q[heavy])[2]))

    same_time = cells.filter("p % 2 = 1").groupBy(*key, "p").applyInArrow(in_time, schema)
    same_risk = cells.filter("s % 2 = 1").groupBy(*key, "s").applyInArrow(in_risk, schema)
    blocks = cells.groupBy(*key, "p", "s").agg(F.sum("z").alias("z"), F.sum("q").alias("q"))
    across = blocks.groupBy(*key).applyInArrow(grid, schema)
    # one time: its events against those censored at it, by risk
    alone = cells.filter("p % 2 = 0").groupBy(*key, "p", "r").agg(F.sum(F.when(F.col("e"), 0.0).otherwise(F.col("z"))).alias("z"), F.sum("q").alias("q"))
    run = ordered_scan(alone, [*key, "p"], ["r"], sums={"upto": "z"}, totals={"all": ("sum", "z")}, hot="all")
    single = run.groupBy(*key).agg(F.sum(F.col("q") * F.col("all")).alias("usable"), F.sum(F.col("q") * (F.col("upto") - F.col("z"))).alias("concordant"), F.sum(F.col("q") * F.col("z")).alias("tied"))
    return same_time.unionByName(same_risk).unionByName(across).unionByName(single)
