"""Descriptive tables: frequencies, coverage, profiles, histograms, densities, correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_percent
from ..sources.sinks import stage
from .blocks import SLICES, slices, summed
from .ordered import lookup
from .quantiles import grouped_quantiles
from .reshape import first_per_key, top_per_group, unpivot_long


def strata_table(df: DataFrame, columns: Sequence[str], *, event: str, switch: str) -> DataFrame:
    """Count and percent per category overall and within outcome and switch strata.

    All covariates in one pass: long form (variable, category), then one aggregate.
    """
    e, s = F.col(event).cast("double") == 1.0, F.col(switch).cast("double") == 1.0
    flags = {"all": F.lit(True), "event": e, "no_event": ~e, "switched": s, "not_switched": ~s}
    marked = df.select(*[F.col(c).cast("string").alias(c) for c in columns], *[f.cast("int").alias(f"__{k}") for k, f in flags.items()])
    long = marked.unpivot([f"__{k}" for k in flags], list(columns), "variable", "category")
    n = long.groupBy("variable", "category").agg(*[F.sum(f"__{k}").alias(f"n_{k}") for k in flags])
    totals = df.agg(F.struct(*[F.count_if(f).alias(k) for k, f in flags.items()])).scalar()
    out = n.withColumn("__t", totals)
    out = out.withColumns({f"pct_{k}": F.try_divide(F.col(f"n_{k}") * 100.0, F.col("__t")[k]) for k in flags})
    return out.withColumns({f"label_{k}": count_percent(F.col(f"n_{k}"), F.col("__t")[k]) for k in flags}).drop("__t")


def measure_coverage(rows: DataFrame, entities: DataFrame, *, id: str, measure: str, t: str) -> DataFrame:
    """Entities having each measure, overall and up to day 0, and total rows.

    Reduced to (measure, entity) first, so distinct counting is plain counting.
    """
    per_entity = rows.groupBy(measure, id).agg(F.count("*").alias("k"), F.bool_or(F.col(t) <= 0).alias("pre"))
    n_entities = entities.agg(F.count("*")).scalar()
    out = per_entity.groupBy(measure).agg(F.count("*").alias("n_entities"), F.count_if("pre").alias("n_preindex"), F.sum("k").alias("n_rows"))
    return out.withColumns({"pct_entities": F.col("n_entities") * 100.0 / n_entities, "pct_preindex": F.col("n_preindex") * 100.0 / n_entities})


def count_of_counts(log: DataFrame, id: str) -> DataFrame:
    """How many entities have 1, 2, ... events."""
    return log.groupBy(id).agg(F.count("*").alias("n_events")).groupBy("n_events").agg(F.count("*").alias("n_entities"))


def event_shares(flagged: DataFrame, entities: DataFrame, *, kind: str, values: Sequence[str]) -> DataFrame:
    """Percent of entities with any event, and percent of events of each kind (one row)."""
    n = entities.agg(F.count("*")).scalar()
    shares = [(F.avg((F.col(kind) == v).cast("double")) * 100).alias(f"pct_{v}") for v in values]
    return flagged.agg(F.count_if("first").alias("n_with_event"), *shares).withColumn("pct_with_event", F.col("n_with_event") * 100.0 / n)


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing, mean, sd and five quantiles per numeric column."""
    long = unpivot_long(df, keys=[], columns=columns, name="variable")
    basic = long.groupBy("variable").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    q = grouped_quantiles(long, ["variable"], "value", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0})
    return basic.join(q, "variable", "left").withColumn("complete_rate", 1 - F.col("n_missing") / F.col("n"))


def profile_text(df: DataFrame, columns: Sequence[str], top: int = 4) -> DataFrame:
    """Rows, missing, distinct values and the most frequent categories per text column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "variable", "value")
    counts = long.groupBy("variable", "value").agg(F.count("*").alias("k"))
    basic = counts.groupBy("variable").agg(
        F.sum("k").alias("n"),
        F.sum(F.when(F.col("value").isNull(), F.col("k")).otherwise(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
    )
    best = top_per_group(counts.filter("value is not null"), ["variable"], [F.col("k").desc(), F.col("value")], top)
    tops = best.groupBy("variable").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("o"), "value", "k"))), lambda s: F.concat_ws(": ", s["value"], s["k"].cast("string"))), ", ").alias("top_counts"))
    return basic.join(tops, "variable", "left")


def measure_corr(rows: DataFrame, *, keys: Sequence[str], measure: str, value: str, order: Sequence, measures: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of measures taken together (same ``keys``).

    One value per (key, measure) is kept by an explicit order; a key's values become one short
    list, no wider than ``measures``. Tasks add up products of blocks of keys: how
    often two measures meet, and their sums, squares and products there, centred by the measures'
    means. So there is no pivot and no column per pair. Missing when a side does not vary.
    """
    measures = list(measures)
    m = len(measures)
    at = F.element_at(F.create_map(*[x for i, n in enumerate(measures) for x in (F.lit(n), F.lit(i))]), F.col(measure))
    single = first_per_key(rows.filter(F.col(measure).isin(measures)), [*keys, measure], order).filter(F.col(value).isNotNull())
    single = single.select(*keys, at.alias("i"), F.col(value).cast("double").alias("v"))
    lists = stage(single.groupBy(*keys).agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v")).select("i", "v"))
    centre = np.zeros(m)
    for r in lists.select(F.explode(F.arrays_zip("i", "v")).alias("x")).groupBy("x.i").agg(F.avg("x.v").alias("mean")).collect():  # one row per measure
        centre[r["i"]] = r["mean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, m, m))
        step = max(1, (1 << 22) // m)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                col = part.column(0).flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column(0).offsets.to_numpy()))
                x, here = np.zeros((part.num_rows, m)), np.zeros((part.num_rows, m))
                x[row, col], here[row, col] = part.column(1).flatten().to_numpy() - centre[col], 1.0
                total += here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x
        yield from slices(total.ravel())

    n, s, q, c = summed(lists.mapInArrow(run, SLICES), 4 * m * m).reshape(4, m, m)
    out = []
    for a in range(m):
        for b in range(a + 1, m):
            k, r = n[a, b], None
            if k:
                va, vb = q[a, b] - s[a, b] ** 2 / k, q[b, a] - s[b, a] ** 2 / k
                if va > 1e-12 * q[a, b] and vb > 1e-12 * q[b, a]:
                    r = float((c[a, b] - s[a, b] * s[b, a] / k) / math.sqrt(va * vb))
            out.append((measures[a], measures[b], int(k), r))
    return rows.sparkSession.createDataFrame(out, "a string, b string, n long, r double")


def histogram_width(df: DataFrame, by: Sequence[str], value: str, width: float) -> DataFrame:
    """Counts per fixed-width bin; a bin starts at ``bin * width``."""
    b = F.floor(F.col(value) / F.lit(width))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def histogram_equal(df: DataFrame, by: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins over each group's own range; the maximum falls in the last bin."""
    d = df.filter(F.col(value).isNotNull())
    counts = d.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__k"))
    ranges = counts.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    r = lookup(counts, ranges, by, hot="all")
    at = F.floor(F.try_divide((F.col("__v") - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo")))
    b = F.least(F.lit(bins - 1).cast("long"), F.coalesce(at, F.lit(0).cast("long")))
    return r.groupBy(*by, b.alias("bin")).agg(F.sum("__k").alias("n"))


def density_curve(df: DataFrame, by: Sequence[str], value: str, *, points: int = 512, per_bandwidth: int = 8, reach: float = 6.0) -> DataFrame:
    """Gaussian kernel density per group on an even grid over its range.

    Bandwidth ``h = 0.9 min(sd, iqr / 1.34) n^(-1/5)``. Values are first gathered in cells of width
    ``h / per_bandwidth``, of which only those with values exist, so far outliers cost nothing. A cell
    keeps its values' number, mean and squared deviation, with which it stands for their kernels up to
    third order, and feeds the grid points within ``reach`` bandwidths (beyond, a kernel is below 2e-8 of its height).
    """
    by = list(by)
    v = F.col(value).cast("double")
    d = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("v"))
    stats = d.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    q = grouped_quantiles(d, by, "v", {"q1": 0.25, "q3": 0.75})
    stats = lookup(stats, q, by, "inner", hot="all")
    spread = F.least("sd", F.when(F.col("q3") > F.col("q1"), (F.col("q3") - F.col("q1")) / 1.34))
    stats = stage(stats.withColumn("h", 0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).filter("h > 0").select(*by, "n", "lo", "hi", "h"))
    u = (F.col("v") - F.col("lo")) / F.col("h")
    # in units of h from the group's least value
    values = lookup(d, stats, by, "inner", hot="all").withColumn("u", u)
    cell = F.floor(F.col("u") * per_bandwidth)
    off = F.col("u") - (cell + 0.5) / per_bandwidth
    cells = values.groupBy(*by, "n", "lo", "hi", "h", cell.alias("cell")).agg(F.count("*").alias("k"), F.avg(off).alias("__m"), F.avg(off * off).alias("__q"))
    cells = cells.withColumn("mean", (F.col("cell") + 0.5) / per_bandwidth + F.col("__m")).withColumn("m2", F.greatest(F.col("__q") - F.col("__m") * F.col("__m"), F.lit(0.0)))
    gap = (F.col("hi") - F.col("lo")) / F.col("h") / float(points - 1)
    first, last = F.greatest(F.ceil((F.col("mean") - reach) / gap), F.lit(0)), F.least(F.floor((F.col("mean") + reach) / gap), F.lit(points - 1))
    fed = cells.filter(first <= last).withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    z = F.col("point") * gap - F.col("mean")
    share = F.col("k") * F.exp(-0.5 * z * z) * (1 + (z * z - 1) * F.col("m2") / 2)
    # every point of the grid, those that nothing reaches too
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*by, "n", "lo", "hi", "h", "point", F.lit(0.0).alias("share"))
    both = fed.select(*by, "n", "lo", "hi", "h", "point", share.alias("share")).unionByName(grid)
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(float(points - 1))
    return both.groupBy(*by, "n", "lo", "hi", "h", "point").agg((F.sum("share") / F.first(F.col("n") * F.col("h")) / math.sqrt(2 * math.pi)).alias("density")).select(*by, "point", x.alias("x"), "density")
