"""Exact interpolated quantiles without holding a group in one task.

Spark's exact ``percentile`` merges every distinct value of a group into one hash map.
Here values are first reduced to (value, count), ranked by :func:`ordered_scan`, and the
two order statistics around each requested rank are picked by a conditional aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_scan


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], buckets: int | None = None) -> DataFrame:
    """One row per group with a column per named probability (linear interpolation)."""
    by = list(by)
    for p in probs.values():
        if not 0.0 <= p <= 1.0:
            raise ValueError("probabilities must lie in [0, 1]")
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__k"))
    ranked = ordered_scan(counts, by, ["__v"], sums={"__upto": "__k"}, totals={"__all": ("sum", "__k")}, hot="all", buckets=buckets)
    at = {name: (F.col("__all") - 1) * F.lit(float(p)) for name, p in probs.items()}

    def pick(rank):
        return F.max(F.when((F.col("__upto") - F.col("__k") <= rank) & (rank < F.col("__upto")), F.col("__v")))

    aggs = [F.max("__all").alias("__all")]
    for name, h in at.items():
        aggs += [pick(F.floor(h)).alias(f"__lo_{name}"), pick(F.ceil(h)).alias(f"__hi_{name}")]
    picked = ranked.groupBy(*by).agg(*aggs)
    out = [F.col(b) for b in by]
    for name, h in at.items():
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*out)
