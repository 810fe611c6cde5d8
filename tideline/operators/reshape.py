"""Name-based column selection, pivots and unpivots with explicit values."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def select_names(columns: Sequence[str], *, contains=(), starts=(), ends=(), matches=(), exclude=()) -> list[str]:
    """Columns whose name satisfies any of the given tests and contains no excluded text."""
    def keep(c):
        hit = any(x in c for x in contains) or c.startswith(tuple(starts)) or c.endswith(tuple(ends)) or any(re.search(m, c) for m in matches)
        return hit and not any(x in c for x in exclude)

    return [c for c in columns if keep(c)]


def without_names(df: DataFrame, *, contains=(), ends=()) -> DataFrame:
    return df.drop(*select_names(df.columns, contains=contains, ends=ends))


def pivot_wide(df: DataFrame, *, keys: Sequence[str], names: str, values: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """``{value}_{level}`` columns from explicit levels (no discovery pass)."""
    if len(values) == 1:
        wide = df.groupBy(*keys).pivot(names, list(levels)).agg(F.first(values[0], ignorenulls=True))
        return wide.select(*keys, *[F.col(f"`{m}`").alias(f"{values[0]}_{m}") for m in levels])
    wide = df.groupBy(*keys).pivot(names, list(levels)).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])
    return wide.select(*keys, *[F.col(f"`{m}_{v}`").alias(f"{v}_{m}") for v in values for m in levels])


def unpivot_long(df: DataFrame, *, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long; rows with missing values stay."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), name, value)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in an explicit order.

    ``row_number() <= 1`` is limited inside every map task before the shuffle, so a key
    with many copies sends at most one row per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn <= 1").drop("__rn")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group in an explicit order (trimmed before the shuffle)."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def complete_grid(spine: DataFrame, id: str, name: str, levels: Sequence[str]) -> DataFrame:
    """Every entity with every level: exploding a fixed list, linear in entities."""
    return spine.select(id).distinct().withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))


def varset_columns(columns: Sequence[str], base: Sequence[str], period: str = "accrual") -> dict[str, list[str]]:
    """Five nested feature sets chosen by column name."""
    recent = select_names(columns, starts=["recent_value"])
    mean_max = select_names(columns, starts=[f"mean_{period}", f"max_{period}"])
    slope = select_names(columns, starts=[f"recent_slope_{period}"])
    accrual = select_names(columns, contains=[f"_{period}_"], exclude=["n_obs"])
    keep = lambda cs: list(base) + [c for c in columns if c in set(cs)]
    return {
        "none": list(base),
        "recent": keep(recent),
        "recent_mean_max": keep(recent + mean_max),
        "recent_mean_max_slope": keep(recent + mean_max + slope),
        "all": keep(recent + accrual),
    }
