"""Filling missing values; fill values are computed in long form, grouped by column name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import missing_if_nan
from .quantiles import grouped_quantiles
from .reshape import unpivot_long


def column_fills(long: DataFrame, by: Sequence[str], value: str, how: str) -> DataFrame:
    """One fill value per ``by`` combination, missing and NaN skipped."""
    if how == "mean":
        return long.groupBy(*by).agg(F.avg(missing_if_nan(value)).alias("fill"))
    if how == "median":
        return grouped_quantiles(long, by, value, {"fill": 0.5})
    raise ValueError("how must be 'mean' or 'median'")


def fill_values(df: DataFrame, columns: Sequence[str], how: str) -> Column:
    """Scalar subquery holding the fill of every column as one map."""
    fills = column_fills(unpivot_long(df, keys=[], columns=columns), ["name"], "value", how)
    # one entry per listed column: bounded by the number of columns
    return fills.agg(F.map_from_entries(F.collect_list(F.struct("name", "fill")))).scalar()


def impute_columns(df: DataFrame, columns: Sequence[str], how: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Fill numeric columns with their mean or median over all rows (or over ``fit_on``)."""
    out = df.withColumn("__fills", fill_values(df if fit_on is None else fit_on, columns, how))
    filled = {c: F.coalesce(missing_if_nan(F.col(c).cast("double")), F.try_element_at("__fills", F.lit(c))) for c in columns}
    return out.withColumns(filled).drop("__fills")


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
