"""Encoding and scaling for the model stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_scan



def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, index): the distinct values of each column, numbered from 0 in sorted order.

    A table, not a list: any number of levels.
    """
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])))
    seen = pairs.filter("level is not null").distinct().withColumn("__o", F.conv(F.rpad(F.substring(F.hex("level"), 1, 12), 12, "0"), 16, 10).cast("double"))
    # the leading bytes order nearly all levels, the level itself the rest
    numbered = ordered_scan(seen, ["column"], ["__o", "level"], number="index", hot="all")
    return numbered.select("column", "level", (F.col("index") - 1).alias("index"))


def one_hot_sparse(df: DataFrame, keys: Sequence[str], columns: Sequence[str], missing: str | None = None) -> DataFrame:
    """Indicators in long form: (keys, column, index) for each value that is set, index as in ``level_table``."""
    value = lambda c: F.col(c).cast("string") if missing is None else F.coalesce(F.col(c).cast("string"), F.lit(missing))
    filled = df.select(*keys, *[value(c).alias(f"__v_{c}") for c in columns])
    long = filled.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__v_{c}").alias("level")) for c in columns])))
    levels = level_table(filled.select(*[F.col(f"__v_{c}").alias(c) for c in columns]), columns)
    return long.filter("level is not null").join(levels, ["column", "level"]).select(*keys, "column", "level", "index")


def one_hot(df: DataFrame, columns: Sequence[str], *, levels: dict[str, list[str]], drop: str = "binary", missing: str | None = None) -> DataFrame:
    """Indicator columns ``{column}_{level}`` replacing the originals.

    ``drop="binary"`` leaves out the first level only of two-level columns, ``"first"`` of
    all (full rank), ``"none"`` of none.  ``missing`` names the level standing for NULL.
    The levels become columns, so they are listed; for open-ended ones see ``one_hot_sparse``.
    A value that is not listed ends the query with an error; NULL gives zeros.
    """
    if drop not in ("binary", "first", "none"):
        raise ValueError("drop must be 'binary', 'first' or 'none'")
    if missing is not None:
        df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns})
    out = [F.col(c) for c in df.columns if c not in set(columns)]
    for c in columns:
        names = levels[c]
        known = F.col(c).isNull() | F.col(c).isin(list(names))
        stranger = F.raise_error(F.concat(F.lit(f"one_hot: {c} has a value that is not listed: "), F.col(c).cast("string")))
        if drop == "first" or (drop == "binary" and len(names) == 2):
            names = names[1:]
        out += [F.when(F.col(c) == v, F.lit(1.0)).when(known, F.lit(0.0)).otherwise(stranger).cast("double").alias(f"{c}_{v}") for v in names]
    return df.select(*out)


def standardize(df: DataFrame, columns: Sequence[str], *, fit_on: DataFrame | None = None, sample_sd: bool = False) -> DataFrame:
    """Mean 0, sd 1 per column; a constant column is only centred.

    Statistics come from all rows, or from ``fit_on``, as one scalar subquery.
    """
    sd = F.stddev_samp if sample_sd else F.stddev_pop
    fit = df if fit_on is None else fit_on
    stats = fit.agg(F.struct(*[F.struct(F.avg(c).alias("m"), sd(c).alias("s")).alias(c) for c in columns])).scalar()
    scaled = {c: (F.col(c) - F.col("__st")[c]["m"]) / F.when(F.col("__st")[c]["s"] > 0, F.col("__st")[c]["s"]).otherwise(1.0) for c in columns}
    return df.withColumn("__st", stats).withColumns(scaled).drop("__st")


def attach_names(df: DataFrame, vector: str, names: Sequence[str], value: str = "importance") -> DataFrame:
    """One row per (row, position) of an array column, named by position."""
    labels = F.array(*[F.lit(n) for n in names])
    rows = df.select(*[c for c in df.columns if c != vector], F.posexplode(vector).alias("position", value))
    return rows.withColumn("name", F.try_element_at(labels, F.col("position") + 1))
