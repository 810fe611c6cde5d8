"""Event logs: unions, flags, counts and outcome labels per entity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import lookup, ordered_scan


def existence_flag(df: DataFrame, id: str, name: str, where: Column | None = None) -> DataFrame:
    """One row per entity seen (optionally under a condition) with ``name`` = 1."""
    rows = df if where is None else df.filter(where)
    return rows.select(id).distinct().withColumn(name, F.lit(1.0))


def union_rows(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack tables under a source tag; columns missing from one side become NULL."""
    if not parts:
        raise ValueError("nothing to union")
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_count(parts: Sequence[DataFrame], id: str, name: str) -> DataFrame:
    """Rows per entity over several logs."""
    ids = reduce(lambda a, b: a.unionByName(b), [p.select(id) for p in parts])
    return ids.groupBy(id).agg(F.count("*").alias(name))


def subtype(indicator: str, value: str, otherwise: str) -> Column:
    """``value`` where the indicator carries it, else the default (NULL included)."""
    return F.when(F.col(indicator) == value, F.lit(value)).otherwise(F.lit(otherwise))


def within_follow_up(log: DataFrame, ends: DataFrame, id: str, t: str, end: str, hot: Sequence | None = None) -> DataFrame:
    """Keep events up to the end of follow-up; entities without an end lose their events."""
    return lookup(log, ends.select(id, end), [id], "inner", hot=hot).filter(F.col(t) <= F.col(end))


def event_flags(
    log: DataFrame,
    *,
    id: str,
    t: str,
    tie: Sequence[str],
    kind: str,
    kinds: Sequence[str],
    hot: Sequence | None = None,
) -> DataFrame:
    """First-event flag and per-entity totals on every event row.

    ``tie`` completes the order among events at the same time.  Adds ``first``, ``n``,
    ``n_<kind>`` for each of ``kinds`` and ``all_kinds`` (every kind occurs).
    """
    marks = {f"__k_{k}": F.when(F.col(kind) == k, 1).otherwise(0) for k in kinds}
    rows = log.withColumns(marks)
    totals = {"n": ("count", t)} | {f"n_{k}": ("sum", f"__k_{k}") for k in kinds}
    out = ordered_scan(rows, [id], [t, *tie], number="__rank", totals=totals, hot=hot)
    every = reduce(lambda a, b: a & b, [F.col(f"n_{k}") > 0 for k in kinds])
    return out.withColumn("first", F.col("__rank") == 1).withColumn("all_kinds", every).drop("__rank", *marks)


def first_events(flagged: DataFrame) -> DataFrame:
    return flagged.filter("first")


def label_cuts(mode: str, accrual: float | None, forecast: float | None) -> tuple[float, float]:
    """(prior cut, event cut) in days for a labelling mode."""
    if mode not in ("classification", "survival"):
        raise ValueError("mode must be 'classification' or 'survival'")
    if forecast is None or (mode == "classification" and accrual is None):
        raise ValueError(f"mode {mode!r} needs its windows")
    return (accrual, accrual + forecast) if mode == "classification" else (forecast, forecast)


def outcome_label(log: DataFrame, *, id: str, t: str, mode: str, accrual: float | None = None, forecast: float | None = None) -> DataFrame:
    """Prior-event count and first event after the cut, one row per entity in the log.

    Prior is ``t <= prior cut``, the outcome is the first ``t`` strictly above the event
    cut; an event in between counts for neither.  One map-side combined aggregate.
    """
    prior, cut = label_cuts(mode, accrual, forecast)
    return log.groupBy(id).agg(
        F.count_if(F.col(t) <= prior).alias("n_prior"),
        F.min(F.when(F.col(t) > cut, F.col(t))).alias("event_t"),
    ).withColumn("event", F.col("event_t").isNotNull())


def prior_events(log: DataFrame, *, id: str, t: str, mode: str, accrual: float | None = None, forecast: float | None = None) -> DataFrame:
    """The prior event times as rows.

    Kept long: one list per entity would put all events of an entity into one cell.
    """
    prior, _ = label_cuts(mode, accrual, forecast)
    return log.filter(F.col(t) <= prior).select(id, F.col(t).alias("prior_t"))


def outcome_label_fixed(log: DataFrame, *, id: str, t: str, accrual: float, forecast: float) -> DataFrame:
    """Prior count, and whether any event falls in ``(accrual, accrual + forecast]``."""
    inside = (F.col(t) > accrual) & (F.col(t) <= accrual + forecast)
    return log.groupBy(id).agg(F.count_if(F.col(t) <= accrual).alias("n_prior"), F.bool_or(inside).alias("event"))
