"""Irregular measurements: windowed summaries, baselines, completion and imputation.

Everything stays long, one row per (entity, measure), until :func:`widen`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_unless
from ..sources.sinks import stage
from .impute import column_fills
from .models import impute_forest
from .ordered import hot_values, lookup, ordered_scan
from .reshape import complete_grid, pivot_wide, unpivot_long

STATS = ("n_obs", "mean", "max", "sd", "tv", "slope", "recent_slope")
ZERO_FILLED = ("n_obs", "slope", "recent_slope")
MODES = ("index", "event")


def transform(df: DataFrame, *, measure: str, value: str, untouched: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(value, log_unless(measure, value, untouched))


def check_mode(mode: str, accrual: float | None, forecast: float | None) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "event" and (accrual is None or forecast is None):
        raise ValueError("event mode needs accrual and forecast")


def period_label(df: DataFrame, *, t: str, mode: str, landmark: str | None = None, accrual: float | None = None, forecast: float | None = None) -> DataFrame:
    """Label measurements by window.

    ``index``: up to day 0 is ``preindex``, later ``accrual``, without an upper limit.
    ``event``: keep ``t <= landmark - forecast``; within ``accrual`` days before that is
    ``accrual``, earlier ``preindex``.  Rows without a landmark are dropped.
    """
    check_mode(mode, accrual, forecast)
    if mode == "index":
        return df.withColumn("period", F.when(F.col(t) <= 0, "preindex").otherwise("accrual"))
    close = F.col(landmark) - F.lit(float(forecast))
    kept = df.filter(F.col(t) <= close)
    return kept.withColumn("period", F.when(F.col(t) >= close - F.lit(float(accrual)), "accrual").otherwise("preindex"))


def latest_value(df: DataFrame, *, keys: Sequence[str], value: str, order: Sequence[str], name: str = "recent_value") -> DataFrame:
    """Value of the last row per key in an explicit order (mergeable, no window)."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))


def measure_stats(df: DataFrame, *, id: str, measure: str, t: str, value: str, order: Sequence[str], period: str = "period", recent: int = 3, latest: bool = False, hot: Sequence | None = None) -> DataFrame:
    """Seven statistics per (entity, measure, period) from one ordered pass.

    ``tv`` is the mean absolute successive difference; slopes are least squares on time,
    over all points and over the newest ``recent``; all missing for a single point.
    ``latest`` adds the last value and its order key, to be reduced over periods.
    """
    keys = [id, measure, period]
    rows = ordered_scan(df.select(*dict.fromkeys([*keys, *order, t, value])), keys, order, number="__i", totals={"__k": ("count", t)}, lag={"__prev": value}, hot=hot)
    newest = F.when(F.col("__k") - F.col("__i") < recent, F.col(value))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("sd"),
        F.avg(F.abs(F.col(value) - F.col("__prev"))).alias("tv"),
        F.regr_slope(F.col(value), F.col(t)).alias("slope"),
        F.regr_slope(newest, F.col(t)).alias("recent_slope"),
        *([F.max_by(value, F.struct(*order)).alias("last_value"), F.max(F.struct(*order)).alias("last_key")] if latest else []),
    )


def measure_summary(
    rows: DataFrame,
    entities: DataFrame,
    *,
    id: str,
    measure: str,
    t: str,
    value: str,
    order: Sequence[str],
    measures: Sequence[str],
    mode: str,
    landmark: str = "landmark",
    accrual: float | None = None,
    forecast: float | None = None,
    dropped: Sequence[str] = (),
    hot: Sequence | None = None,
) -> DataFrame:
    """Long summary, one row per (entity, measure), for every entity and listed measure.

    Columns are ``{stat}_{period}`` plus ``recent_value``.  In event mode the latest value
    is taken before the window is cut to the accrual period, and stands in for a missing
    mean or max.  Counts and slopes default to 0.
    """
    check_mode(mode, accrual, forecast)
    kept = [m for m in measures if m not in set(dropped)]
    hot = hot_values(rows, id) if hot is None else hot
    rows = rows.filter(F.col(measure).isin(kept))
    if mode == "event":
        rows = lookup(rows, entities.select(id, landmark), [id], "inner", hot=hot)
    labelled = period_label(rows, t=t, mode=mode, landmark=landmark, accrual=accrual, forecast=forecast)
    periods = ["accrual"] if mode == "event" else ["preindex", "accrual"]
    # one pass over the measurements; the latest value is the later of the periods' last ones
    stats = measure_stats(labelled, id=id, measure=measure, t=t, value=value, order=order, latest=True, hot=hot)
    wide = stats.groupBy(id, measure).agg(
        *[F.max(F.when(F.col("period") == p, F.col(s))).alias(f"{s}_{p}") for s in STATS for p in periods],
        F.max_by("last_value", "last_key").alias("recent_value"),
    )
    out = complete_grid(entities, id, measure, kept).join(wide, [id, measure], "left")
    if mode == "event":
        out = out.withColumns({c: F.coalesce(c, "recent_value") for c in ("mean_accrual", "max_accrual")})
    return out.withColumns({f"{s}_{p}": F.coalesce(F.col(f"{s}_{p}"), F.lit(0)) for s in ZERO_FILLED for p in periods})


def forest_filled(long: DataFrame, *, id: str, measure: str, measures: Sequence[str], columns: Sequence[str], covariates: DataFrame | None = None, **forest) -> DataFrame:
    """Long rows with gaps in ``columns`` filled by chained forests over the wide form: all values of all measures, and the entities' covariates.

    ``covariates`` has a row per entity; its text columns are filled as categories, its numeric
    ones too if they have gaps, and neither is returned. ``forest``: arguments of ``impute_forest``.
    """
    others = [c for c in long.columns if c not in (id, measure, *columns)]
    at = {(c, m): f"__{i}_{j}" for i, c in enumerate([*columns, *others]) for j, m in enumerate(measures)}
    wide = long.groupBy(id).agg(*[F.max(F.when(F.col(measure) == m, F.col(c).cast("double"))).alias(n) for (c, m), n in at.items()])
    numeric, texts = [at[c, m] for c in columns for m in measures], []
    if covariates is not None:
        wide = wide.join(covariates, id, "left")
        texts = [c for c, t in covariates.dtypes if t == "string" and c != id]
        numeric += [c for c in covariates.columns if c != id and c not in texts]
    filled = impute_forest(wide, id=id, numeric=numeric, complete=[at[c, m] for c in others for m in measures], categorical=texts, **forest)
    pieces = F.array(*[F.struct(F.lit(m).alias("m"), *[F.col(at[c, m]).alias(c) for c in columns]) for m in measures])
    back = filled.select(id, F.inline(pieces)).withColumnRenamed("m", measure)
    return long.drop(*columns).join(back, [id, measure]).select(*long.columns)


def impute_summary(summary: DataFrame, *, id: str, measure: str, measures: Sequence[str], how: str, covariates: DataFrame | None = None, **forest) -> DataFrame:
    """Fill mean, max, sd, tv and recent columns: per measure over all entities (``mean``, ``median``), or by ``forest`` from all other columns and ``covariates``."""
    columns = [c for c in summary.columns if c.startswith(("mean_", "max_", "sd_", "tv_", "recent_value"))]
    if how == "forest":
        return forest_filled(summary, id=id, measure=measure, measures=measures, columns=columns, covariates=covariates, **forest)
    fills = column_fills(unpivot_long(summary, keys=[measure], columns=columns), [measure, "name"], "value", how)
    table = fills.groupBy(measure).pivot("name", columns).agg(F.first("fill"))
    table = table.select(measure, *[F.col(c).alias(f"__fill_{c}") for c in columns])
    # one row per listed measure: bounded by the list, so the broadcast is safe
    out = summary.join(F.broadcast(table), measure, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__fill_{c}")) for c in columns}).select(*summary.columns)


def widen(summary: DataFrame, *, id: str, measure: str, measures: Sequence[str]) -> DataFrame:
    """One row per entity, ``{stat}_{period}_{measure}`` columns; the sink format."""
    values = [c for c in summary.columns if c not in (id, measure)]
    return pivot_wide(summary, keys=[id], names=measure, values=values, levels=measures)


def baseline_measures(rows: DataFrame, entities: DataFrame, *, id: str, measure: str, t: str, value: str, measures: Sequence[str], how: str, dropped: Sequence[str] = (), covariates: DataFrame | None = None, **forest) -> DataFrame:
    """Mean per time with everything up to day 0 collapsed to time 0, imputed only there.

    Every entity gets a baseline row for every measure; later means are kept as observed.
    ``how``: ``mean`` or ``median`` of the measure, or ``forest`` with ``covariates``.
    """
    kept = [m for m in measures if m not in set(dropped)]
    at = F.when(F.col(t) <= 0, F.lit(0.0)).otherwise(F.col(t))
    means = rows.filter(F.col(measure).isin(kept)).groupBy(id, measure, at.alias("period")).agg(F.avg(value).alias("value"))
    observed = means.filter("period = 0").drop("period")
    # one row per entity and measure, read for the fills and for the rows
    base = stage(complete_grid(entities, id, measure, kept).join(observed, [id, measure], "left"))
    if how == "forest":
        filled = forest_filled(base, id=id, measure=measure, measures=kept, columns=["value"], covariates=covariates, **forest)
        return filled.select(id, measure, F.lit(0.0).alias("period"), "value").unionByName(means.filter("period <> 0"))
    fills = column_fills(base, [measure], "value", how)
    # one row per listed measure
    base = base.join(F.broadcast(fills), measure, "left").select(id, measure, F.lit(0.0).alias("period"), F.coalesce("value", "fill").alias("value"))
    return base.unionByName(means.filter("period <> 0"))
