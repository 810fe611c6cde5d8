"""Counting-process intervals ``(start, end]`` with time-varying covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .ordered import bucket_of, cut_points, hot_values, lookup, ordered_scan, shuffle_partitions


def treatment_intervals(entities: DataFrame, *, id: str, forecast: float | None = None) -> DataFrame:
    """One interval per entity, two for those that switched before their landmark.

    Expects ``switch, switch_t, event, event_t, landmark``.  With ``forecast`` the landmark
    moves earlier by it (the event time does not) and entities left without follow-up are
    dropped.  ``closing_event`` is the event indicator belonging to the end of follow-up.
    """
    e = entities
    if forecast is not None:
        e = e.withColumn("landmark", F.col("landmark") - F.lit(float(forecast))).filter("landmark > 0")
    switched = F.col("switch") == 1
    event = F.col("event").cast("double")
    first_event = F.when(switched & (F.col("event_t") > F.col("switch_t")), F.lit(0.0)).otherwise(event)
    second = switched & (F.col("landmark") > F.col("switch_t"))
    first = F.struct(
        F.lit("initial").alias("treatment"),
        F.lit(0.0).alias("start"),
        F.when(switched, F.col("switch_t")).otherwise(F.col("landmark")).alias("end"),
        first_event.alias("event"),
    )
    then = F.struct(F.lit("switched").alias("treatment"), F.col("switch_t").alias("start"), F.col("landmark").alias("end"), event.alias("event"))
    # both rows come from the same entity row: exploding avoids a second pass and a union
    pieces = F.when(second, F.array(first, then)).otherwise(F.array(first))
    rows = e.select(id, "landmark", F.inline(pieces))
    return rows


def interval_build(entities: DataFrame, *, id: str, forecast: float | None = None, measures: DataFrame | None = None, measure_names: Sequence[str] = (), hot: Sequence | None = None) -> DataFrame:
    """Treatment intervals cut further at every measurement time, covariates carried forward.

    ``measures`` is long: ``(id, measure, period, value)`` with one value per cell.  Only
    measurements before the landmark of a known entity are used.  Every interval ends where
    the next one starts, the last at the entity's latest end; the event goes to the interval
    closing at the landmark and is 0 elsewhere.
    """
    base = treatment_intervals(entities, id=id, forecast=forecast)
    if measures is None:
        return base
    hot = hot_values(measures, id) if hot is None else hot
    base = stage(base)  # one or two rows per entity, read three times below
    limits = base.groupBy(id).agg(F.max("landmark").alias("landmark"))
    closing = base.filter(F.col("end") == F.col("landmark")).groupBy(id).agg(F.max("event").alias("closing_event"))
    limits = limits.join(closing, id, "left")
    usable = lookup(measures, limits.select(id, "landmark"), [id], "inner", hot=hot).filter(F.col("period") < F.col("landmark"))
    # one aggregation: a pivot of many values takes two, and holds every cell by itself before that
    cell = lambda m: F.first(F.when(F.col("measure") == m, F.col("value")), ignorenulls=True).alias(m)
    wide = usable.groupBy(id, F.col("period").alias("start")).agg(*[cell(m) for m in measure_names])
    rows = base.select(id, "start", "end", "treatment").join(wide, [id, "start"], "full")
    carried = ["treatment", *measure_names]
    scanned = ordered_scan(
        rows, [id], ["start"],
        lead={"__next": "start"},
        totals={"__last": ("max", "end")},
        fill={f"__{c}": c for c in carried},
        hot=hot,
    )
    out = scanned.select(id, "start", F.coalesce("__next", "__last").alias("end"), *[F.col(f"__{c}").alias(c) for c in carried])
    out = lookup(out, limits, [id], "left", hot=hot)
    event = F.when(F.col("end") == F.col("landmark"), F.coalesce(F.col("closing_event"), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.withColumn("event", event).drop("closing_event")


def interval_check(df: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """One-row report: intervals, and those whose end is not after their start (NULL fails)."""
    bad = F.count_if(~F.coalesce(F.col(end) > F.col(start), F.lit(False)))
    return df.agg(F.count("*").alias("n_intervals"), bad.alias("n_bad"))


def assert_intervals(df: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """Raise unless every end is after its start (runs one aggregate); returns ``df``."""
    n_bad = interval_check(df, start=start, end=end).first()["n_bad"]
    if n_bad:
        raise ValueError(f"{n_bad} intervals do not end after they start")
    return df


def locf(df: DataFrame, *, by: Sequence[str], order: Sequence[str], columns: Sequence[str], hot: Sequence | None = None) -> DataFrame:
    """Carry the last observed value forward; gaps before the first one stay missing."""
    out = ordered_scan(df, by, order, fill={f"__{c}": c for c in columns}, hot=hot)
    return out.select(*[F.col(f"__{c}").alias(c) if c in set(columns) else F.col(c) for c in df.columns])


def _times(times: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(t)) for t in sorted(set(times))])


#: Points in one bucket of ``stabbing_join``.
POINTS = 256


def stabbing_join(df: DataFrame, points: DataFrame, *, lower: str, upper: str, at: str, per_bucket: int = POINTS) -> DataFrame:
    """Each row of ``df`` with each of ``points`` in its ``[lower, upper)``; a NULL ``upper`` is open.

    Points (their time in ``at``, other columns come along) are dealt into buckets of time, each
    of which becomes one row with a sorted list. A row is repeated for the buckets that it
    reaches, meets their lists in one equi-join and filters them: rows / ``per_bucket`` as many
    rows are shuffled as come out, plus one or two per row. Buckets are salted, since all
    intervals of a landmark begin in the same one. Up to ``per_bucket`` points are one list that comes with every row. Rows without ``lower`` and points without a time meet nothing.
    """
    points = stage(points.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("double")))
    n = points.count()
    if n == 0:
        return df.filter(F.lit(False)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema])
    names = points.columns
    inside = F.filter("__points", lambda q: (q[at] >= F.col(lower)) & (F.col(upper).isNull() | (q[at] < F.col(upper))))
    as_list = F.array_sort(F.collect_list(F.struct(at, *[c for c in names if c != at]))).alias("__points")
    if n <= per_bucket:  # one list, which every row can hold: nothing to shuffle
        met = df.withColumn("__points", points.agg(as_list).scalar())
        return met.select(*df.columns, F.inline(inside)).select(*df.columns, *names)
    cuts = cut_points(points, at, max(4, -(-n // per_bucket)))
    # a time shared by very many points fills a bucket; it is dealt into lists of bounded length
    numbered = ordered_scan(points.withColumn("__cuts", cuts).withColumn("__b", bucket_of(F.col(at), F.col("__cuts"))).drop("__cuts"), ["__b"], [at], number="__i", hot="all")
    lists = numbered.groupBy("__b", F.floor((F.col("__i") - 1) / (4 * per_bucket)).alias("__part")).agg(as_list).drop("__part")
    last = points.agg(F.max(at)).scalar()
    reach = df.filter(F.col(lower).isNotNull()).withColumn("__cuts", cuts).withColumn("__last", last)
    reach = reach.filter((F.col(lower) <= F.col("__last")) & (F.col(upper).isNull() | (F.col(upper) > F.col(lower))))
    first, to = bucket_of(F.col(lower).cast("double"), F.col("__cuts")), bucket_of(F.least(F.coalesce(F.col(upper).cast("double"), F.col("__last")), F.col("__last")), F.col("__cuts"))
    pieces = reach.withColumn("__b", F.explode(F.sequence(first, to))).drop("__cuts", "__last")
    # few lists are needed in many places, many lists spread the rows by themselves
    salts = max(8, min(shuffle_partitions(df.sparkSession), 4096 * per_bucket // n))
    met = lookup(pieces, lists, ["__b"], "inner", hot="all", salts=salts)
    return met.select(*df.columns, F.inline(inside)).select(*df.columns, *names)


def in_force(df: DataFrame, *, id: str, start: str, end: str, until: str = "start", hot: Sequence | None = None) -> DataFrame:
    """Intervals with ``until_t``, the time up to which each is in force (NULL for ever).

    ``until="start"``: the entity's next start, and ``follow_up``, its last end, as well;
    ``until="end"``: the interval's own end, but for the entity's last one.
    """
    if until not in ("start", "end"):
        raise ValueError("until must be 'start' or 'end'")
    totals = {"follow_up": ("max", end)} if until == "start" else {}
    rows = ordered_scan(df, [id], [start, end], lead={"__next": start}, totals=totals, hot=hot)
    upper = F.col("__next") if until == "start" else F.when(F.col("__next").isNotNull(), F.col(end))
    return rows.withColumn("until_t", upper).drop("__next")


def at_points(df: DataFrame, points: DataFrame, *, id: str, start: str, end: str, at: str = "eval_t", until: str = "start", hot: Sequence | None = None) -> DataFrame:
    """``asof_at_times`` (``until="start"``) or ``stitch_predictions`` (``until="end"``) for a table of times.

    ``points`` has the times in ``at`` and may have more columns, which come along.
    """
    rows = in_force(df, id=id, start=start, end=end, until=until, hot=hot)
    return stabbing_join(rows, points, lower=start, upper="until_t", at=at).drop("until_t")


def _point_table(times: DataFrame) -> DataFrame:
    return times.select(F.col("t").cast("double").alias("eval_t")).distinct()


def asof_at_times(df: DataFrame, *, id: str, start: str, end: str, times: Sequence[float] | DataFrame, hot: Sequence | None = None) -> DataFrame:
    """At each time, the entity's newest interval that has started, with its follow-up end.

    A time belongs to the interval whose start is the last one not after it, i.e. to
    ``[start, next start)``; so every (entity, time) is produced once, without comparing
    intervals with each other. ``times`` is a short list or a table with a column ``t``.
    """
    if isinstance(times, DataFrame):
        return at_points(df, _point_table(times), id=id, start=start, end=end, hot=hot)
    rows = ordered_scan(df, [id], [start, end], lead={"__next": start}, totals={"follow_up": ("max", end)}, hot=hot)
    hit = F.filter(_times(times), lambda t: (t >= F.col(start)) & (F.col("__next").isNull() | (t < F.col("__next"))))
    return rows.withColumn("eval_t", F.explode(hit)).drop("__next")


def stitch_predictions(df: DataFrame, *, id: str, start: str, end: str, times: Sequence[float] | DataFrame, hot: Sequence | None = None) -> DataFrame:
    """Rows (interval, time) with the time in ``[start, end)``.

    The last interval of an entity stays in force for all later times. ``times`` is a short
    list or a table with a column ``t``.
    """
    if isinstance(times, DataFrame):
        return at_points(df, _point_table(times), id=id, start=start, end=end, until="end", hot=hot)
    rows = ordered_scan(df, [id], [start, end], lead={"__next": start}, hot=hot)
    inside = F.filter(_times(times), lambda t: (t >= F.col(start)) & (F.col("__next").isNull() | (t < F.col(end))))
    return rows.withColumn("eval_t", F.explode(inside)).drop("__next")


def last_interval(df: DataFrame, *, id: str, end: str, hot: Sequence | None = None) -> DataFrame:
    """The interval(s) with the largest end per entity; ties are kept."""
    latest = df.groupBy(id).agg(F.max(end).alias("__end"))
    return lookup(df, latest, [id], "inner", hot=hot).filter(F.col(end) == F.col("__end")).drop("__end")


def collapse_static(df: DataFrame, *, id: str, statics: Sequence[str], ever: dict[str, tuple[str, str, str]] | None = None, maxima: Sequence[str] = ()) -> DataFrame:
    """Distinct static rows per entity.

    ``ever``: new value rules ``column -> (trigger, if ever seen, otherwise)``; ``maxima``
    are taken over all intervals of the entity.
    """
    aggs = [F.when(F.bool_or(F.col(c) == hit), F.lit(hit_label)).otherwise(F.lit(miss)).alias(c) for c, (hit, hit_label, miss) in (ever or {}).items()]
    aggs += [F.max(c).alias(c) for c in maxima]
    per_entity = df.groupBy(id).agg(*aggs)
    return df.select(id, *statics).distinct().join(per_entity, id)


def person_period(df: DataFrame, *, start: str, end: str, event: str, edges: Sequence[float]) -> DataFrame:
    """One row per interval and time bin ``(lo, hi]`` at risk, event set in its own bin."""
    edges = sorted(set(float(e) for e in edges))
    if len(edges) < 2:
        raise ValueError("at least two bin edges are needed")
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    at_risk = F.filter(bins, lambda b: (F.col(start) < b["hi"]) & (F.col(end) > b["lo"]))
    rows = df.select("*", F.inline(at_risk))
    happened = (F.col(event) > 0) & (F.col(end) > F.col("lo")) & (F.col(end) <= F.col("hi"))
    return rows.withColumn("y", F.when(happened, F.lit(1.0)).otherwise(F.lit(0.0)))


def eval_times(df: DataFrame, *, time: str, event: str, extra: Sequence[float] = ()) -> DataFrame:
    """Distinct event times together with fixed ones."""
    seen = df.filter(F.col(event) > 0).select(F.col(time).cast("double").alias("t"))
    if extra:
        seen = seen.unionByName(df.sparkSession.createDataFrame([(float(x),) for x in extra], "t double"))
    return seen.filter(F.col("t").isNotNull()).distinct()
