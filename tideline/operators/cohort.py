"""Entity tables and landmark semantics.  All windows are in days from the index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_uniform
from ..functions.scalars import earliest


def assemble(spine: DataFrame, lookups: Sequence[DataFrame], id: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join one-row-per-entity tables onto the spine, then fill defaults.

    One key throughout, so the spine is partitioned once for the whole chain.
    """
    joined = reduce(lambda a, b: a.join(b, id, "left"), lookups, spine)
    return joined.fillna(defaults) if defaults else joined


def offset_from_minimum(df: DataFrame, t: str, name: str, scale: float = 1.0) -> DataFrame:
    """``(t - min(t) over all rows) / scale``; the minimum is a one-value subquery."""
    low = df.agg(F.min(t)).scalar()
    return df.withColumn(name, (F.col(t) - low) / F.lit(scale))


def with_labels(entities: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    return entities.join(labels, id, "left")


def censor_time(df: DataFrame, censors: Sequence[str], event_t: str) -> DataFrame:
    """``censor`` = earliest censoring time, ``landmark0`` = earliest of that and the event."""
    out = df.withColumn("censor", earliest(*censors))
    return out.withColumn("landmark0", earliest("censor", event_t))


def random_landmark(df: DataFrame, *, id: str, event: str, landmark0: str, accrual: float, forecast: float, seed) -> DataFrame:
    """Landmark of cases: event time plus jitter; of all others: a random time plus jitter.

    The random time lies between ``accrual + forecast`` and ``landmark0``; it is missing
    when that range is empty.  Both draws are keyed by (seed, entity).
    """
    jitter = keyed_uniform(seed, "jitter", F.col(id)) * F.lit(float(forecast))
    u = keyed_uniform(seed, "landmark", F.col(id))
    low, high = F.lit(float(accrual + forecast)), F.col(landmark0)
    drawn = F.when(high >= low, low + (high - low) * u)
    base = F.when(F.col(event), high).otherwise(drawn)
    return df.withColumn("jitter", jitter).withColumn("landmark", base + F.col("jitter"))


def switch_status(df: DataFrame, *, switch_t: str, landmark: str, forecast: float, drop_ambiguous: bool) -> DataFrame:
    """1 = switched before the forecast window, missing = inside it, 0 = later or never.

    The switch time is cleared where the status is 0.  Entities that switched inside the
    window are dropped, or kept as 0 with their switch time.
    """
    s, m = F.col(switch_t), F.col(landmark)
    status = F.when(s <= m - F.lit(float(forecast)), F.lit(1.0)).when(s <= m, F.lit(None).cast("double")).otherwise(F.lit(0.0))
    out = df.withColumn("switch", status)
    out = out.withColumn(switch_t, F.when(F.col("switch") == 0.0, F.lit(None).cast("double")).otherwise(F.col(switch_t)))
    return out.filter(F.col("switch").isNotNull()) if drop_ambiguous else out.fillna({"switch": 0.0})


def merge_outcome(entities: DataFrame, events: DataFrame, *, id: str, study_end: str, censors: Sequence[str], text: Sequence[str] = (), counts: Sequence[str] = ()) -> DataFrame:
    """Attach one event per entity, keep it only if strictly before the end of study."""
    out = entities.join(events, id, "left")
    out = out.withColumn("event_t", F.when(F.col("event_t") < F.col(study_end), F.col("event_t")))
    out = out.withColumns({c: F.when(F.col("event_t").isNull(), F.lit("None")).otherwise(F.col(c)) for c in text})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    out = out.withColumn("event", F.col("event_t").isNotNull())
    return censor_time(out, censors, "event_t").withColumnRenamed("landmark0", "landmark")


def merge_classification(entities: DataFrame, labels: DataFrame, features: DataFrame | None, *, id: str, censors: Sequence[str], accrual: float, forecast: float, drop: Sequence[str] = ()) -> DataFrame:
    """Labels onto entities, missing label = no event, keep entities observed long enough."""
    out = entities.join(labels, id, "left")
    out = out.withColumn("n_prior", F.coalesce(F.col("n_prior"), F.lit(0)))
    out = out.withColumn("event", F.coalesce(F.col("event").cast("double"), F.lit(0.0)))
    out = out.withColumn("censor", earliest(*censors)).filter(F.col("censor") > F.lit(float(accrual + forecast)))
    out = out.drop(*drop)
    return out if features is None else out.join(features, id, "left")


def attrition(stages: dict[str, DataFrame], id: str) -> DataFrame:
    """Distinct entities kept and excluded at each stage relative to the first one."""
    names = list(stages)
    marked = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(id).distinct().select(F.lit(i).alias("step"), F.lit(n).alias("stage")) for i, (n, df) in enumerate(stages.items())],
    )
    kept = marked.groupBy("step", "stage").agg(F.count("*").alias("kept"))
    base = kept.filter(F.col("stage") == names[0]).agg(F.max("kept")).scalar()
    return kept.select("stage", "kept", (base - F.col("kept")).alias("excluded"))
