"""Composed plans: the landmark feature table and the interval table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, events, intervals, measures
from ..sources.sinks import stage
from . import fixtures as fx

CENSORS = ("death", "study_end")


def event_log(spark: SparkSession, d: str, days: DataFrame | None = None) -> DataFrame:
    """Both logs with kind and subtype, cut at the end of study."""
    days = stage(fx.order_days(spark, d)) if days is None else days
    log = events.union_rows(fx.event_logs(spark, d, days), "kind")
    log = log.withColumn("subtype", events.subtype("indicator", "major", "minor")).drop("indicator")
    return events.within_follow_up(log, fx.study_ends(days), "id", "t", "study_end", hot=fx.hot_ids(spark, d))


def labels(spark: SparkSession, d: str, mode: str = "classification", days: DataFrame | None = None) -> DataFrame:
    return events.outcome_label(event_log(spark, d, days), id="id", t="t", mode=mode, accrual=fx.ACCRUAL, forecast=fx.FORECAST)


def labelled_entities(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Entities with their label and switch time; the orders are read and joined to their index once."""
    days = stage(fx.order_days(spark, d))
    e = cohort.with_labels(fx.spine(spark, d, days), labels(spark, d, mode, days), "id").join(fx.switch_times(spark, d, days), "id", "left")
    return cohort.censor_time(e, CENSORS, "event_t")


def landmarked(spark: SparkSession, d: str, drop_ambiguous: bool = False) -> DataFrame:
    """Entities with their label, random landmark and switch status (classification)."""
    e = cohort.random_landmark(labelled_entities(spark, d, "classification"), id="id", event="event", landmark0="landmark0", accrual=fx.ACCRUAL, forecast=fx.FORECAST, seed=fx.SEED)
    return cohort.switch_status(e, switch_t="switch_t", landmark="landmark", forecast=fx.FORECAST, drop_ambiguous=drop_ambiguous)


def summary(spark: SparkSession, d: str, mode: str = "event", entities: DataFrame | None = None) -> DataFrame:
    rows = measures.transform(fx.measures(spark, d), measure="measure", value="value", untouched=["NO"])
    entities = stage(landmarked(spark, d)) if entities is None else entities
    return measures.measure_summary(
        rows, entities, id="id", measure="measure", t="t", value="value", order=fx.MEASURE_ORDER,
        measures=fx.MEASURES, mode=mode, accrual=fx.ACCRUAL, forecast=fx.FORECAST, dropped=["RO"], hot=fx.hot_ids(spark, d),
    )


KEPT = [m for m in fx.MEASURES if m != "RO"]


def analysed(entities: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Labelled entities observed long enough, with their features."""
    base = entities.drop("n_prior", "event", "event_t", "censor", "landmark0", "jitter")
    return cohort.merge_classification(
        base, entities.select("id", "n_prior", "event"), features, id="id", censors=CENSORS, accrual=fx.ACCRUAL, forecast=fx.FORECAST, drop=["switch_t"]
    )


def feature_table(spark: SparkSession, d: str, how: str = "median", wide: bool = True) -> DataFrame:
    """One row per entity: label, landmark, switch status and imputed measure summaries.

    The entity table is staged: it is one row per entity and every step below reads it.
    """
    entities = stage(landmarked(spark, d))
    if not wide:
        return analysed(entities)
    # staged once, so the measurements are read once for the fills and for the rows
    long = stage(summary(spark, d, entities=entities))
    filled = measures.impute_summary(long, id="id", measure="measure", measures=KEPT, how=how)
    return analysed(entities, measures.widen(filled, id="id", measure="measure", measures=KEPT))


def survival_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity with switch status and the first event after the forecast cut."""
    labelled = stage(labelled_entities(spark, d, "survival"))
    e = labelled.withColumnRenamed("landmark0", "landmark")
    e = cohort.switch_status(e, switch_t="switch_t", landmark="landmark", forecast=fx.FORECAST, drop_ambiguous=False)
    e = e.drop("n_prior", "event", "event_t", "censor", "landmark")
    return cohort.merge_outcome(e, labelled.select("id", "n_prior", "event_t"), id="id", study_end="study_end", censors=CENSORS, counts=["n_prior"])


def covariates(spark: SparkSession, d: str) -> DataFrame:
    """Entity columns that help to fill measures, one of them text with gaps."""
    known = F.when(F.col("segment") != "BUILDING", F.col("segment")).alias("segment")
    return fx.spine(spark, d).join(fx.switch_times(spark, d), "id", "left").select("id", "acctbal", "study_end", "switch_t", "region", known)


def baseline(spark: SparkSession, d: str, how: str = "mean") -> DataFrame:
    rows = measures.transform(fx.measures(spark, d), measure="measure", value="value", untouched=["NO"])
    return measures.baseline_measures(
        rows, fx.spine(spark, d), id="id", measure="measure", t="t", value="value", measures=fx.MEASURES, how=how, dropped=["RO"],
        covariates=covariates(spark, d) if how == "forest" else None,
    )


def survival_intervals(spark: SparkSession, d: str, with_measures: bool = True) -> DataFrame:
    """Counting-process table with carried-forward measures."""
    e = survival_entities(spark, d)
    if not with_measures:
        return intervals.interval_build(e, id="id", forecast=fx.FORECAST)
    return intervals.interval_build(e, id="id", forecast=fx.FORECAST, measures=baseline(spark, d), measure_names=KEPT, hot=fx.hot_ids(spark, d))
