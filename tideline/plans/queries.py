"""Registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed, scalars
from ..operators import cohort, cox, events, features, impute, grids, intervals, measures, metrics_cls, metrics_surv, models, profile, reshape, results, sampling
from ..operators import survival_forest as survival_forests
from ..operators.ordered import lookup
from ..sources import sinks, tables
from . import cohorts as co
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, d: tidy(fn(spark, d))
    return fn


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles at the edge: sums add up in a different order on every cluster.

    Halves go up with a margin, so the last bits of a value on a half cannot decide. NaN,
    infinities and values whose digits at that place a double cannot hold stay as they are.
    """
    unit = 10.0**digits
    held = lambda c: F.abs(F.col(c)) < 2.0**53 / unit
    near = lambda c: F.when(held(c), F.floor(F.col(c) * unit + 0.5001) / unit).otherwise(F.col(c)).alias(c)
    return df.select(*[near(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# sources and scalars ---------------------------------------------------------------


@query
def scan_project(spark, d):
    o = tables.read_table(spark, f"{d}/orders.parquet", fx.SCHEMAS["orders"])
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")).withColumn("id_number", F.col("id").cast("double"))


@query
def tagged_union(spark, d):
    logs = fx.event_logs(spark, d)
    return events.union_rows({"closed": logs["closed"], "open": logs["open"].drop("indicator")}, "kind")


@query
def directory_union(spark, d):
    """Write one file set per measure, read them back as one table with the name as a column."""
    rows = fx.measures(spark, d).select("id", "measure", "t", "value", "l_orderkey", "l_linenumber")
    files = sinks.write_by_level(rows, scratch(spark, "measures"), "measure", fx.MEASURES)
    return tables.read_measure_files(spark, files, rows.drop("measure").schema, "measure", fmt="parquet")


@query
def result_splits(spark, d):
    grid = fx.result_grid(spark, d)
    e = fx.table(spark, d, "events")
    best = e.groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 50).alias("seed"), (F.col("user_id") % 3).alias("forecast")).agg(F.max("value").alias("metric"))
    return tables.read_splits(grid, best).withColumn("method", scalars.relabel("method", {"view": "View", "click": "Click"}))


@query
def bucketize(spark, d):
    s = fx.spine(spark, d)
    o = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), "o_orderpriority", "o_totalprice")
    o = o.withColumn("priority", scalars.digits_at_most("o_orderpriority", 3))
    p = F.col("o_totalprice")
    o = o.withColumn("price_band", scalars.bucketize([(p < 100000, "small"), (p < 300000, "medium")]))
    return s.select("id", "balance").join(o, "id").select("o_orderkey", "id", "balance", "priority", "price_band").withColumn("balance_level", scalars.level_position("balance", ["debt", "low", "mid", "high"]))


@query
def flag_join(spark, d):
    o = fx.orders_by_day(spark, d)
    medium = F.col("o_orderpriority") == "3-MEDIUM"
    flags = [events.existence_flag(o, "id", "medium", medium), events.existence_flag(o, "id", "medium_done", medium & (F.col("o_orderstatus") == "F"))]
    return cohort.assemble(fx.spine(spark, d).select("id", "segment"), flags, "id", {"medium": 0.0, "medium_done": 0.0})


@query
def log_transform(spark, d):
    m = fx.measures(spark, d).withColumn("raw", F.col("value"))
    m = measures.transform(m, measure="measure", value="value", untouched=["NO", "AF"])
    return m.select("id", "measure", "t", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw", "value").withColumn("log_gap", scalars.log_plus_one(F.col("raw") - 5000.0))


@query
def time_offsets(spark, d):
    s = fx.spine(spark, d).select("id", "study_end")
    s = s.withColumn("years_to_end", scalars.years("study_end")).withColumn("months_to_end", F.col("study_end") / scalars.DAYS_PER_MONTH)
    return cohort.offset_from_minimum(s, "study_end", "years_after_first", scalars.DAYS_PER_YEAR)


@query
def relabel(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    raw = F.concat(F.lit("mean.value_accrual_"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))))
    p = p.withColumn("raw_name", raw)
    p = p.withColumn("label", scalars.pretty_label("raw_name", strip=["accrual "], exact={"meanvalue small": "Small"}, rules=[("steel", "steel", "stainless"), ("brushed$", "brushed", "matte")]))
    p = p.withColumn("brand", scalars.relabel("p_brand", {"Brand#1": "First", "Brand#2": "Second"}))
    p = p.withColumn("mode", scalars.decode_suffix("p_brand", {"0": "Nonlinear", "1": "Linear"}, "Total"))
    return p.withColumn("family", scalars.family("p_brand", {"odd": ["Brand#1", "Brand#3", "Brand#5"], "even": ["Brand#2", "Brand#4"]})).drop("p_type")


@query
def method_decode(spark, d):
    e = fx.result_grid(spark, d).withColumn("model_name", F.concat(F.lit("test_"), F.col("method"), F.lit("_labs_"), F.col("forecast").cast("string")))
    name = scalars.strip_first("model_name", "test_")
    parts = F.split(name, "_labs_")
    return e.select("model_name", "seed", "metric", parts[0].alias("method"), parts[1].cast("int").alias("varset"))


# events and entities -----------------------------------------------------------------


@query
def event_filter(spark, d):
    log = co.event_log(spark, d)
    return log.filter(F.col("kind").isin("open", "closed")).select("id", "o_orderkey", "t", "kind", "subtype", "study_end")


@query
def event_flags(spark, d):
    log = co.event_log(spark, d).select("id", "o_orderkey", "t", "kind", "subtype")
    return events.event_flags(log, id="id", t="t", tie=["o_orderkey"], kind="subtype", kinds=["major", "minor"], hot=fx.hot_ids(spark, d))


@query
def first_event(spark, d):
    log = co.event_log(spark, d).select("id", "o_orderkey", "t", "kind", "subtype")
    return events.first_events(events.event_flags(log, id="id", t="t", tie=["o_orderkey"], kind="subtype", kinds=["major", "minor"], hot=fx.hot_ids(spark, d))).select("id", "o_orderkey", "t", "kind", "n")


@query
def union_count(spark, d):
    logs = fx.event_logs(spark, d)
    low = fx.orders_by_day(spark, d).filter("o_orderpriority = '5-LOW'")
    return events.union_count([*logs.values(), low], "id", "n_events")


@query
def outcome_label(spark, d):
    return co.labels(spark, d, "classification")


@query
def outcome_label_survival(spark, d):
    return co.labels(spark, d, "survival")


@query
def outcome_label_fixed(spark, d):
    return events.outcome_label_fixed(co.event_log(spark, d), id="id", t="t", accrual=fx.ACCRUAL, forecast=fx.FORECAST)


@query
def prior_events(spark, d):
    log = co.event_log(spark, d)
    return events.prior_events(log, id="id", t="t", mode="classification", accrual=fx.ACCRUAL, forecast=fx.FORECAST)


@query
def entity_assemble(spark, d):
    # written once: only rows by entity meet in the task that joins the lookups
    o = sinks.stage(fx.order_days(spark, d))
    logs = fx.event_logs(spark, d, o)
    lookups = [
        events.union_count(list(logs.values()), "id", "n_events"),
        events.existence_flag(o, "id", "medium", F.col("o_orderpriority") == "3-MEDIUM"),
        fx.switch_times(spark, d, o),
        o.groupBy("id").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total_price")),
    ]
    e = cohort.assemble(fx.spine(spark, d, o), lookups, "id", {"n_events": 0, "medium": 0.0, "n_orders": 0})
    return e.withColumn("years_to_switch", scalars.years("switch_t")).withColumn("log_orders", scalars.log_plus_one(F.col("n_orders").cast("double")))


@query
def censor_time(spark, d):
    return co.labelled_entities(spark, d, "survival").select("id", "death", "study_end", "event_t", "censor", "landmark0")


@query
def random_landmark(spark, d):
    e = cohort.random_landmark(co.labelled_entities(spark, d, "classification"), id="id", event="event", landmark0="landmark0", accrual=fx.ACCRUAL, forecast=fx.FORECAST, seed=fx.SEED)
    return e.select("id", "event", "landmark0", "jitter", "landmark")


@query
def switch_status(spark, d):
    return co.landmarked(spark, d).select("id", "landmark", "switch_t", "switch")


@query
def switch_status_censored(spark, d):
    return co.landmarked(spark, d, drop_ambiguous=True).select("id", "landmark", "switch_t", "switch")


@query
def merge_outcome(spark, d):
    first = events.first_events(event_flags_raw(spark, d)).select("id", F.col("t").alias("event_t"), "kind", "subtype", F.col("n").alias("n_prior"))
    return cohort.merge_outcome(fx.spine(spark, d).select("id", "death", "study_end"), first, id="id", study_end="study_end", censors=co.CENSORS, text=["kind", "subtype"], counts=["n_prior"])


def event_flags_raw(spark, d):
    return events.event_flags(co.event_log(spark, d), id="id", t="t", tie=["o_orderkey"], kind="subtype", kinds=["major", "minor"], hot=fx.hot_ids(spark, d))


@query
def merge_classification(spark, d):
    return co.feature_table(spark, d, wide=False)


@query
def attrition(spark, d):
    sp = fx.spine(spark, d)
    return cohort.attrition({"all": sp, "with_event": co.event_log(spark, d), "analysed": co.feature_table(spark, d, wide=False)}, "id")


# measures ------------------------------------------------------------------------------


@query
def period_label(spark, d):
    rows = lookup(fx.measures(spark, d), sinks.stage(co.landmarked(spark, d)).select("id", "landmark"), ["id"], "inner", hot=fx.hot_ids(spark, d))
    both = []
    for mode in measures.MODES:
        p = measures.period_label(rows, t="t", mode=mode, landmark="landmark", accrual=fx.ACCRUAL, forecast=fx.FORECAST)
        both.append(p.groupBy("id", "measure", "period").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).withColumn("mode", F.lit(mode)))
    return both[0].unionByName(both[1])


@query
def latest_value(spark, d):
    return measures.latest_value(fx.measures(spark, d), keys=["id", "measure"], value="value", order=fx.MEASURE_ORDER)


@query
def measure_trend(spark, d):
    rows = measures.period_label(fx.measures(spark, d), t="t", mode="index")
    return measures.measure_stats(rows, id="id", measure="measure", t="t", value="value", order=fx.MEASURE_ORDER, hot=fx.hot_ids(spark, d))


@query
def event_measure_trend(spark, d):
    rows = fx.event_measures(spark, d).withColumn("period", F.when(F.col("t") <= fx.EVENT_ACCRUAL, "accrual").otherwise("later"))
    return measures.measure_stats(rows, id="id", measure="measure", t="t", value="value", order=["t", "event_id"], hot=fx.hot_users(spark, d))


@query
def measure_summary(spark, d):
    return co.summary(spark, d)


@query
def measure_summary_index(spark, d):
    return co.summary(spark, d, "index")


@query
def complete_grid(spark, d):
    grid = reshape.complete_grid(fx.spine(spark, d), "id", "measure", fx.MEASURES)
    n = fx.measures(spark, d).groupBy("id", "measure").agg(F.count("*").alias("n"))
    return grid.join(n, ["id", "measure"], "left")


@query
def impute_median(spark, d):
    return measures.impute_summary(sinks.stage(co.summary(spark, d)), id="id", measure="measure", measures=co.KEPT, how="median")


@query
def impute_mean(spark, d):
    return measures.impute_summary(sinks.stage(co.summary(spark, d)), id="id", measure="measure", measures=co.KEPT, how="mean")


@query
def impute_columns(spark, d):
    e = fx.spine(spark, d).join(fx.switch_times(spark, d), "id", "left").select("id", "acctbal", "death", "switch_t")
    med = impute.impute_columns(e, ["death", "switch_t"], "median").select("id", F.col("death").alias("death_median"), F.col("switch_t").alias("switch_median"))
    return impute.impute_columns(e, ["death", "switch_t"], "mean").join(med, "id")


@query
def baseline_measures(spark, d):
    return co.baseline(spark, d, "median")


@query
def baseline_measures_forest(spark, d):
    return co.baseline(spark, d, "forest")


@query
def pivot_wide(spark, d):
    return measures.widen(co.summary(spark, d).drop("tv_accrual", "sd_accrual"), id="id", measure="measure", measures=co.KEPT)


@query
def feature_table(spark, d):
    return co.feature_table(spark, d)


@query
def unpivot_long(spark, d):
    return reshape.unpivot_long(fx.spine(spark, d), keys=["id", "segment"], columns=["acctbal", "death", "study_end"])


@query
def varset_select(spark, d):
    wide = measures.widen(co.summary(spark, d), id="id", measure="measure", measures=co.KEPT)
    sets = reshape.varset_columns(wide.columns, ["id"])
    return wide.select(sets["recent_mean_max_slope"])


@query
def varset_drop(spark, d):
    wide = measures.widen(co.summary(spark, d), id="id", measure="measure", measures=co.KEPT)
    return reshape.without_names(wide, contains=["slope"])


@query
def fill_zero(spark, d):
    e = fx.spine(spark, d).join(fx.switch_times(spark, d), "id", "left")
    known = scalars.default_to(F.when(F.col("segment") != "BUILDING", F.col("segment")), "other").alias("segment")
    return impute.fill_zero(e.select("id", known, "death", "switch_t"), ["death", "switch_t"])


@query
def dedup_first(spark, d):
    return reshape.first_per_key(fx.measures(spark, d), ["id", "t", "measure"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("value")])


# intervals ---------------------------------------------------------------------------


@query
def treatment_intervals(spark, d):
    return co.survival_intervals(spark, d, with_measures=False)


@query
def interval_build(spark, d):
    return co.survival_intervals(spark, d)


@query
def interval_check(spark, d):
    return intervals.interval_check(co.survival_intervals(spark, d, with_measures=False))


@query
def locf(spark, d):
    m = fx.event_measures(spark, d)
    m = m.withColumn("click", F.when(F.col("measure") == "click", F.col("value"))).withColumn("view", F.when(F.col("measure") == "view", F.col("value")))
    return intervals.locf(m.select("id", "event_id", "t", "click", "view"), by=["id"], order=["t", "event_id"], columns=["click", "view"], hot=fx.hot_users(spark, d))


TIMES = [182.625, 365.25, 547.875, 730.5, 913.125]


@query
def asof_at_times(spark, d):
    i = co.survival_intervals(spark, d, with_measures=False)
    return intervals.asof_at_times(i, id="id", start="start", end="end", times=TIMES, hot=fx.hot_ids(spark, d))


@query
def stitch_predictions(spark, d):
    i = co.survival_intervals(spark, d, with_measures=False)
    out = intervals.stitch_predictions(i, id="id", start="start", end="end", times=TIMES, hot=fx.hot_ids(spark, d))
    return out.withColumn("surv", F.exp(-F.col("eval_t") / (2000.0 + F.col("start"))))


@query
def last_interval(spark, d):
    return intervals.last_interval(co.survival_intervals(spark, d, with_measures=False), id="id", end="end", hot=fx.hot_ids(spark, d))


@query
def collapse_static(spark, d):
    i = co.survival_intervals(spark, d, with_measures=False).join(fx.spine(spark, d).select("id", "segment", "region"), "id")
    return intervals.collapse_static(i, id="id", statics=["segment", "region"], ever={"treatment": ("switched", "switched", "initial")}, maxima=["event"])


EDGES = [0.0, 365.25, 730.5, 1095.75, 1461.0, 2500.0]


@query
def person_period(spark, d):
    i = co.survival_intervals(spark, d, with_measures=False)
    return intervals.person_period(i, start="start", end="end", event="event", edges=EDGES)


@query
def eval_times(spark, d):
    i = co.survival_intervals(spark, d, with_measures=False)
    return intervals.eval_times(i, time="end", event="event", extra=TIMES)


# sampling and features -----------------------------------------------------------------


@query
def keyed_uniform(spark, d):
    s = sampling.with_repetitions(fx.spine(spark, d).select("id"), 5)
    return s.withColumn("u", keyed.keyed_uniform(F.col("seed"), "draw", F.col("id"))).withColumn("sign", keyed.keyed_sign(F.col("seed"), "sign", F.col("id")))


SPLIT = {"train": 0.6, "validation": 0.15, "test": 0.25}


@query
def split_assign(spark, d):
    assigned = sampling.split_assign(fx.spine(spark, d).select("id"), id="id", seed=fx.SEED, fractions=SPLIT)
    rows = sampling.in_split(co.survival_intervals(spark, d, with_measures=False), assigned, "id", ["validation", "test"])
    return rows.join(assigned, "id").select("id", "start", "end", "split")


@query
def stratified_split(spark, d):
    s = sampling.stratified_split(fx.table(spark, d, "labels").select("doc_id", "quality"), id="doc_id", stratum="quality", seed=fx.SEED)
    t = sampling.stratified_split(fx.table(spark, d, "labels").select("doc_id", "quality"), id="doc_id", stratum="quality", seed=fx.SEED, mode="test")
    return s.join(t.select("doc_id", F.col("split").alias("test_mode")), "doc_id")


@query
def subsample(spark, d):
    return sampling.subsample(fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), key=["o_orderkey"], seed=fx.SEED, fraction=0.1)


@query
def permute_column(spark, d):
    return sampling.permute_column(fx.spine(spark, d).select("id", "acctbal"), key=["id"], column="acctbal", seed=fx.SEED, replicates=3)


@query
def permute_static(spark, d):
    i = co.survival_intervals(spark, d, with_measures=False).join(fx.spine(spark, d).select("id", "acctbal"), "id").select("id", "start", "end", "acctbal")
    return sampling.permute_static(i, id="id", column="acctbal", seed=fx.SEED, replicates=2, hot=fx.hot_ids(spark, d))


LEVELS = {
    "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "balance": ["debt", "high", "low", "mid"],
    "vital": ["dead", "none"],
}


@query
def one_hot(spark, d):
    s = fx.spine(spark, d).select("id", "segment", "balance", F.when(F.col("death").isNotNull(), "dead").alias("vital"))
    return features.one_hot(s, ["segment", "balance", "vital"], levels=LEVELS, missing="none")


@query
def one_hot_sparse(spark, d):
    o = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supplier"), F.max("l_shipdate").cast("string").alias("shipped"))
    return features.one_hot_sparse(o, ["l_orderkey"], ["supplier", "shipped"])


@query
def one_hot_full_rank(spark, d):
    s = fx.spine(spark, d).select("id", "balance")
    return features.one_hot(s, ["balance"], levels={"balance": ["debt", "low", "mid", "high"]}, drop="first")


@query
def standardize(spark, d):
    return features.standardize(fx.spine(spark, d).select("id", "acctbal", "study_end", F.lit(3.0).alias("constant")), ["acctbal", "study_end", "constant"])


@query
def standardize_train(spark, d):
    s = sampling.split_assign(fx.spine(spark, d).select("id", "acctbal", "study_end"), id="id", seed=fx.SEED, fractions=SPLIT)
    return features.standardize(s, ["acctbal", "study_end"], fit_on=s.filter("split = 'train'"), sample_sd=True)


@query
def attach_names(spark, d):
    e = fx.result_grid(spark, d).groupBy("method", "seed").agg(F.array(F.avg("metric"), F.min("metric"), F.max("metric")).alias("v"))
    return features.attach_names(e, "v", ["average", "lowest", "highest"])


# classifier metrics ----------------------------------------------------------------------


@query
def threshold_label(spark, d):
    return metrics_cls.threshold_label(fx.labelled_documents(spark, d), "score", cut=0.6)


@query
def accuracy_f1(spark, d):
    s = metrics_cls.threshold_label(fx.scored_rows(spark, d), "score")
    return metrics_cls.accuracy_f1(s, ["model", "seed"], "y", "label")


@query
def auroc(spark, d):
    return metrics_cls.auroc_ap(fx.scored_rows(spark, d), ["model", "seed"], "y", "score").select("model", "seed", "auroc")


@query
def average_precision(spark, d):
    both = fx.labelled_documents(spark, d).withColumn("model", F.lit("chars")).select("model", "y", "score")
    both = both.unionByName(fx.scored_rows(spark, d).select("model", "y", "score"))
    return metrics_cls.auroc_ap(both, ["model"], "y", "score")


@query
def roc_curve(spark, d):
    return metrics_cls.roc_curve(fx.scored_rows(spark, d), ["model", "seed"], "y", "score").drop("position")


@query
def roc_curve_all_points(spark, d):
    return metrics_cls.roc_curve(fx.labelled_documents(spark, d), ["lang"], "y", "score", drop_intermediate=False)


@query
def best_cutoff(spark, d):
    return metrics_cls.best_cutoff(fx.scored_rows(spark, d), ["model", "seed"], "y", "score")


@query
def calibration_bins(spark, d):
    return metrics_cls.calibration_bins(fx.scored_rows(spark, d), ["model", "seed"], "y", "score")


@query
def decision_curve(spark, d):
    return metrics_cls.decision_curve(fx.scored_rows(spark, d), ["model", "seed"], "y", "score")


@query
def bootstrap_metric(spark, d):
    return metrics_cls.bootstrap_metric(fx.labelled_documents(spark, d), [], "y", "score", key=["doc_id"], seed=fx.SEED, replicates=100)


# survival metrics --------------------------------------------------------------------------


def survival_rows(spark, d):
    """One row per entity: follow-up and event after the landmark shift, with covariates."""
    e = co.survival_entities(spark, d)
    return e.select("id", "segment", "region", "acctbal", "landmark", F.col("event").cast("int").alias("event"), "switch")


@query
def kaplan_meier(spark, d):
    return metrics_surv.kaplan_meier(survival_rows(spark, d), ["segment"], "landmark", "event")


@query
def censoring_survival(spark, d):
    return metrics_surv.censoring_survival(survival_rows(spark, d), ["segment"], "landmark", "event")


@query
def baseline_hazard(spark, d):
    i = co.survival_intervals(spark, d, with_measures=False).join(fx.spine(spark, d).select("id", "acctbal", "region"), "id")
    lp = F.col("acctbal") / 20000.0 + F.when(F.col("treatment") == "switched", 0.3).otherwise(0.0)
    return metrics_surv.baseline_hazard(i.withColumn("risk", F.exp(lp)), ["region"], start="start", end="end", event="event", risk="risk")


def risk_rows(spark, d):
    """As-of rows at the evaluation times with two risk scores, one heavily tied."""
    a = intervals.asof_at_times(co.survival_intervals(spark, d, with_measures=False), id="id", start="start", end="end", times=TIMES[:3], hot=fx.hot_ids(spark, d))
    a = a.join(fx.spine(spark, d).select("id", "acctbal"), "id")
    tied = F.floor(F.col("acctbal") / 2500.0)
    models = F.map_from_arrays(F.array(F.lit("balance"), F.lit("tied")), F.array(-F.col("acctbal"), -tied.cast("double")))
    return a.select("id", "eval_t", "follow_up", "event", F.explode(models).alias("model", "risk"))


@query
def c_index(spark, d):
    return metrics_surv.c_index(risk_rows(spark, d), ["model", "eval_t"], time="follow_up", event="event", risk="risk", tau="eval_t")


@query
def c_index_overall(spark, d):
    return metrics_surv.c_index(survival_rows(spark, d).withColumn("risk", -F.col("acctbal")), [], time="landmark", event="event", risk="risk")


@query
def c_index_ipcw(spark, d):
    c = metrics_surv.c_index(risk_rows(spark, d), ["model", "eval_t"], time="follow_up", event="event", risk="risk", weights="ipcw")
    shares = [F.try_divide(k, "usable").alias(f"{k}_share") for k in ("concordant", "tied")]
    return c.select("model", "eval_t", F.ln("usable").alias("log_usable"), *shares, "c_index")


def predicted_survival(spark, d):
    """Survival predictions stitched at the evaluation times from a fixed risk formula."""
    out = intervals.stitch_predictions(co.survival_intervals(spark, d, with_measures=False), id="id", start="start", end="end", times=TIMES, hot=fx.hot_ids(spark, d))
    out = out.join(fx.spine(spark, d).select("id", "acctbal", "segment"), "id")
    return out.withColumn("surv", F.exp(-F.col("eval_t") / 2000.0 * F.exp(F.col("acctbal") / 20000.0)))


@query
def risk_strata(spark, d):
    return metrics_surv.risk_strata(predicted_survival(spark, d), ["eval_t", "segment"], "surv").select("id", "start", "eval_t", "segment", "surv", "risk")


@query
def km_by_stratum(spark, d):
    """Predicted risk above or below the median, observed curve per stratum and time."""
    strata = metrics_surv.risk_strata(predicted_survival(spark, d), ["eval_t"], "surv").select("id", "eval_t", "risk")
    last = intervals.last_interval(co.survival_intervals(spark, d, with_measures=False), id="id", end="end", hot=fx.hot_ids(spark, d))
    rows = strata.join(last.select("id", "event", scalars.years("end").alias("years")), "id")
    return metrics_surv.kaplan_meier(rows, ["eval_t", "risk"], "years", "event")


def km_curves(spark, d):
    e = survival_rows(spark, d).withColumn("years", scalars.years("landmark"))
    return metrics_surv.kaplan_meier(e, ["region", "segment"], "years", "event")


@query
def curve_interpolate(spark, d):
    return results.curve_interpolate(km_curves(spark, d), ["region", "segment"], "t", ["surv", "std_err"], 0.01, hot="all")


@query
def km_average(spark, d):
    c = results.curve_interpolate(km_curves(spark, d), ["region", "segment"], "t", ["surv", "std_err", "lower", "upper"], 0.01, hot="all")
    return results.average_curves(c, ["segment", "step"], ["surv", "std_err", "lower", "upper"])


# results -------------------------------------------------------------------------------------


@query
def grid_rollup(spark, d):
    g = results.grid_rollup(fx.result_grid(spark, d), ["method", "forecast"], ["metric"])
    cut = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 3).alias("forecast")).agg(F.max("value").alias("cutoff"))
    g = results.join_on_tags(g, cut, ["method", "forecast"])
    return g.withColumn("label", scalars.center_spread(F.round("mean_metric", 6), F.round("sd_metric", 6)))


@query
def percentile_ci(spark, d):
    return results.percentile_ci(fx.result_grid(spark, d), ["method", "forecast"], "metric").withColumn("label", scalars.bounds_label("lower", "upper", 1))


@query
def event_rate(spark, d):
    return results.event_rate(co.feature_table(spark, d, wide=False), ["segment", "region"], "event")


@query
def importance_rank(spark, d):
    g = fx.table(spark, d, "orders").select(F.col("o_orderstatus").alias("config"), (F.col("o_custkey") % 40).cast("string").alias("variable"), F.round(F.col("o_totalprice") / 50000).alias("importance"))
    g = g.groupBy("config", "variable").agg(F.round(F.avg("importance"), 1).alias("importance"))
    return results.importance_rank(g, ["config"], "variable", "importance")


@query
def importance_top(spark, d):
    g = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("config"), F.col("l_suppkey").cast("string").alias("variable"), F.col("l_quantity").alias("importance"))
    return results.importance_rank(g, ["config"], "variable", "importance", top=10)


@query
def variable_order(spark, d):
    g = fx.table(spark, d, "part").select(F.concat_ws(": ", F.split_part("p_type", F.lit(" "), F.lit(1)), F.split_part("p_type", F.lit(" "), F.lit(2))).alias("v"), F.col("p_brand").alias("config"), "p_retailprice")
    both = g.select("config", F.col("v").alias("variable"), "p_retailprice").unionByName(g.select("config", F.split_part("v", F.lit(":"), F.lit(1)).alias("variable"), "p_retailprice"))
    r = results.importance_rank(both, ["config"], "variable", "p_retailprice")
    return results.variable_order(r, ["config"], "variable", "importance_rank").drop("importance_mean")


@query
def paired_diff_tests(spark, d):
    diff = results.paired_differences(fx.result_grid(spark, d), ["forecast"], "seed", "method", "metric", "view")
    return results.paired_diff_tests(diff, ["method", "forecast"], "diff", "seed", seed=fx.SEED, p_values=False)


@query
def paired_diff_p_values(spark, d):
    diff = results.paired_differences(fx.result_grid(spark, d), ["forecast"], "seed", "method", "metric", "view")
    return results.paired_diff_tests(diff, ["method", "forecast"], "diff", "seed", seed=fx.SEED)


def order_curves(spark, d):
    """A standardised curve per region: mean order price over account balance, back-transformed."""
    s = features.standardize(fx.spine(spark, d).select("id", "region", "acctbal"), ["acctbal"])
    p = fx.orders_by_day(spark, d).groupBy("id").agg(F.avg("o_totalprice").alias("price"))
    stats = fx.spine(spark, d).agg(F.struct(F.avg("acctbal").alias("m"), F.stddev_pop("acctbal").alias("s"))).scalar()
    c = s.join(p, "id").withColumn("grid", F.round("acctbal", 1)).groupBy("region", "grid").agg(F.avg("price").alias("average"))
    c = c.withColumn("__s", stats)
    return results.back_transform(c, "grid", F.col("__s.m"), F.col("__s.s"), "x").select("region", "x", "average")


@query
def pdp_common_grid(spark, d):
    return results.common_grid(order_curves(spark, d), ["region"], "x", "average", points=100, hot="all")


@query
def pdp_summary(spark, d):
    c = results.common_grid(order_curves(spark, d), ["region"], "x", "average", points=100, hot="all")
    band = results.percentile_ci(c, ["point"], "y")
    return c.groupBy("point").agg(F.avg("y").alias("mean")).join(band, "point")


# profiles ---------------------------------------------------------------------------------------


@query
def strata_table(spark, d):
    return profile.strata_table(co.feature_table(spark, d, wide=False), ["segment", "balance", "region"], event="event", switch="switch")


@query
def measure_coverage(spark, d):
    return profile.measure_coverage(fx.measures(spark, d), fx.spine(spark, d), id="id", measure="measure", t="t")


@query
def event_overview(spark, d):
    flagged = event_flags_raw(spark, d)
    return profile.event_shares(flagged, fx.spine(spark, d), kind="kind", values=["closed", "open"])


@query
def count_of_counts(spark, d):
    return profile.count_of_counts(co.event_log(spark, d), "id")


@query
def profile_table(spark, d):
    return profile.profile_numeric(fx.spine(spark, d).join(fx.switch_times(spark, d), "id", "left"), ["acctbal", "death", "study_end", "switch_t"])


@query
def profile_text(spark, d):
    return profile.profile_text(fx.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query
def measure_corr(spark, d):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value")]
    month = fx.measures(spark, d).withColumn("month", F.floor(F.col("t") / 90))
    return profile.measure_corr(month, keys=["id", "month"], measure="measure", value="value", order=order, measures=fx.MEASURES)


@query
def histogram(spark, d):
    first = event_flags_raw(spark, d).filter("first").withColumn("years", scalars.years("t"))
    return profile.histogram_width(first, ["kind"], "years", 0.25)


@query
def histogram_equal(spark, d):
    n = fx.measures(spark, d).groupBy("id", "measure").agg(F.count("*").alias("n_rows"))
    return profile.histogram_equal(n, ["measure"], "n_rows", 20)


@query
def density_curve(spark, d):
    return profile.density_curve(fx.measures(spark, d), ["measure"], "value")


# sinks ---------------------------------------------------------------------------------------------


def scratch(spark, name):
    import uuid

    return f"{sinks.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def partition_sink(spark, d):
    """Write the result grid by configuration, read it back in one scan."""
    path = scratch(spark, "grid")
    sinks.write_partitioned(fx.result_grid(spark, d), path, ["method", "forecast"])
    back = tables.read_grid(spark, path, ["method", "forecast"])
    return back.groupBy("method", "forecast").agg(F.count("*").alias("n"), F.avg("metric").alias("mean_metric")).withColumn("forecast", F.col("forecast").cast("long"))


@query
def bundle_sink(spark, d):
    path = scratch(spark, "bundle")
    sinks.write_bundle({"entities": fx.spine(spark, d), "intervals": co.survival_intervals(spark, d, with_measures=False)}, path)
    t = sinks.read_bundle(spark, path, ["entities", "intervals"])
    return t["entities"].join(t["intervals"].groupBy("id").agg(F.count("*").alias("n_intervals")), "id", "left").select("id", "segment", "n_intervals")


@query
def curve_sink(spark, d):
    path = scratch(spark, "curves")
    sinks.write_curves(metrics_cls.decision_curve(fx.scored_rows(spark, d), ["model"], "y", "score").withColumnRenamed("model", "feature"), path)
    return spark.read.parquet(path)


@query
def materialize(spark, d):
    root, config = scratch(spark, "cache"), {"accrual": fx.ACCRUAL, "forecast": fx.FORECAST, "rule": "keep"}
    sinks.materialize(spark, lambda: co.labels(spark, d), root, config)

    def rebuilt():
        raise AssertionError("finished output must be reused")

    return sinks.materialize(spark, rebuilt, root, config)


# models ---------------------------------------------------------------------------------------------


def model_table(spark, d):
    """Numeric modelling table: entity covariates, standardised, with the event label."""
    t = co.feature_table(spark, d, wide=False).select("id", "event", "acctbal", "study_end", "n_prior", "switch", "segment")
    t = features.one_hot(t, ["segment"], levels=LEVELS)
    t = features.standardize(t.withColumn("n_prior", F.col("n_prior").cast("double")), ["acctbal", "study_end", "n_prior"])
    t = sampling.split_assign(t, id="id", seed=fx.SEED, fractions=SPLIT)
    columns = models.model_columns(t, ["id", "event", "split"])
    return models.dealt(models.assemble(t, columns, "event"), ["id"]), columns


def fitted(spark, d, estimator):
    t, columns = model_table(spark, d)
    return t, columns, estimator.fit(t.filter("split = 'train'"))


def test_metrics(t, model, name):
    s = models.score(model, t.filter("split <> 'train'")).withColumn("model", F.lit(name))
    s = sinks.stage(metrics_cls.threshold_label(s, "score", "hard").drop("features"))  # read by two metrics: rows are scored once
    return metrics_cls.auroc_ap(s, ["model", "split"], "event", "score").join(metrics_cls.accuracy_f1(s, ["model", "split"], "event", "hard"), ["model", "split"])


@query
def formula_expand(spark, d):
    """The formula's columns by name and position, with the value each contributes."""
    t, columns = model_table(spark, d)
    return features.attach_names(t.select("id", vector_to_array("features").alias("v")), "v", columns, "value").select("id", "position", "name", "value")


@query
def forest_classifier(spark, d):
    t, _, m = fitted(spark, d, models.forest())
    return test_metrics(t, m, "forest")


@query
def boosted_classifier(spark, d):
    t, _, m = fitted(spark, d, models.boosted())
    return test_metrics(t, m, "boosted")


@query
def logistic_classifiers(spark, d):
    t, _ = model_table(spark, d)
    train = t.filter("split = 'train'")
    parts = [test_metrics(t, models.logistic(p, 0.01).fit(train), p) for p in models.PENALTIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def penalty_grids(spark, d):
    """All settings of the lasso, the ridge and the elastic net in one fit, and which settings are whose."""
    t, columns = model_table(spark, d)
    train = t.filter("split = 'train'")
    inverse, n = [10.0 ** (-3 + 6 * k / 99) for k in range(100)], train.count()
    ratios = {"lasso": [1.0], "ridge": [0.0], "elastic": [0.1, 0.25, 0.5, 0.75, 0.9]}
    settings = {name: grids.penalty_grid(n, inverse, r) for name, r in ratios.items()}
    fit = grids.fit_grid(train, columns, "event", [s for v in settings.values() for s in v], id="id", seed=fx.SEED)
    families = [name for name, v in settings.items() for _ in v]
    return t, fit, families


@query
def grid_search_cv(spark, d):
    """Test metrics of the best setting of each penalty."""
    t, fit, families = penalty_grids(spark, d)
    held, parts = t.filter("split <> 'train'"), []
    for name in dict.fromkeys(families):
        best = fit.best([i for i, f in enumerate(families) if f == name])
        s = metrics_cls.threshold_label(held.withColumn("model", F.lit(name)).withColumn("score", fit.probability(best)), "score", "hard")
        parts.append(metrics_cls.auroc_ap(s, ["model", "split"], "event", "score").join(metrics_cls.accuracy_f1(s, ["model", "split"], "event", "hard"), ["model", "split"]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def grid_search_table(spark, d):
    """Cross-validated accuracy of all 700 settings."""
    _, fit, _ = penalty_grids(spark, d)
    return fit.table(spark)


@query
def coefficient_importance(spark, d):
    _, columns, m = fitted(spark, d, models.logistic("lasso", 0.02))
    return models.coefficient_importance(spark, m, columns)


@query
def impurity_importance(spark, d):
    _, columns, m = fitted(spark, d, models.forest())
    return models.impurity_importance(spark, m, columns)


@query
def partial_dependence(spark, d):
    t, columns, m = fitted(spark, d, models.forest())
    return models.partial_dependence(m, t.filter("split = 'train'"), columns, "acctbal")


@query
def impute_forest(spark, d):
    e = fx.spine(spark, d).select("id", "death").join(co.covariates(spark, d), "id")
    return models.impute_forest(e, id="id", numeric=["death", "switch_t"], complete=["acctbal", "study_end"], categorical=["segment", "region"])


def hazard_rows(spark, d):
    """Intervals with numeric covariates, staged for the iterative fits."""
    i = intervals.assert_intervals(co.survival_intervals(spark, d, with_measures=False))
    s = features.standardize(fx.spine(spark, d).select("id", "acctbal", "segment"), ["acctbal"])
    s = s.select("id", "acctbal", F.when(F.col("segment") == "BUILDING", 1.0).otherwise(0.0).alias("building"))
    return sinks.stage(i.withColumn("switched", F.when(F.col("treatment") == "switched", 1.0).otherwise(0.0)).join(s, "id"))


COVARIATES = ["acctbal", "building", "switched"]
FIXED = cox.CoxModel(COVARIATES, np.array([0.2, -0.1, 0.3]), 0.0, np.eye(3), "breslow", 0, True)


@query
def cox_fit(spark, d):
    return cox.coefficient_table(spark, cox.cox_fit(hazard_rows(spark, d), COVARIATES))


@query
def cox_penalised(spark, d):
    m = cox.cox_penalised(hazard_rows(spark, d), COVARIATES, id="id", alpha=1.0, seed=fx.SEED)
    return spark.createDataFrame([(c, float(b), float(abs(b))) for c, b in zip(m.covariates, m.beta)], "variable string, estimate double, importance double")


@query
def cox_predict(spark, d):
    rows = hazard_rows(spark, d)
    m = cox.cox_fit(rows, COVARIATES, ties="breslow")
    return cox.cox_predict(m, rows, rows, TIMES, id="id", hot=fx.hot_ids(spark, d)).select("id", "start", "eval_t", "surv")


@query
def cox_predict_fixed(spark, d):
    """As cox_predict, from given coefficients."""
    rows = hazard_rows(spark, d)
    return cox.cox_predict(FIXED, rows, rows, TIMES, id="id", hot=fx.hot_ids(spark, d)).select("id", "start", "eval_t", "surv")


@query
def hazard_forest(spark, d):
    rows = hazard_rows(spark, d)
    m = models.hazard_forest(rows, COVARIATES, EDGES)
    return models.hazard_survival(m, rows, COVARIATES, EDGES, id="id", hot=fx.hot_ids(spark, d))


@query
def survival_forest(spark, d):
    """Log-rank forest on all event times, survival at the reported ones."""
    rows = hazard_rows(spark, d)
    m = survival_forests.fit_survival_forest(rows, COVARIATES, id="id", seed=fx.SEED)
    return survival_forests.forest_survival(m, rows, spark.createDataFrame([(t,) for t in TIMES], "eval_t double"), id="id", hot=fx.hot_ids(spark, d))


def importance(spark, d, model, rows, **kw):
    """Permutation importance at the evaluation times; rows of an entity are told apart by number."""
    rows = rows.withColumn("k", F.when(F.col("treatment") == "switched", 2).otherwise(1))
    points = cox.hazard_at(model, rows, spark.createDataFrame([(t,) for t in TIMES], "t double"))
    return models.permutation_importance(rows, COVARIATES, points, lambda df: df.withColumn("surv", cox.survival(model)), key=["id", "k"], id="id", seed=fx.SEED, static=["acctbal", "building"], hot=fx.hot_ids(spark, d), **kw)


@query
def permutation_importance(spark, d):
    rows = hazard_rows(spark, d)
    return importance(spark, d, cox.cox_fit(rows, COVARIATES, ties="breslow"), rows)


@query
def permutation_importance_fixed(spark, d):
    """As permutation_importance, from given coefficients."""
    return importance(spark, d, FIXED, hazard_rows(spark, d), replicates=3)


# all distinct event times and the fixed ones, as a table


def event_times(rows):
    return intervals.eval_times(rows, time="end", event="event", extra=TIMES)


def staged_intervals(spark, d):
    """Written once: the times and the rows that meet them are read from it."""
    return sinks.stage(co.survival_intervals(spark, d, with_measures=False))


@query
def asof_at_event_times(spark, d):
    i = staged_intervals(spark, d)
    return intervals.asof_at_times(i, id="id", start="start", end="end", times=event_times(i), hot=fx.hot_ids(spark, d)).select("id", "start", "follow_up", "eval_t")


@query
def stitch_at_event_times(spark, d):
    i = staged_intervals(spark, d)
    return intervals.stitch_predictions(i, id="id", start="start", end="end", times=event_times(i), hot=fx.hot_ids(spark, d)).select("id", "start", "eval_t")


@query
def cox_predict_event_times(spark, d):
    """As cox_predict_fixed, at every event time."""
    rows = hazard_rows(spark, d)
    return cox.cox_predict(FIXED, rows, rows, event_times(rows), id="id", hot=fx.hot_ids(spark, d)).select("id", "start", "eval_t", "surv")
