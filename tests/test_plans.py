"""Plan shapes that must hold at any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tideline.operators import measures, models, profile
from tideline.plans import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["keyed_uniform", "complete_grid", "measure_trend", "asof_at_times", "standardize", "roc_curve", "decision_curve", "baseline_hazard", "dedup_first"])
def test_no_pairwise_joins(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_it_needs(spark, sf):
    text = plan(fx.measures(spark, sf).select("id", "measure", "t"))
    schema = [line for line in text.split("\n") if "lineitem" in line][0].split("ReadSchema:")[1]
    assert "l_extendedprice" not in schema and "l_tax" not in schema


def test_filters_reach_the_files(spark, sf):
    text = plan(fx.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey"))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text


def test_first_per_key_is_limited_before_the_shuffle(spark, sf):
    text = plan(entry.queries()["dedup_first"](spark, sf))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_measurements_are_read_once_per_summary(spark, sf):
    rows = fx.measures(spark, sf)
    e = fx.spine(spark, sf).select("id", F.lit(900.0).alias("landmark"))
    out = measures.measure_summary(rows, e, id="id", measure="measure", t="t", value="value", order=fx.MEASURE_ORDER, measures=fx.MEASURES, mode="event", accrual=365.25, forecast=180.0, hot=[])
    assert plan(out).count("lineitem.parquet") == 1


def test_entity_chain_leaves_the_orders_alone_after_one_pass(spark, sf):
    from tideline.plans import cohorts

    assert "orders.parquet" not in plan(cohorts.labelled_entities(spark, sf, "survival"))
    assert plan(fx.order_days(spark, sf)).count("orders.parquet") <= 2


def test_assembled_entities_read_orders_from_one_written_table(spark, sf):
    text = plan(entry.queries()["entity_assemble"](spark, sf))
    assert "orders.parquet" not in text and "tideline-stage" in text


def test_permuted_rows_are_merged_not_broadcast(spark):
    """Replicates of all rows never travel through the driver, small as their files may look."""
    df = spark.range(200).select(F.col("id").alias("row"), (F.col("id") % 50).alias("id"), (F.col("id") * 1.0).alias("a"), (F.col("id") % 50 * 1.0).alias("b"))
    out = models.permuted_rows(df, ["a", "b"], key=["row"], id="id", seed=3, static=["b"], replicates=4)
    assert len(out.collect()) == 200 + 200 * 4 * 2
    joins = [line for line in plan(out).split("\n") if "Join" in line and ("__pos" in line or "[id#" in line)]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_density_of_a_single_group(spark, sf):
    out = profile.density_curve(fx.table(spark, sf, "customer"), [], "c_acctbal", points=40).orderBy("x").collect()
    area = sum((b["x"] - a["x"]) * (a["density"] + b["density"]) / 2 for a, b in zip(out, out[1:]))
    assert 0.7 < area < 1.05


def test_density_is_the_kernel_sum(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 400), rng.normal(6, 0.5, 200)])
    out = profile.density_curve(spark.createDataFrame([(float(x),) for x in v], "v double"), [], "v", points=50).orderBy("point").toPandas()
    q1, q3 = np.quantile(v, [0.25, 0.75])
    h = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
    exact = np.exp(-0.5 * ((out.x.to_numpy()[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.abs(out.density - exact).max() < 1e-4 * exact.max(), np.abs(out.density - exact).max()


def test_interval_measures_are_aggregated_once(spark, sf):
    """Measurements meet their interval starts in one aggregation, without a pivot that first holds every cell."""
    assert "pivotfirst" not in plan(entry.queries()["interval_build"](spark, sf))


@pytest.mark.parametrize("name", ["asof_at_event_times", "stitch_at_event_times", "cox_predict_event_times"])
def test_event_times_come_from_the_rows_that_meet_them(spark, sf, name, monkeypatch):
    """The intervals are built once: their event times are read from the written rows."""
    from tideline.plans import cohorts

    built, build = [], cohorts.survival_intervals
    monkeypatch.setattr(cohorts, "survival_intervals", lambda *a, **k: built.append(a) or build(*a, **k))
    assert "orders.parquet" not in plan(entry.queries()[name](spark, sf)) and len(built) == 1


def test_model_rows_use_all_tasks_and_are_scored_once(spark, sf):
    """Every pass of a fit over a small table uses the cores; two metrics read one written score."""
    from tideline.plans import queries

    t, _ = queries.model_table(spark, sf)
    assert t.filter("split = 'train'").select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism // 2
    m = models.logistic("ridge", 0.1, iterations=3).fit(t.filter("split = 'train'"))
    text = plan(queries.test_metrics(t, m, "ridge"))
    assert "UDF" not in text and "tideline-stage" in text


def test_person_periods_are_dealt_before_the_fit(spark, monkeypatch):
    """Rows that lie in one partition reach the forest in many, each with its own bin and outcome."""

    class Fit:
        def fit(self, df):
            return df

    monkeypatch.setattr(models, "forest", lambda *a, **k: Fit())
    df = spark.range(200).coalesce(1).select((F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("start"), (F.col("id") % 20 + 1.0).alias("end"), (F.col("id") % 2).cast("double").alias("event"))
    out = models.hazard_forest(df, ["x"], [0.0, 5.0, 10.0, 20.0])
    assert out.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism // 2
    assert out.count() == 200 * 3 - 50 * 2 - 50 and out.agg(F.sum("label")).first()[0] == 100.0
