"""Hand cases pinning behaviour at the cuts, and invariants."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import keyed, scalars
from tideline.operators import cohort, events, features, impute, intervals, measures, metrics_cls, metrics_surv, profile, reshape, results, sampling
from tideline.sources import sinks, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_outcome_cuts(spark):
    log = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.5), (2, 15.0), (3, 10.5)], "id long, t double")
    out = events.outcome_label(log, id="id", t="t", mode="classification", accrual=10.0, forecast=10.0)
    assert rows(out) == [(1, 1, 20.5, True), (2, 0, None, False), (3, 0, None, False)]
    out = events.outcome_label(log, id="id", t="t", mode="survival", forecast=15.0)
    assert rows(out) == [(1, 1, 20.0, True), (2, 1, None, False), (3, 1, None, False)]
    fixed = events.outcome_label_fixed(log, id="id", t="t", accrual=10.0, forecast=10.0)
    assert rows(fixed) == [(1, 1, True), (2, 0, True), (3, 0, True)]


def test_argument_contracts(spark):
    log = spark.createDataFrame([(1, 1.0)], "id long, t double")
    with pytest.raises(ValueError):
        events.outcome_label(log, id="id", t="t", mode="rolling", forecast=1.0)
    with pytest.raises(ValueError):
        events.outcome_label(log, id="id", t="t", mode="classification", forecast=1.0)
    with pytest.raises(ValueError):
        measures.period_label(log, t="t", mode="event")
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", fmt="csv")
    with pytest.raises(ValueError):
        scalars.bucketize([])


def test_switch_status_at_the_cuts(spark):
    df = spark.createDataFrame([(1, 80.0, 100.0), (2, 80.5, 100.0), (3, 100.0, 100.0), (4, 100.5, 100.0), (5, None, 100.0), (6, 5.0, None)], "id long, switch_t double, landmark double")
    kept = cohort.switch_status(df, switch_t="switch_t", landmark="landmark", forecast=20.0, drop_ambiguous=False)
    assert rows(kept.select("id", "switch", "switch_t")) == [(1, 1.0, 80.0), (2, 0.0, 80.5), (3, 0.0, 100.0), (4, 0.0, None), (5, 0.0, None), (6, 0.0, None)]
    dropped = cohort.switch_status(df, switch_t="switch_t", landmark="landmark", forecast=20.0, drop_ambiguous=True)
    assert rows(dropped.select("id")) == [(1,), (4,), (5,), (6,)]


def test_landmark_inverted_range_is_missing(spark):
    df = spark.createDataFrame([(1, True, 50.0), (2, False, 50.0), (3, None, 500.0)], "id long, event boolean, landmark0 double")
    out = {r["id"]: r for r in cohort.random_landmark(df, id="id", event="event", landmark0="landmark0", accrual=100.0, forecast=30.0, seed=1).collect()}
    assert 50.0 <= out[1]["landmark"] < 80.0 and out[2]["landmark"] is None and 130.0 <= out[3]["landmark"] < 530.0


def test_period_label_cuts(spark):
    df = spark.createDataFrame([(0.0, 100.0), (49.5, 100.0), (50.0, 100.0), (80.0, 100.0), (80.5, 100.0), (1.0, None)], "t double, landmark double")
    out = measures.period_label(df, t="t", mode="event", landmark="landmark", accrual=30.0, forecast=20.0)
    assert rows(out.select("t", "period")) == [(0.0, "preindex"), (49.5, "preindex"), (50.0, "accrual"), (80.0, "accrual")]
    out = measures.period_label(df, t="t", mode="index")
    assert {r["t"]: r["period"] for r in out.collect()}[0.0] == "preindex"


def test_measure_stats_single_point_and_constant_time(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 5.0, 1), (2, "a", 1.0, 5.0, 1), (2, "a", 1.0, 7.0, 2), (3, "a", 0.0, 0.0, 1), (3, "a", 1.0, 9.0, 2), (3, "a", 2.0, 2.0, 3), (3, "a", 3.0, 4.0, 4)], "id long, measure string, t double, value double, k long").withColumn("period", F.lit("p"))
    for hot in ([], [3]):
        out = {r["id"]: r for r in measures.measure_stats(df, id="id", measure="measure", t="t", value="value", order=["t", "k"], hot=hot).collect()}
        assert (out[1]["n_obs"], out[1]["sd"], out[1]["tv"], out[1]["slope"]) == (1, None, None, None)
        assert out[2]["slope"] is None and out[2]["tv"] == 2.0
        assert out[3]["tv"] == pytest.approx((9 + 7 + 2) / 3) and out[3]["recent_slope"] == pytest.approx(-2.5)


def test_event_mode_summary_uses_latest_before_the_window(spark):
    m = spark.createDataFrame([(1, "a", -300.0, 4.0), (1, "b", 70.0, 1.0), (1, "b", 95.0, 9.0)], "id long, measure string, t double, value double")
    e = spark.createDataFrame([(1, 100.0), (2, 100.0)], "id long, landmark double")
    out = measures.measure_summary(m, e, id="id", measure="measure", t="t", value="value", order=["t"], measures=["a", "b"], mode="event", accrual=30.0, forecast=20.0, hot=[])
    got = {(r["id"], r["measure"]): (r["n_obs_accrual"], r["mean_accrual"], r["slope_accrual"], r["recent_value"]) for r in out.collect()}
    assert got == {(1, "a"): (0, 4.0, 0.0, 4.0), (1, "b"): (1, 1.0, 0.0, 1.0), (2, "a"): (0, None, 0.0, None), (2, "b"): (0, None, 0.0, None)}
    filled = measures.impute_summary(out, id="id", measure="measure", measures=["a", "b"], how="median")
    assert filled.filter("mean_accrual is null").count() == 0


def test_locf_leading_gap_stays(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, 5.0), (1, 3.0, None), (2, 1.0, None)], "id long, t double, v double")
    for hot in ([], [1], "all"):
        assert rows(intervals.locf(df, by=["id"], order=["t"], columns=["v"], hot=hot), "id", "t") == [(1, 1.0, None), (1, 2.0, 5.0), (1, 3.0, 5.0), (2, 1.0, None)]


def entities(spark):
    return spark.createDataFrame(
        [(1, 0.0, None, True, 150.0, 150.0), (2, 1.0, 50.0, True, 150.0, 150.0), (3, 0.0, None, False, None, 40.0), (4, 0.0, None, False, None, 10.0)],
        "id long, switch double, switch_t double, event boolean, event_t double, landmark double",
    )


def test_treatment_intervals(spark):
    out = intervals.treatment_intervals(entities(spark), id="id", forecast=20.0)
    got = rows(out.select("id", "treatment", "start", "end", "event"), "id", "start")
    assert got == [(1, "initial", 0.0, 130.0, 1.0), (2, "initial", 0.0, 50.0, 0.0), (2, "switched", 50.0, 130.0, 1.0), (3, "initial", 0.0, 20.0, 0.0)]


def test_interval_build_invariants(spark):
    m = spark.createDataFrame([(i, "a", float(p), float(i + p)) for i in (1, 2, 3, 9) for p in (0, 7, 50, 77, 128, 500)], "id long, measure string, period double, value double")
    for hot in ([], [2]):
        out = intervals.interval_build(entities(spark), id="id", forecast=20.0, measures=m, measure_names=["a"], hot=hot)
        assert intervals.interval_check(out).first()["n_bad"] == 0
        got = {}
        for r in out.orderBy("id", "start").collect():
            got.setdefault(r["id"], []).append(r)
        assert set(got) == {1, 2, 3}
        for rs in got.values():
            assert rs[0]["start"] == 0.0 and all(a["end"] == b["start"] for a, b in zip(rs, rs[1:]))
        assert [sum(r["event"] for r in rs) for rs in got.values()] == [1.0, 1.0, 0.0]
        assert [r["treatment"] for r in got[2]] == ["initial"] * 2 + ["switched"] * 3
    with pytest.raises(ValueError):
        intervals.assert_intervals(spark.createDataFrame([(1.0, 1.0)], "start double, end double"))


def test_asof_and_stitch(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 20.0), (2, 5.0, 8.0)], "id long, start double, end double")
    for hot in ([], [1]):
        a = intervals.asof_at_times(df, id="id", start="start", end="end", times=[5.0, 10.0, 30.0], hot=hot)
        assert rows(a.select("id", "eval_t", "start", "follow_up")) == [(1, 5.0, 0.0, 20.0), (1, 10.0, 10.0, 20.0), (1, 30.0, 10.0, 20.0), (2, 5.0, 5.0, 8.0), (2, 10.0, 5.0, 8.0), (2, 30.0, 5.0, 8.0)]
        s = intervals.stitch_predictions(df, id="id", start="start", end="end", times=[5.0, 10.0, 30.0], hot=hot)
        assert s.groupBy("id", "eval_t").count().filter("count > 1").count() == 0 and s.count() == 6


def test_last_interval_keeps_ties_and_person_period_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 1.0), (1, 2.0, 10.0, 0.0), (2, 0.0, 5.0, 1.0)], "id long, start double, end double, event double")
    assert intervals.last_interval(df, id="id", end="end").count() == 3
    pp = intervals.person_period(df.filter("id = 2"), start="start", end="end", event="event", edges=[0, 5, 10])
    assert rows(pp.select("bin", "y")) == [(0, 1.0)]


def test_keyed_draws_ignore_layout(spark):
    df = spark.range(500).withColumn("u", keyed.keyed_uniform(7, "x", F.col("id")))
    a = {r["id"]: r["u"] for r in df.collect()}
    b = {r["id"]: r["u"] for r in spark.range(500).repartition(3).withColumn("u", keyed.keyed_uniform(7, "x", F.col("id"))).collect()}
    assert a == b and 0.4 < sum(a.values()) / 500 < 0.6
    w = spark.range(4000).select(keyed.keyed_poisson(1, F.col("id")).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.1 and abs(w[1] - 1) < 0.15


def test_splits_partition_entities(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    s = sampling.stratified_split(df, id="id", stratum="y", seed=1)
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got == {(0, "train"): 450, (0, "validation"): 150, (0, "test"): 150, (1, "train"): 150, (1, "validation"): 50, (1, "test"): 50}
    r = sampling.split_assign(df, id="id", seed=1, fractions={"a": 0.5, "b": 0.5})
    assert r.count() == 1000 and r.select("split").distinct().count() == 2


def test_permutation_is_one_to_one(spark):
    df = spark.range(200).withColumn("v", F.col("id") * 10)
    p = sampling.permute_column(df, key=["id"], column="v", seed=2, replicates=2)
    assert p.count() == 400 and p.groupBy("replicate").agg(F.countDistinct("permuted").alias("n")).filter("n <> 200").count() == 0
    assert p.filter("v = permuted").count() < 20


def test_metrics_with_ties_and_single_class(spark):
    df = spark.createDataFrame([("a", 1, 0.8), ("a", 0, 0.8), ("a", 1, 0.4), ("a", 0, 0.2), ("b", 1, 0.3), ("b", 1, 0.9)], "m string, y int, s double")
    got = {r["m"]: r for r in metrics_cls.auroc_ap(df, ["m"], "y", "s").collect()}
    assert got["a"]["auroc"] == pytest.approx((0.5 + 1 + 1 + 0) / 4) and got["b"]["auroc"] is None
    assert got["a"]["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3) and got["b"]["average_precision"] == pytest.approx(1.0)
    flipped = metrics_cls.auroc_ap(df.filter("m = 'a'").withColumn("s", -F.col("s")), ["m"], "y", "s").first()["auroc"]
    assert flipped == pytest.approx(1 - got["a"]["auroc"])
    f1 = metrics_cls.accuracy_f1(df.withColumn("h", F.lit(0)), ["m"], "y", "h")
    assert {r["m"]: r["f1"] for r in f1.collect()} == {"a": 0.0, "b": 0.0}


def test_roc_drops_repeated_steps(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)], "y int, s double")
    pts = [(r["fpr"], r["tpr"]) for r in metrics_cls.roc_curve(df, [], "y", "s").orderBy("position").collect()]
    assert pts == [(0.0, 0.0), (0.0, pytest.approx(1 / 3)), (0.0, 1.0), (1.0, 1.0)]
    best = metrics_cls.best_cutoff(df, [], "y", "s").first()
    assert (best["sensitivity"], best["specificity"], best["threshold"]) == (1.0, 1.0, 0.7)


def test_kaplan_meier_closing_event(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1)], "t double, e int")
    out = metrics_surv.kaplan_meier(df, [], "t", "e").orderBy("t").collect()
    assert [r["n_risk"] for r in out] == [4, 3, 2] and [r["surv"] for r in out] == [pytest.approx(0.75), pytest.approx(0.75), 0.0]
    assert out[2]["std_err"] is None and out[0]["std_err"] == pytest.approx((1 / 12) ** 0.5)


def test_interpolation(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (1, 1.0, 0.5)], "g int, t double, s double")
    for hot in ([], [1]):
        out = results.curve_interpolate(df, ["g"], "t", ["s"], 0.25, hot=hot).orderBy("t").collect()
        assert [r["s"] for r in out] == [None, None, 1.0, pytest.approx(0.75), 0.5]
    line = spark.createDataFrame([(1, float(x), 2.0 * x) for x in range(5)] + [(2, float(x), 3.0) for x in range(1, 4)], "g int, x double, y double")
    out = results.common_grid(line, ["g"], "x", "y", points=9, lower=0.0, upper=1.0, hot=[]).collect()
    assert all(r["y"] == pytest.approx(2 * r["x"] if r["g"] == 1 else 3.0) for r in out) and len(out) == 18


def test_paired_tests(spark):
    d = [0.3, 0.1, -0.2, 0.5, 0.4]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(d)], "m string, seed int, diff double")
    r = results.paired_diff_tests(df, ["m"], "diff", "seed", seed=1).first()
    assert r["signed_rank"] == 13.0 and r["wilcox_pval"] == pytest.approx(3 / 32)
    assert r["t_stat"] == pytest.approx(1.77281, abs=1e-4) and r["t_pval"] == pytest.approx(0.07547, abs=2e-4)
    assert 0.03 < r["perm_pval"] < 0.13


def test_features(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", None, 3.0), ("c", "x", 5.0)], "p string, q string, v double")
    out = features.one_hot(df, ["p", "q"], levels={"p": ["a", "b", "c"], "q": ["0", "x"]}, missing="0")
    assert out.columns == ["v", "p_a", "p_b", "p_c", "q_x"]
    z = [r["v"] for r in features.standardize(df, ["v"]).orderBy("v").collect()]
    assert z == [pytest.approx(-1.5**0.5), 0.0, pytest.approx(1.5**0.5)]
    filled = impute.impute_columns(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,), (7.0,)], "v double"), ["v"], "median")
    assert sorted(r["v"] for r in filled.collect()) == [1.0, 4.0, 4.0, 4.0, 7.0]


def test_scalars(spark):
    df = spark.createDataFrame([("n.a_lab value_x", "Group 6", -2.0), ("mean_hgb", None, 1.0)], "a string, b string, v double")
    out = df.select(scalars.pretty_label("a", rules=[("hgb", "hgb", "hemoglobin")]), scalars.digits_at_most("b", 6), scalars.log_plus_one("v")).collect()
    assert tuple(out[0]) == ("Na Lab Value X", "low", None) and out[1][0] == "Mean Hemoglobin" and out[1][1] == "high"


def test_directory_union_and_sinks(spark, tmp_path):
    for name in ("iron", "zinc"):
        (tmp_path / f"{name}.csv").write_text("id,t,value\n1,0.5,2.0\n2,1.5,3.0\n")
    df = tables.read_directory(spark, str(tmp_path), "id long, t double, value double", "measure")
    assert sorted(r["measure"] for r in df.select("measure").collect()) == ["iron", "iron", "zinc", "zinc"]
    out = str(tmp_path / "grid")
    sinks.write_partitioned(df, out, ["measure"])
    sinks.write_partitioned(df.filter("measure = 'iron' and id = 1"), out, ["measure"])
    assert {r["measure"]: r["count"] for r in spark.read.parquet(out).groupBy("measure").count().collect()} == {"iron": 1, "zinc": 2}
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert sinks.materialize(spark, build, str(tmp_path / "cache"), {"a": 1}).count() == 4
    assert len(calls) == 1


def test_profile_and_names(spark):
    df = spark.createDataFrame([("u", 1.0), ("v", 2.0), ("u", None)], "c string, x double")
    assert profile.profile_numeric(df, ["x"]).first()["n_missing"] == 1
    assert reshape.select_names(["mean_a", "max_b", "n_obs_a"], starts=["mean"], ends=["_b"]) == ["mean_a", "max_b"]
    assert profile.profile_text(df, ["c"]).first()["top_counts"] == "u: 2, v: 1"


def test_interval_build_carries_each_measure_and_skips_missing_values(spark):
    m = spark.createDataFrame(
        [(1, "a", 0.0, 1.0), (1, "b", 0.0, None), (1, "b", 7.0, 5.0), (1, "a", 7.0, None), (1, "c", 9.0, 8.0), (3, "b", 0.0, 2.0), (3, "x", 0.0, 9.0)],
        "id long, measure string, period double, value double",
    )
    for hot in ([], [1]):
        out = intervals.interval_build(entities(spark).filter("id <> 2"), id="id", forecast=20.0, measures=m, measure_names=["b", "a", "c"], hot=hot)
        assert out.columns == ["id", "start", "end", "treatment", "b", "a", "c", "landmark", "event"]
        assert rows(out.select("id", "start", "end", "b", "a", "c")) == [(1, 0.0, 7.0, None, 1.0, None), (1, 7.0, 9.0, 5.0, 1.0, None), (1, 9.0, 130.0, 5.0, 1.0, 8.0), (3, 0.0, 20.0, 2.0, None, None)]
