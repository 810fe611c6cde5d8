"""Large values, NULL groups, missing scores, ties and many levels."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import cox, features, metrics_cls, metrics_surv, profile
from tideline.operators.ordered import lookup, ordered_scan
from tideline.plans.queries import tidy
from tideline.sources import sinks


def test_rounding_keeps_what_it_cannot_round(spark):
    values = [1e14, -1e300, math.inf, -math.inf, math.nan, 0.1234565, -2.0000004, None, 9e15 + 1]
    got = [r.v for r in tidy(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")).orderBy("i").collect()]
    assert got[:4] == values[:4] and math.isnan(got[4]) and got[5] == 0.123457 and got[6] == -2.0 and got[7] is None and got[8] == values[8]


def grouped(spark, n=200):
    rng = np.random.default_rng(4)
    rows = [(g, int(rng.integers(0, 2)), float(rng.integers(0, 20)) / 20, float(rng.integers(1, 60)), int(i)) for g in ("a", None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, y int, s double, t double, i int")


def area(rows):
    won = [1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a in rows if a[1] == 1 for b in rows if b[1] == 0]
    return sum(won) / len(won)


def test_a_null_group_is_a_group(spark):
    rows, df = grouped(spark)
    named = df.withColumn("g", F.coalesce("g", F.lit("z")))
    back = lambda d: d.withColumn("g", F.when(F.col("g") != "z", F.col("g")))
    same = lambda a, b: Counter(map(str, a.collect())) == Counter(map(str, back(b).select(*a.columns).collect()))
    runs = [
        lambda d: metrics_cls.auroc_ap(d, ["g"], "y", "s").withColumns({c: F.round(c, 9) for c in ("auroc", "average_precision")}),
        lambda d: metrics_cls.roc_curve(d, ["g"], "y", "s"),
        lambda d: metrics_cls.best_cutoff(d, ["g"], "y", "s"),
        lambda d: metrics_cls.calibration_bins(d, ["g"], "y", "s").withColumn("predicted", F.round("predicted", 9)),
        lambda d: metrics_surv.kaplan_meier(d, ["g"], "t", "y").withColumns({c: F.round(c, 9) for c in ("surv", "std_err", "lower", "upper")}),
        lambda d: metrics_surv.risk_strata(d, ["g"], "s").select("g", "i", "risk"),
        lambda d: metrics_surv.c_index(d, ["g"], time="t", event="y", risk="s").withColumn("c_index", F.round("c_index", 9)),
        lambda d: profile.density_curve(d, ["g"], "t", points=8).withColumns({c: F.round(c, 9) for c in ("x", "density")}),
    ]
    for run in runs:
        assert same(run(df), run(named))
    got = {r.g: r.auroc for r in metrics_cls.auroc_ap(df, ["g"], "y", "s").collect()}
    assert got[None] == pytest.approx(area([r for r in rows if r[0] is None]))


def test_lookup_of_null_groups(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("b", 4)], "g string, v int")
    table = spark.createDataFrame([("a", "x"), (None, "y")], "g string, w string")
    assert sorted((r.v, r.w) for r in lookup(rows, table, ["g"], hot="all").collect()) == [(1, "x"), (2, "y"), (3, "y"), (4, None)]


def test_missing_scores_rank_nowhere(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, math.nan)], "y int, s double")
    r = metrics_cls.auroc_ap(df, [], "y", "s").first()
    assert (r.auroc, r.average_precision) == (1.0, 1.0)
    assert metrics_cls.decision_curve(df, [], "y", "s", steps=4).filter("threshold = 0").first().treat_all == pytest.approx(0.5)


def test_rows_of_one_time_are_cut_too(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.when(F.col("id") < 19_000, 5.0).otherwise(F.col("id").cast("double")).alias("t"), F.col("id").alias("o"), F.lit(1).alias("one"))
    run = ordered_scan(df, ["k"], ["t", "o"], number="n", sums={"s": "one"}, lag={"p": "o"}, lead={"q": "o"}, hot=[1], buckets=16)
    assert run.filter("n <> o + 1 or s <> n or coalesce(p, -1) <> o - 1 or coalesce(q, 20000) <> o + 1").count() == 0
    down = ordered_scan(df, ["k"], ["t", "o"], number="n", hot="all", buckets=16, descending=True)
    assert down.filter("n <> 20000 - o").count() == 0
    plan = run._jdf.queryExecution().analyzed().toString()
    assert "__next" in plan


def test_levels_without_limit(spark):
    df = spark.range(6000).select("id", F.concat(F.lit("v"), F.col("id") % 5000).alias("a"), F.when(F.col("id") % 2 == 0, "b").alias("b"))
    got = features.one_hot_sparse(df, ["id"], ["a", "b"])
    order = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(5000)))}
    rows = got.collect()
    assert len(rows) == 9000 and all(r["index"] == (order[f"v{r.id % 5000}"] if r.column == "a" else 0) for r in rows)


def efron(t, e, x, beta):
    ll = 0.0
    for at in np.unique(t[e]):
        risk, tied = np.exp(x[t >= at] * beta).sum(), (t == at) & e
        own, d = np.exp(x[tied] * beta).sum(), tied.sum()
        ll += (x[tied] * beta).sum() - np.log(risk - np.arange(d) / d * own).sum()
    return ll


def test_long_ties(spark):
    rng = np.random.default_rng(2)
    n = 30_000
    x = rng.normal(size=n).round(2)
    t, e = rng.integers(1, 4, n).astype(float), rng.random(n) < 0.8
    df = spark.createDataFrame([(0.0, float(a), int(b), float(c)) for a, b, c in zip(t, e, x)], "start double, end double, event int, x double")
    model = cox.cox_fit(df, ["x"])
    best = model.beta[0]
    assert model.loglik == pytest.approx(efron(t, e, x, best), rel=1e-9)
    assert efron(t, e, x, best) >= max(efron(t, e, x, best - 1e-3), efron(t, e, x, best + 1e-3))


def test_fits_that_never_settle_end_with_an_error(spark):
    df = spark.createDataFrame([(0.0, float(i), 1, float(-i)) for i in range(1, 9)], "start double, end double, event int, x double")
    with pytest.raises((ArithmeticError, np.linalg.LinAlgError)):
        cox.cox_fit(df, ["x"], max_iter=6)


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir", None) is None or sinks.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert sinks.stage(spark.range(3)).inputFiles()[0].startswith("file:") and "tideline-stage" in sinks.stage(spark.range(3)).inputFiles()[0]


@pytest.mark.parametrize("name", ["event_flags", "measure_trend", "interval_build", "locf", "asof_at_times"])
def test_entities_that_are_cut_give_the_same(spark, sf, name):
    from harness import compare, duck
    from tideline.operators.ordered import FLOOR_KEY
    from tideline.plans import fixtures
    from tideline.plans.oracle import ORACLE
    from tideline.plans.queries import QUERIES

    spark.conf.set(FLOOR_KEY, "5")
    try:
        assert fixtures.hot_ids(spark, sf)
        ok, message, _ = compare(spark, duck(sf), name, QUERIES[name], ORACLE[name], sf)
    finally:
        spark.conf.unset(FLOOR_KEY)
    assert ok, message


def test_one_hot_refuses_levels_that_are_not_listed(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert sorted(map(tuple, features.one_hot(rows, ["c"], levels={"c": ["a", "b"]}, drop="first").collect())) == [(0.0,), (0.0,), (1.0,)]
    with pytest.raises(Exception, match="not listed: b"):
        features.one_hot(rows, ["c"], levels={"c": ["a", "z"]}, drop="first").collect()


def test_levels_are_written_in_one_pass(spark, tmp_path):
    """A level without rows gets an empty file set, other values and NULL none."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "x"), (5, None)], "id long, kind string").mapInArrow(tell, "id long, kind string")
    paths = sinks.write_by_level(rows, str(tmp_path / "levels"), "kind", ["a", "b", "c"])
    assert seen.value == 5
    back = {k: sorted(r["id"] for r in spark.read.schema("id long").parquet(p).collect()) for k, p in paths.items()}
    assert back == {"a": [1, 3], "b": [2], "c": []}
