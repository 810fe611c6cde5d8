"""Cutting groups must never change a result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators.ordered import hot_values, lookup, ordered_scan
from tideline.operators.quantiles import grouped_quantiles


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    p = pd.DataFrame({"g": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 40, n)), "t": rng.integers(0, 200, n).astype(float), "k": np.arange(n), "v": rng.normal(size=n).round(3)})
    p["gap"] = p.v.where(rng.random(n) < 0.3)
    return p, spark.createDataFrame(p).withColumn("gap", F.when(~F.isnan("gap"), F.col("gap")))


@pytest.mark.parametrize("hot", [[], [1], [1, 5, 9], "all"])
@pytest.mark.parametrize("descending", [False, True])
def test_scan_equals_plain_computation(frame, hot, descending):
    p, df = frame
    out = ordered_scan(
        df, ["g"], ["t", "k"], number="n", sums={"cs": "v"}, totals={"tot": ("sum", "v"), "hi": ("max", "t"), "cnt": ("count", "k")},
        lag={"lg": "v"}, lead={"ld": "v"}, fill={"ff": "gap"}, back_fill={"bf": "gap"}, hot=hot, descending=descending, buckets=25,
    ).toPandas().sort_values(["g", "n"]).reset_index(drop=True)
    q = p.sort_values(["g", "t", "k"], ascending=[True, not descending, not descending]).reset_index(drop=True)
    g = q.groupby("g")
    assert (out.k == q.k).all() and (out.n == g.cumcount() + 1).all()
    assert np.allclose(out.cs, g.v.cumsum()) and np.allclose(out.tot, g.v.transform("sum"))
    assert (out.hi == g.t.transform("max")).all() and (out.cnt == g.k.transform("count")).all()
    for col, want in {"lg": g.v.shift(1), "ld": g.v.shift(-1), "ff": g.gap.ffill(), "bf": g.gap.bfill()}.items():
        pd.testing.assert_series_equal(out[col].astype(float), want.astype(float), check_names=False)


def test_cut_groups_are_spread(frame):
    """No chunk of a cut group holds more than a small part of it."""
    _, df = frame
    out = ordered_scan(df, ["g"], ["t", "k"], number="n", hot=[1], buckets=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__c" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_values(frame):
    _, df = frame
    assert hot_values(df, "g", share=0.3, floor=10) == [1]
    assert hot_values(df, "g") == []


@pytest.mark.parametrize("hot", [[], [1], "all"])
def test_lookup_equals_join(frame, hot):
    _, df = frame
    table = df.filter("g < 30").groupBy("g").agg(F.count("*").alias("size"))
    for how in ("left", "inner"):
        got = lookup(df, table, ["g"], how, hot=hot).select("k", "size").toPandas().sort_values("k").reset_index(drop=True)
        want = df.join(table, ["g"], how).select("k", "size").toPandas().sort_values("k").reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want)


def test_quantiles_exact(frame):
    p, df = frame
    probs = {"a": 0.0, "b": 0.025, "c": 0.33, "d": 0.5, "e": 1.0}
    got = grouped_quantiles(df, ["g"], "v", probs, buckets=30).toPandas().set_index("g").sort_index()
    for name, q in probs.items():
        assert np.allclose(got[name], p.groupby("g").v.quantile(q).sort_index())
    one = grouped_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert np.isclose(one, p.v.median())
