"""What travels between tasks: replicates of rows, cells of a concordance, passes of the imputing forests."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import forests, metrics_surv, models


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicates_of_rows_are_not_shuffled(spark):
    """Rows are numbered and joined once; values drawn for them come as lists."""
    df = spark.range(200).select(F.col("id").alias("row"), (F.col("id") % 50).alias("id"), (F.col("id") * 1.0).alias("a"), (F.col("id") % 50 * 1.0).alias("b"), F.lit(1).alias("c"))
    out = models.permuted_rows(df, ["a", "b"], key=["row"], id="id", seed=3, static=["b"], replicates=4)
    assert not [x for x in plan(out).split("\n") if "Exchange" in x and re.search(r"[( ]replicate#", x)]
    got = out.toPandas()
    assert len(got) == 200 + 200 * 4 * 2 and got.groupby(["variable", "replicate"]).row.nunique().eq(200).all()
    a, b = got[got.variable == "a"], got[got.variable == "b"]
    assert all(sorted(g.a) == [float(x) for x in range(200)] and (g.b == g.id).all() for _, g in a.groupby("replicate"))
    assert all((g.a == g.row).all() and g.groupby("id").b.nunique().eq(1).all() and sorted(g.b) == sorted(got[got.replicate == 0].b) for _, g in b.groupby("replicate"))
    assert a.groupby("row").a.nunique().gt(1).all()


def test_concordance_of_known_size_writes_nothing(spark, monkeypatch):
    """Packed cells go to their group's task in one shuffle; every task packs several times."""
    def refuse(df):
        raise AssertionError("cells were written")

    monkeypatch.setattr(metrics_surv, "PACK_ROWS", 50)
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"g": rng.choice(["a", "b"], 600), "t": rng.integers(0, 40, 600) * 1.0, "e": rng.integers(0, 2, 600) * 1.0, "r": np.round(rng.normal(size=600), 1), "tau": 25.0})
    monkeypatch.setattr(metrics_surv, "stage", refuse)
    got = {x["g"]: x for x in metrics_surv.c_index(spark.createDataFrame(p), ["g"], time="t", event="e", risk="r", tau="tau", largest=600).collect()}
    for g, q in p.groupby("g"):
        t, e, r = q.t.to_numpy(), q.e.to_numpy() > 0, q.r.to_numpy()
        first = (e & (t <= 25))[:, None] & ((t[None] > t[:, None]) | ((t[None] == t[:, None]) & ~e[None]))
        assert (got[g].usable, got[g].concordant, got[g].tied) == (first.sum(), (first & (r[:, None] > r[None])).sum(), (first & (r[:, None] == r[None])).sum())


@pytest.mark.parametrize("n, values", [(0, 1), (1, 1), (200, 1), (200, 7), (300, 1000)])
def test_pair_sums_match_all_pairs(n, values):
    rng = np.random.default_rng(n + values)
    place, risk, z, q = rng.integers(0, 30, n), rng.integers(0, values, n) / 7.0, rng.integers(1, 4, n) * 1.0, rng.integers(0, 3, n) * 0.5
    earlier = (place[None] < place[:, None]) * q[:, None] * z[None]
    want = [(earlier * x).sum() for x in (1, risk[:, None] > risk[None], risk[:, None] == risk[None])]
    assert np.allclose(metrics_surv.pair_sums(place, risk, z, q), want)


def mixed(n=400, seed=2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 3, n) * 1.0, "c": rng.integers(0, 4, n) * 1.0})


def grown(spark, p, target, inputs, codings, **kw):
    df = spark.createDataFrame(p)
    return forests.fit_forest(df, target, inputs, codings, key=F.xxhash64("id"), rows=len(p), **kw), df


@pytest.mark.parametrize("cells", [forests.CELLS, 64])
def test_one_tree_is_the_best_tree_of_its_rows(spark, monkeypatch, cells):
    """With every row drawn once, all inputs tried, and few values, a tree finds the groups exactly; nodes may take several passes."""
    monkeypatch.setattr(forests, "CELLS", cells)
    monkeypatch.setattr(forests, "_weights", lambda key, seed, four: np.ones((len(key), 4), np.uint8))
    p = mixed().assign(y=lambda q: 10 * q.b + (q.c == 2) * 3.0 + 100.0, k=lambda q: (q.c % 3))
    cuts = forests.numeric_cuts(spark.createDataFrame(p), ["b"])["b"]
    assert cuts.tolist() == [0.0, 1.0]
    fit, df = grown(spark, p, "y", ["b", "c"], [cuts, 4], trees=1, depth=5, centre=100.0)
    out = df.withColumn("got", forests.predicted(fit)).toPandas()
    assert np.allclose(out.got, out.y)
    fit, df = grown(spark, p, "k", ["a", "c"], [forests.numeric_cuts(df, ["a"])["a"], 4], trees=1, depth=4, classes=3)
    out = df.withColumn("got", forests.predicted(fit)).toPandas()
    assert (out.got == out.k).all() and np.allclose(fit.value.sum(axis=1), 1.0)


def test_a_first_split_is_the_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(forests, "_weights", lambda key, seed, four: np.ones((len(key), 4), np.uint8))
    p = mixed().assign(y=lambda q: np.sin(3 * q.a) + 0.2 * q.b)
    cuts = forests.numeric_cuts(spark.createDataFrame(p), ["a", "b"])
    fit, _ = grown(spark, p, "y", ["a", "b"], [cuts["a"], cuts["b"]], trees=1, depth=1)
    left = {(c, v): p[c] <= v for c in ("a", "b") for v in cuts[c]}
    error = {k: ((p.y - p.y.groupby(x).transform("mean")) ** 2).sum() for k, x in left.items() if 0 < x.sum() < len(p)}
    c, v = min(error, key=error.get)
    at = int((fit.right.reshape(-1, fit.width)[0] == 0).sum()) - 1
    assert ("a", "b")[fit.feature[0]] == c and cuts[c][at] == v
    assert np.allclose(fit.value[1:, 0], [p.y[left[c, v]].mean(), p.y[~left[c, v]].mean()])


def test_forests_do_not_depend_on_the_layout(spark):
    """Draws are keyed by row, so that rows in other tasks make the same trees; nodes differ between trees."""
    p = mixed(3000).assign(y=lambda q: q.a + q.b + np.random.default_rng(1).normal(size=3000))
    cuts = forests.numeric_cuts(spark.createDataFrame(p), ["a", "b"])
    fits = [grown(spark, q, "y", ["a", "b"], [cuts["a"], cuts["b"]], trees=9, depth=4, seed=5)[0] for q in (p, p.sample(frac=1, random_state=1))]
    assert (fits[0].feature == fits[1].feature).all() and np.allclose(fits[0].value, fits[1].value)
    assert len({tuple(fits[0].right.reshape(-1, fits[0].width)[k]) for k in range(9)}) > 1
    drawn = forests._weights(np.arange(200_000, dtype=np.int64), 5, 0)
    assert np.allclose(drawn.mean(axis=0), 1, atol=0.02) and np.allclose(drawn.var(axis=0), 1, atol=0.03) and abs(np.corrcoef(drawn.T)[0, 1]) < 0.02


def test_imputation_predicts_gaps_only(spark, monkeypatch):
    """Rows without a gap are copied; inputs that may not have gaps are refused."""
    asked, of = [], forests.predicted
    monkeypatch.setattr(forests, "predicted", lambda fit: asked.append(fit) or of(fit))
    p = mixed().assign(y=lambda q: np.where(q.id % 7 == 0, None, q.a + q.b).astype(object), s=lambda q: np.where(q.id % 9 == 0, None, np.array(["u", "v", "w", "x"])[q.c.astype(int)]))
    df = spark.createDataFrame(p[["id", "a", "b", "c"]]).join(spark.createDataFrame([(int(i), None if y is None else float(y), s) for i, y, s in zip(p.id, p.y, p.s)], "id long, y double, s string"), "id")
    plans, write = [], models.dealt
    monkeypatch.setattr(models, "dealt", lambda d, keys, tasks=None: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or write(d, keys, tasks))
    out = models.impute_forest(df, id="id", numeric=["y"], complete=["a", "b", "c"], categorical=["s"], trees=20, depth=5, sweeps=2).toPandas().sort_values("id", ignore_index=True)
    assert len(asked) == 4 and len(plans) == 5
    for text in plans[1:]:
        assert "Union" in text and re.search(r"EvalPython(?:(?!Filter).)*Filter [^\n]*__na_", text, re.S)
    known = p.y.notna()
    assert np.allclose(out.y[known].astype(float), p.y[known].astype(float)) and out.y.notna().all()
    assert (out.s[p.s.notna()] == p.s[p.s.notna()]).all() and (out.s[p.s.isna()] == np.array(["u", "v", "w", "x"])[p.c[p.s.isna()].astype(int)]).mean() > 0.9
    with pytest.raises(ValueError, match="gaps or NaN"):
        models.impute_forest(df.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), id="id", numeric=["y"], complete=["a"], sweeps=1, trees=1)
