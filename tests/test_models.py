"""Iterative operators against plain NumPy on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import blocks, cox, grids, intervals, measures, metrics_surv, models, profile


def cohort(n=160, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)).round(2)
    t = np.ceil(rng.exponential(20 * np.exp(-0.7 * x[:, 0]))).clip(1, 60)
    c = rng.integers(5, 60, n)
    p = pd.DataFrame({"id": np.arange(n), "start": 0.0, "end": np.minimum(t, c).astype(float), "event": (t <= c).astype(float), "x0": x[:, 0], "x1": x[:, 1]})
    late = p.sample(40, random_state=1).index
    p.loc[late, "start"] = (p.loc[late, "end"] - 1).clip(0, 3)
    return p


def newton(p, ties):
    x, s, e, d = p[["x0", "x1"]].to_numpy(), p.start.to_numpy(), p.end.to_numpy(), p.event.to_numpy()
    b = np.zeros(2)
    for _ in range(25):
        w = np.exp(x @ b)
        g, h = np.zeros(2), np.zeros((2, 2))
        for t in np.unique(e[d > 0]):
            r, dead = (s < t) & (e >= t), (e == t) & (d > 0)
            k = dead.sum()
            for i in range(k):
                v = w * r - (i / k * w * dead if ties == "efron" else 0)
                s0, s1 = v.sum(), v @ x
                h += (x.T * v) @ x / s0 - np.outer(s1, s1) / s0**2
                g -= s1 / s0
            g += x[dead].sum(0)
        b = b + np.linalg.solve(h, g)
    return b, h


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_matches_newton(spark, ties):
    p = cohort()
    m = cox.cox_fit(spark.createDataFrame(p), ["x0", "x1"], ties=ties)
    b, h = newton(p, ties)
    assert m.converged and np.allclose(m.beta, b, atol=1e-6) and np.allclose(m.information, h, rtol=1e-4)


def test_penalty_shrinks(spark):
    df = spark.createDataFrame(cohort())
    m = cox.cox_penalised(df, ["x0", "x1"], id="id", alpha=1.0, lambdas=[10.0, 0.001], seed=1, folds=2, max_iter=8)
    assert m.beta[0] > 0.3 and set(m.scores) == {10.0, 0.001}
    zero = cox.cox_penalised(df, ["x0", "x1"], id="id", alpha=1.0, lambdas=[10.0], seed=1, folds=2, max_iter=3)
    assert np.allclose(zero.beta, 0)


def brute(p, tau=None, w=None):
    t, e, r = p.end.to_numpy(), p.event.to_numpy() > 0, p.risk.to_numpy()
    w = np.ones(len(p)) if w is None else w
    u = c = k = 0.0
    for i in np.flatnonzero(e):
        if tau is not None and t[i] > tau:
            continue
        j = (t > t[i]) | ((t == t[i]) & ~e)
        u += w[i] * j.sum()
        c += w[i] * (r[i] > r[j]).sum()
        k += w[i] * (r[i] == r[j]).sum()
    return u, c, k


@pytest.mark.parametrize("tau", [None, 15.0])
def test_c_index_matches_all_pairs(spark, tau):
    p = cohort(300, 8).assign(risk=lambda q: q.x0.round(0))
    df = spark.createDataFrame(p).withColumn("tau", F.lit(tau).cast("double"))
    got = metrics_surv.c_index(df, [], time="end", event="event", risk="risk", tau="tau").first()
    assert (got["usable"], got["concordant"], got["tied"]) == brute(p, tau)


def test_c_index_is_symmetric_and_grouped(spark):
    p = cohort(200, 9).assign(risk=lambda q: q.x0)
    df = spark.createDataFrame(p).withColumn("m", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("risk", F.when(F.col("m") == "a", F.col("risk")).otherwise(-F.col("risk")))
    got = {r["m"]: r["c_index"] for r in metrics_surv.c_index(df, ["m"], time="end", event="event", risk="risk").collect()}
    assert got["a"] + got["b"] == pytest.approx(1.0) and got["a"] > 0.6


def test_predictions_decrease_over_time(spark):
    p = cohort().assign(start=0.0)
    df = spark.createDataFrame(p)
    m = cox.cox_fit(df, ["x0", "x1"], ties="breslow")
    out = cox.cox_predict(m, df, df, [5.0, 20.0, 50.0], id="id", hot=[]).toPandas().pivot(index="id", columns="eval_t", values="surv")
    assert (out[5.0] >= out[20.0]).all() and (out[20.0] >= out[50.0]).all() and out[5.0].le(1).all()
    risk = p.set_index("id").x0
    assert np.corrcoef(risk, out[20.0].loc[risk.index])[0, 1] < -0.5


def test_forest_imputation_beats_the_mean(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"id": np.arange(300), "a": rng.normal(size=300)})
    truth = 3 * p.a + rng.normal(size=300) * 0.1
    df = spark.createDataFrame(p.assign(b=truth)).withColumn("b", F.when(F.col("id") % 5 > 0, F.col("b")))
    out = models.impute_forest(df, id="id", numeric=["b"], complete=["a"], sweeps=2, trees=10, depth=6).toPandas().sort_values("id")
    missing = (out.id % 5 == 0).to_numpy()
    assert out.b.notna().all() and np.abs(out.b.to_numpy() - truth)[missing].mean() < 0.5 * np.abs(truth - truth.mean())[missing].mean()
    assert np.allclose(out.b.to_numpy()[~missing], truth[~missing])


def test_dependence_and_importance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    p = pd.DataFrame({"id": np.arange(400), "a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] > 0).astype(float)})
    df = models.assemble(spark.createDataFrame(p), ["a", "b"], "y")
    m = models.forest(trees=10, depth=3).fit(df)
    imp = {r["name"]: r["importance"] for r in models.impurity_importance(spark, m, ["a", "b"]).collect()}
    assert imp["a"] > imp["b"]
    pd_a = [r["average"] for r in models.partial_dependence(m, df, ["a", "b"], "a", points=5).orderBy("point").collect()]
    assert pd_a[0] < 0.2 and pd_a[-1] > 0.8


@pytest.mark.parametrize("cells, chunks", [(50_000, 512), (20, 512), (40, 3)])
def test_c_index_by_chunks(spark, monkeypatch, cells, chunks):
    """Groups, one of them NULL, a time and a risk that hold a third of the rows each, weights, and NaN."""
    monkeypatch.setattr(metrics_surv, "CHUNK_CELLS", cells)
    monkeypatch.setattr(metrics_surv, "CHUNKS", chunks)
    rng = np.random.default_rng(2)
    p = pd.concat([cohort(250, k).assign(g=g) for k, g in enumerate(["a", "b", None])])
    p["risk"] = np.where(rng.random(len(p)) < 0.35, 0.5, p.x0)
    late = rng.random(len(p)) < 0.35
    p.loc[late, "end"], p.loc[late & (rng.random(len(p)) < 0.7), "event"] = 25.0, 0.0
    rows = spark.createDataFrame(p).unionByName(spark.createDataFrame(p.head(3).assign(risk=float("nan"))))
    got = {r["g"]: r for r in metrics_surv.c_index(rows, ["g"], time="end", event="event", risk="risk").collect()}
    for g, q in p.groupby("g", dropna=False):
        g = None if g != g else g
        assert (got[g]["usable"], got[g]["concordant"], got[g]["tied"]) == brute(q)
    assert len(got) == 3
    assert metrics_surv.c_index(rows.filter("g = 'z'"), ["g"], time="end", event="event", risk="risk").count() == 0


def wide_cohort(n=300, p=12, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).round(3)
    t = np.ceil(rng.exponential(30 * np.exp(-x[:, 0] + 0.5 * x[:, 1]))).clip(1, 40)
    c = np.where(rng.random(n) < 0.4, 25, rng.integers(3, 40, n))
    end = np.minimum(t, c).astype(float)
    d = {"id": np.arange(n), "start": np.where(rng.random(n) < 0.3, np.floor(end / 2), 0.0), "end": end, "event": (t <= c).astype(float)}
    return pd.DataFrame(d | {f"x{i}": x[:, i] for i in range(p)}), [f"x{i}" for i in range(p)]


def plain_derivatives(p, names, b, ties):
    x, s, e, d = p[names].to_numpy(), p.start.to_numpy(), p.end.to_numpy(), p.event.to_numpy()
    w, ll, g, h = np.exp(x @ b), 0.0, np.zeros(len(b)), np.zeros((len(b), len(b)))
    for t in np.unique(e[d > 0]):
        r, dead = (s < t) & (e >= t), (e == t) & (d > 0)
        for i in range(dead.sum()):
            v = w * r - (i / dead.sum() * w * dead if ties == "efron" else 0)
            s0, s1 = v.sum(), v @ x
            ll -= np.log(s0)
            g -= s1 / s0
            h += (x.T * v) @ x / s0 - np.outer(s1, s1) / s0**2
        ll, g = ll + (x[dead] @ b).sum(), g + x[dead].sum(0)
    return ll, g, h


@pytest.mark.parametrize("ties", ["efron", "breslow"])
@pytest.mark.parametrize("chunk_bytes", [8 << 20, 3000])
def test_packed_derivatives(spark, ties, chunk_bytes):
    """One chunk, and many with a time that fills several; models with and without a fold left out."""
    p, names = wide_cohort()
    df = spark.createDataFrame(p).withColumn("fold", (F.col("id") % 3).cast("int"))
    packed = cox.Packed(df.select("start", "end", "event", *names, "fold"), names, chunk_bytes)
    assert (len(packed.slots) > 5 and any(v is not None for v in packed.slots.values())) == (chunk_bytes < 10_000)
    b = np.linspace(-0.5, 0.5, len(names))
    got = cox.derivatives(packed, {0: (b, -1), 1: (b * 0, 1), 2: (b, 2)}, ties)
    for m, (beta, out) in {0: (b, -1), 1: (b * 0, 1), 2: (b, 2)}.items():
        ll, g, h = plain_derivatives(p[p.id % 3 != out], names, beta, ties)
        # the block is centred, which moves the likelihood of no model
        assert np.isclose(got[m][0], ll, rtol=1e-10) and np.allclose(got[m][1], g, atol=1e-9 * np.abs(g).max()) and np.allclose(got[m][2], h, atol=1e-9 * np.abs(h).max())
    some = cox.derivatives(packed, {0: (b, -1)}, ties, np.array([1, 4]))[0]
    assert np.allclose(some[2], got[0][2][np.ix_([1, 4], [1, 4])]) and np.allclose(some[1], got[0][1])


def test_a_hundred_covariates(spark):
    p, names = wide_cohort(1500, 100, 6)
    m = cox.cox_fit(spark.createDataFrame(p), names)
    _, g, h = plain_derivatives(p, names, m.beta, "efron")
    assert np.abs(np.linalg.solve(h, g)).max() < 1e-6 * np.abs(m.beta).max()
    b = m.beta + np.linalg.solve(h, g)
    again = plain_derivatives(p, names, b, "efron")
    assert np.allclose(m.beta, b + np.linalg.solve(again[2], again[1]), rtol=0, atol=1e-9)


def test_models_of_equal_coefficients_are_derived_once(spark, monkeypatch):
    p, names = wide_cohort(300, 3, 4)
    df = spark.createDataFrame(p).withColumn("fold", (F.col("id") % 3).cast("int"))
    packed = cox.Packed(df.select("start", "end", "event", *names, "fold"), names, 3000)
    asked, make = [], cox._Breslow
    monkeypatch.setattr(cox, "_Breslow", lambda models, *a: asked.append(len(models)) or make(models, *a))
    monkeypatch.setattr(cox, "CELLS", 100)  # models take turns inside a task
    b = np.linspace(-0.5, 0.5, len(names))
    got = cox.derivatives(packed, {i: (b, i % 2) for i in range(6)}, "breslow")
    assert asked == [2] and all(got[i][0] == got[i % 2][0] for i in range(6))
    ll, g, h = plain_derivatives(p[p.id % 3 != 1], names, b, "breslow")
    assert np.isclose(got[5][0], ll, rtol=1e-10) and np.allclose(got[5][1], g) and np.allclose(got[5][2], h)


def test_penalised_path(spark):
    p, names = wide_cohort(400, 12, 9)
    m = cox.cox_penalised(spark.createDataFrame(p), names, id="id", alpha=0.9, seed=3, n_lambdas=12, ratio=0.01, folds=3, together=5)
    lams = sorted(m.path, reverse=True)
    assert len(lams) == 12 and np.isclose(lams[-1], lams[0] / 100) and set(m.scores) == set(lams)
    assert np.all(m.path[lams[0]] == 0) and np.any(m.path[lams[1]] != 0)
    z = p.assign(**{c: (p[c] - p[c].mean()) / p[c].std() for c in names})
    for lam in lams:
        b = m.path[lam] * p[names].std().to_numpy()
        _, g, _ = plain_derivatives(z, names, b, "breslow")
        g = g / len(p)
        on = b != 0
        assert np.allclose(g[on], lam * (0.9 * np.sign(b[on]) + 0.1 * b[on]), atol=1e-5)
        assert np.all(np.abs(g[~on]) <= lam * 0.9 * (1 + 1e-6))
    assert m.scores[max(m.scores, key=m.scores.get)] > 0.6


@pytest.mark.parametrize("per_bucket", [256, 2])
def test_points_in_intervals(spark, per_bucket):
    """Open ends, empty and reversed intervals, NULLs, a start that a third share, repeated points with columns of their own."""
    rng = np.random.default_rng(per_bucket)
    lo = np.where(rng.random(300) < 0.35, 0.0, rng.integers(0, 90, 300)).astype(float)
    hi = lo + rng.integers(-2, 40, 300)
    rows = [(i, float(a), None if i % 11 == 0 else float(b)) for i, (a, b) in enumerate(zip(lo, hi))] + [(900, None, 5.0), (901, 200.0, None)]
    points = [(float(t), f"p{k}") for k, t in enumerate(rng.integers(-5, 99, 120))] + [(7.0, "x")] * 30 + [(None, "none")]
    got = intervals.stabbing_join(spark.createDataFrame(rows, "id int, lo double, hi double"), spark.createDataFrame(points, "at double, name string"), lower="lo", upper="hi", at="at", per_bucket=per_bucket)
    assert got.columns == ["id", "lo", "hi", "at", "name"]
    want = sorted((i, t, n) for i, a, b in rows if a is not None for t, n in points if t is not None and a <= t and (b is None or t < b))
    assert sorted((r["id"], r["at"], r["name"]) for r in got.collect()) == want
    none = intervals.stabbing_join(spark.createDataFrame(rows, "id int, lo double, hi double"), spark.createDataFrame([], "at double, name string"), lower="lo", upper="hi", at="at")
    assert none.columns == got.columns and none.count() == 0


def test_permutation_importance_by_time(spark):
    """A variable without weight has none; a time before any event is left out."""
    p = cohort(300, 3).assign(start=0.0)
    df = spark.createDataFrame(p)
    model = cox.CoxModel(["x0", "x1"], np.array([0.9, 0.0]), 0.0, np.eye(2), "breslow", 0, True)
    points = cox.hazard_at(model, df, spark.createDataFrame([(0.0,), (10.0,), (20.0,)], "t double"))
    predict = lambda d: d.withColumn("surv", cox.survival(model))
    kw = dict(key=["id"], id="id", seed=4, static=["x1"], replicates=4)
    by_time = {(r["variable"], r["eval_t"]): r for r in models.permutation_by_time(df, ["x0", "x1"], points, predict, **kw).collect()}
    assert sorted(t for v, t in by_time if v == "x0") == [10.0, 20.0]
    q = p.assign(risk=p.x0)
    for t in (10.0, 20.0):
        u, c, k = brute(q, t)
        assert np.isclose(by_time["x0", t]["original"], (c + k / 2) / u)
        assert by_time["x1", t]["permuted"] == by_time["x1", t]["original"]
        assert abs(by_time["x0", t]["permuted"] - 0.5) < 0.1
    got = {r["variable"]: (r["importance"], r["n_times"]) for r in models.permutation_importance(df, ["x0", "x1"], points, predict, **kw).collect()}
    assert got["x1"] == (0.0, 2) and got["x0"][0] > 0.1


def labelled(n=500, p=6, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.7 * x[:, 1] + 0.3)))).astype(float)
    names = [f"x{i}" for i in range(p)]
    return pd.DataFrame(x, columns=names).assign(id=np.arange(n), y=y), names


@pytest.mark.parametrize("slice_", [1 << 16, 64])
def test_penalty_grid(spark, monkeypatch, slice_):
    """500 settings with 5 folds in one fit: each meets its optimality conditions, some equal separate fits, scores equal plain ones."""
    monkeypatch.setattr(blocks, "SLICE", slice_)
    monkeypatch.setattr(grids, "PAYLOAD", 40_000 if slice_ == 64 else grids.PAYLOAD)
    p, names = labelled()
    settings = grids.penalty_grid(len(p), np.logspace(-2, 2, 100 if slice_ > 64 else 3), [0.0, 0.25, 0.5, 0.75, 1.0])
    df = spark.createDataFrame(p)
    fit = grids.fit_grid(df, names, "y", settings, id="id", seed=3)
    assert fit.table(spark).count() == len(settings) == len(fit.scores) and fit.scores.shape[1] == 5
    x, y = p[names].to_numpy(), p.y.to_numpy()
    for (s, a), b in zip(settings, fit.coefficients):
        g = x.T @ (y - 1 / (1 + np.exp(-(b[0] + x @ b[1:])))) / len(p)
        on = b[1:] != 0
        assert np.allclose(g[on], s * (a * np.sign(b[1:][on]) + (1 - a) * b[1:][on]), atol=1e-6) and np.all(np.abs(g[~on]) <= s * a + 1e-6)
    from tideline.functions.keyed import keyed_uniform

    fold = np.array([r["f"] for r in df.select("id", F.floor(keyed_uniform(3, "fold", F.col("id")) * 5).alias("f")).orderBy("id").collect()])
    at = len(settings) // 2
    alone = [models.logistic("elastic", settings[at][0], settings[at][1]).fit(models.assemble(spark.createDataFrame(p[fold != k]), names, "y")) for k in range(5)]
    plain = [np.mean((p[fold == k][names].to_numpy() @ m.coefficients.toArray() + m.intercept > 0) == (p[fold == k].y == 1)) for k, m in enumerate(alone)]
    assert np.allclose(fit.scores[at], plain, atol=0.011)
    assert fit.best() == int(np.argmax(fit.means))
    s = df.withColumn("s", fit.probability(at)).toPandas()
    assert np.allclose(s.s, 1 / (1 + np.exp(-(fit.coefficients[at][0] + s[names].to_numpy() @ fit.coefficients[at][1:]))))


def test_folds_start_from_the_fit_on_all_rows(spark, monkeypatch):
    p, names = labelled(300, 6)
    df, settings, asked, passed = spark.createDataFrame(p), [(0.02, 1.0), (0.02, 0.0), (0.1, 0.5)], [], grids._passed
    monkeypatch.setattr(grids, "_passed", lambda rows, of, size, q, step: asked.append(size // (1 + (q + 1) * (q + 4) // 2)) or passed(rows, of, size, q, step))
    fit = grids.fit_grid(df, names, "y", settings, id="id", seed=3, folds=3)
    # all settings are equal at the start; folds come in once the fits on all rows have ended
    assert asked[0] == 1 and max(asked[: asked.index(9)]) <= 3 and len(asked) == fit.steps + 1


def test_grid_metrics_and_limits(spark):
    p, names = labelled(200, 2)
    df = spark.createDataFrame(p).unionByName(spark.createDataFrame(p.head(2).assign(x0=float("nan"), id=-1)))
    scores = {m: grids.fit_grid(df, names, "y", [(0.01, 0.5)], id="id", seed=1, folds=3, metric=m).means[0] for m in grids.METRICS}
    assert scores["log_loss"] < 0 < scores["accuracy"] < 1 and 0.5 < scores["areaUnderROC"] < 1 and 0 < scores["f1"] < 1 and 0 < scores["areaUnderPR"] < 1
    with pytest.raises(ArithmeticError):
        grids.fit_grid(spark.createDataFrame(p.assign(x0=p.y * 2 - 1)), names, "y", [(0.0, 1.0)], id="id", seed=1, folds=3, max_iter=15)
    with pytest.raises(ValueError):
        grids.fit_grid(df.limit(0), names, "y", [(0.1, 1.0)], id="id", seed=1)


def test_dependence_from_leaf_counts(spark):
    """Equal to setting the feature in every row, at each point of the grid."""
    p, names = labelled(1000, 4, 5)
    p["x0"] = p.x0.round(1)
    df = models.assemble(spark.createDataFrame(p).repartition(3), names, "y")
    m = models.forest(trees=12, depth=6).fit(df)
    got = models.partial_dependence(m, df, names, "x0", points=15).orderBy("point").collect()
    for r in got:
        fixed = models.assemble(df.drop("features").withColumn("x0", F.lit(r["grid_value"])), names)
        assert np.isclose(models.score(m, fixed).agg(F.avg("score")).first()[0], r["average"], atol=1e-12)
    assert len(got) == 15 and got[0]["grid_value"] == p.x0.min() and got[-1]["grid_value"] == p.x0.max()


def test_correlation_of_many_measures(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 300)) @ (np.eye(300) + 0.1 * rng.normal(size=(300, 300))) + 1000
    x[:, 5] = 3.0
    mask = rng.random(x.shape) < 0.6
    names = [f"m{i}" for i in range(300)]
    rows = spark.createDataFrame(pd.DataFrame({"id": np.nonzero(mask)[0], "m": [names[j] for j in np.nonzero(mask)[1]], "v": x[mask]}))
    got = profile.measure_corr(rows, keys=["id"], measure="m", value="v", order=[F.col("v")], measures=names).toPandas()
    want = pd.DataFrame(np.where(mask, x, np.nan)).corr().to_numpy()
    meet = mask.T.astype(int) @ mask.astype(int)
    a, b = (got[c].str[1:].astype(int).to_numpy() for c in ("a", "b"))
    assert len(got) == 300 * 299 / 2 and (got.n.to_numpy() == meet[a, b]).all()
    fixed = (a == 5) | (b == 5)
    assert got.r[fixed].isna().all() and np.allclose(got.r[~fixed], want[a, b][~fixed], atol=1e-9)


def test_an_outlier_leaves_the_density_of_the_bulk(spark):
    rng = np.random.default_rng(1)
    v = np.append(rng.normal(0, 1, 3000), 1e9)
    out = profile.density_curve(spark.createDataFrame([(float(x),) for x in np.append(v, np.nan)], "v double"), [], "v", points=4).orderBy("point").collect()
    h = 0.9 * np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.34 * len(v) ** -0.2
    exact = [np.exp(-0.5 * ((r["x"] - v) / h) ** 2).sum() / len(v) / h / np.sqrt(2 * np.pi) for r in out]
    assert np.allclose([r["density"] for r in out], exact, rtol=1e-4, atol=0) and out[1]["density"] == 0
    bulk = profile.density_curve(spark.createDataFrame([(float(x),) for x in v[:-1]], "v double"), [], "v", points=200).toPandas()
    h = 0.9 * min(v[:-1].std(ddof=1), np.subtract(*np.quantile(v[:-1], [0.75, 0.25])) / 1.34) * 3000**-0.2
    exact = np.exp(-0.5 * ((bulk.x.to_numpy()[:, None] - v[None, :-1]) / h) ** 2).sum(axis=1) / 3000 / h / np.sqrt(2 * np.pi)
    assert np.allclose(bulk.density, exact, atol=1e-4 * exact.max())


def test_forest_fills_numbers_and_texts(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=600)
    kind = np.where(a > 0.3, "high", np.where(a < -0.5, "low", "mid"))
    p = pd.DataFrame({"id": np.arange(600), "a": a, "b": 2 * a + 0.1 * rng.normal(size=600), "kind": kind, "none": None})
    gap_b, gap_k = rng.random(600) < 0.2, rng.random(600) < 0.2
    df = spark.createDataFrame(p.astype({"none": "string"})[["id", "a", "b", "kind"]]).withColumn("none", F.lit(None).cast("double"))
    df = df.join(spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "gb": gap_b, "gk": gap_k})), "id")
    df = df.select("id", "a", F.when(~F.col("gb"), F.col("b")).alias("b"), F.when(~F.col("gk"), F.col("kind")).alias("kind"), "none")
    out = models.impute_forest(df, id="id", numeric=["b", "none"], complete=["a"], categorical=["kind"], trees=15, depth=5, sweeps=3).toPandas().sort_values("id", ignore_index=True)
    assert out.columns.tolist() == ["id", "a", "b", "none", "kind"] and out.none.isna().all()
    assert np.allclose(out.b[~gap_b], p.b[~gap_b]) and (out.kind[~gap_k] == p.kind[~gap_k]).all()
    assert (out.kind[gap_k] == p.kind[gap_k]).mean() > 0.85 and np.abs(out.b - p.b)[gap_b].mean() < 0.5
    assert models.impute_forest(df.limit(0), id="id", numeric=["b"], complete=["a"], categorical=["kind"]).count() == 0


def test_forest_imputation_uses_all_tasks_and_reads_files(spark, monkeypatch):
    """Rows of one task are dealt over all; every column's fit starts from a written table."""
    written, write = [], models.stage

    def staged(df):
        written.append(df.rdd.getNumPartitions())
        return write(df)

    monkeypatch.setattr(models, "stage", staged)
    df = spark.createDataFrame([(i, float(i), None if i % 5 == 0 else 2.0 * i, None if i % 7 == 0 else 3.0 * i) for i in range(200)], "id long, a double, b double, c double").coalesce(1)
    out = models.impute_forest(df, id="id", numeric=["b", "c"], complete=["a"], trees=2, depth=3, sweeps=1)
    assert out.filter("b IS NULL OR c IS NULL").count() == 0
    assert len(written) == 3 and min(written) >= 8


def test_measures_filled_by_forests(spark):
    rng = np.random.default_rng(6)
    rows = [(i, m, float(t), i / 10 + k + rng.normal() / 10, t) for i in range(80) for k, m in enumerate("xy") for t in range(-2, 3) if not (i % 4 == 0 and m == "y")]
    df = spark.createDataFrame(rows, "id long, m string, t double, v double, seq int")
    entities = df.select("id").distinct()
    cov = entities.select("id", F.when(F.col("id") < 40, "young").otherwise("old").alias("age"))
    got = measures.baseline_measures(df, entities, id="id", measure="m", t="t", value="v", measures=["x", "y"], how="forest", covariates=cov, trees=15, depth=5, sweeps=2)
    plain = measures.baseline_measures(df, entities, id="id", measure="m", t="t", value="v", measures=["x", "y"], how="mean")
    assert got.columns == plain.columns and got.count() == plain.count() and got.filter("value is null").count() == 0
    filled = {r["id"]: r["value"] for r in got.filter("m = 'y' and period = 0 and id % 4 = 0").collect()}
    assert len(filled) == 20 and np.mean([abs(v - (i / 10 + 1)) for i, v in filled.items()]) < 1
    same = lambda d: sorted(map(tuple, d.filter("not (m = 'y' and id % 4 = 0)").collect()))
    assert same(got) == same(plain)
