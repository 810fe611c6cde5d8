"""The log-rank forest against a plain NumPy tree, and its defined cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import survival_forest as sf

COVARIATES = ["x0", "x1", "x2"]


def cohort(n=300, seed=3):
    """One or two intervals per entity, the second with another x2."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)).round(1)
    late = rng.integers(0, 4, n).astype(float)
    t = late + np.ceil(rng.exponential(15 * np.exp(-0.8 * x[:, 0]))).clip(1, 50)
    c = late + rng.integers(4, 50, n)
    end, event = np.minimum(t, c), (t <= c).astype(float)
    rows = []
    for i in range(n):
        cut = np.floor((late[i] + end[i]) / 2)
        if i % 3 == 0 and late[i] < cut < end[i]:
            rows += [(i, late[i], cut, 0.0, *x[i], 0.0), (i, cut, end[i], event[i], *x[i], 1.0)]
        else:
            rows.append((i, late[i], end[i], event[i], *x[i], 0.0))
    return pd.DataFrame(rows, columns=["id", "start", "end", "event", *COVARIATES])


def plain_hazard(p):
    """Event times and cumulative hazard after each."""
    times = np.unique(p.end[p.event > 0])
    h = [((p.end == t) & (p.event > 0)).sum() / ((p.start < t) & (p.end >= t)).sum() for t in times]
    return times, np.cumsum(h)


def plain_tree(p, cuts, depth, min_leaf=15, min_events=3):
    """Nested (feature, value, left, right), or a leaf's (event times, hazard); numerators summed time by time."""
    times, h = plain_hazard(p)
    until = lambda t: np.concatenate([[0.0], h])[np.searchsorted(times, t, side="right")]
    score = p.event - (until(p.end) - until(p.start))
    best = (0.0, None)
    for f, name in enumerate(COVARIATES):
        for v in cuts[f]:
            left = p[name] <= v
            n, m = left.sum(), len(p)
            if depth == 0 or min(n, m - n) < min_leaf or min(p.event[left].sum(), p.event[~left].sum()) < min_events:
                continue
            u = 0.0
            for t in times:
                risk, dead = (p.start < t) & (p.end >= t), (p.end == t) & (p.event > 0)
                u += (dead & left).sum() - (risk & left).sum() * dead.sum() / risk.sum()
            worth = round(u * u / (n * (m - n) / (m * (m - 1)) * (score**2).sum()), 9)
            if worth > best[0]:
                best = worth, (f, v, left)
    if best[1] is None:
        return times, h
    f, v, left = best[1]
    return f, v, plain_tree(p[left], cuts, depth - 1), plain_tree(p[~left], cuts, depth - 1)


def nested(m, tree, node=0):
    f = tree.feature[node]
    if f < 0:
        steps, h = tree.hazard[node]
        return m.times[steps - 1], h
    return f, m.cuts[f][tree.cut[node]], nested(m, tree, tree.left[node]), nested(m, tree, tree.right[node])


def same(a, b):
    if len(a) == 2 or len(b) == 2:
        return len(a) == len(b) and np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1], atol=1e-12)
    return a[0] == b[0] and a[1] == b[1] and same(a[2], b[2]) and same(a[3], b[3])


def hazard_at(tree, row, t):
    while len(tree) == 4:
        tree = tree[2] if row[COVARIATES[tree[0]]] <= tree[1] else tree[3]
    return np.concatenate([[0.0], tree[1]])[np.searchsorted(tree[0], t, side="right")]


@pytest.mark.parametrize("cells", [sf.CELLS, 150])
def test_one_tree_is_the_plain_tree(spark, monkeypatch, cells):
    """Also where each node takes a pass of its own."""
    monkeypatch.setattr(sf, "CELLS", cells)
    p = cohort()
    df = spark.createDataFrame(p).repartition(5)
    m = sf.fit_survival_forest(df, COVARIATES, id="id", trees=1, depth=3 if cells > 1000 else 2, tries=3, bootstrap=False, bins=12)
    plain = plain_tree(p, m.cuts, 3 if cells > 1000 else 2)
    assert len(plain) == 4 and same(nested(m, m.trees[0]), plain)
    if cells < 1000:
        return
    points = spark.createDataFrame([(t, "k") for t in (1.0, 6.5, 20.0, 70.0)], "eval_t double, note string")
    got = {(r["id"], r["eval_t"]): r["surv"] for r in sf.forest_survival(m, df, points, id="id").collect()}
    want = {}
    for i, rows in p.sort_values("start").groupby("id"):
        rows = [r for _, r in rows.iterrows()]
        for t in (1.0, 6.5, 20.0, 70.0):
            total = 0.0
            for j, r in enumerate(rows):
                to = t if j == len(rows) - 1 else min(t, r.end)
                if r.start <= t:
                    total += hazard_at(plain, r, to) - hazard_at(plain, r, r.start)
            if rows[0].start <= t:
                want[i, t] = np.exp(-total)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_forest_ranks_and_repeats(spark):
    p = cohort(400)
    fit = lambda df: sf.fit_survival_forest(df, COVARIATES, id="id", trees=20, depth=3, seed=4)
    a, b = fit(spark.createDataFrame(p).repartition(3)), fit(spark.createDataFrame(p.sample(frac=1, random_state=1)).repartition(7))
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees] and [t.cut for t in a.trees] == [t.cut for t in b.trees]
    assert len({tuple(t.feature) for t in a.trees}) > 1
    new = spark.createDataFrame([(1, 0.0, 9.0, -1.5, 0.0, 0.0), (2, 0.0, 9.0, 1.5, 0.0, 0.0)], "id long, start double, end double, x0 double, x1 double, x2 double")
    surv = {(r["id"], r["eval_t"]): r["surv"] for r in sf.forest_survival(a, new, spark.createDataFrame([(5.0,), (15.0,)], "eval_t double"), id="id").collect()}
    assert 1 > surv[1, 5.0] > surv[2, 5.0] + 0.2 and surv[2, 5.0] > surv[2, 15.0] > 0


def test_defined_cases(spark):
    p = cohort(120)
    bad = p.head(4).assign(id=[900, 901, 902, 903], start=[5.0, None, 1.0, 3.0], end=[5.0, 9.0, None, 2.0], event=1.0)
    df = spark.createDataFrame(pd.concat([p, bad]).assign(codes="x", key=1, e=2.0))
    for c in ("start", "end"):
        df = df.withColumn(c, F.when(F.isnan(c), None).otherwise(F.col(c)))
    kw = dict(id="id", trees=1, depth=2, tries=3, bootstrap=False)
    a, b = sf.fit_survival_forest(df, COVARIATES, **kw), sf.fit_survival_forest(spark.createDataFrame(p), COVARIATES, **kw)
    assert same(nested(a, a.trees[0]), nested(b, b.trees[0]))
    # a missing covariate goes with the largest values
    gaps = p.assign(x0=p.x0.where(p.x0 < 1.0))
    holes = spark.createDataFrame(gaps).withColumn("x0", F.when(F.isnan("x0"), None).otherwise(F.col("x0")))
    c = sf.fit_survival_forest(holes, COVARIATES, **kw)
    full = gaps.assign(x0=gaps.x0.fillna(99.0))
    assert same(nested(c, c.trees[0]), plain_tree(full, c.cuts, 2))
    # no events, and no rows at all
    for none in (spark.createDataFrame(p.assign(event=0.0)), spark.createDataFrame(p).limit(0)):
        m = sf.fit_survival_forest(none, COVARIATES, **kw)
        assert m.trees[0].feature == [-1] and len(m.times) == 0
        out = sf.forest_survival(m, spark.createDataFrame(p.head(3)), spark.createDataFrame([(60.0,)], "eval_t double"), id="id").collect()
        assert out and all(r["surv"] == 1.0 for r in out)
    with pytest.raises(ValueError):
        sf.fit_survival_forest(df, [], id="id")
