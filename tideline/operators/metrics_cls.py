"""Classifier metrics for any number of groups (seed, model, split, ...) at once.

Scored rows are first reduced to counts per distinct score, which makes ties exact and
removes copies; running counts over scores come from :func:`ordered_scan`, so neither the
number of rows in a group nor a heavily tied score limits the size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_poisson
from ..sources.sinks import stage
from .ordered import lookup, ordered_scan
from .quantiles import grouped_quantiles


def threshold_label(df: DataFrame, score: str, name: str = "label", cut: float = 0.5) -> DataFrame:
    return df.withColumn(name, F.when(F.col(score) > cut, 1.0).otherwise(0.0))


def scored(df: DataFrame, score: str) -> DataFrame:
    """Rows with a score: NULL and NaN ones rank nowhere and leave every metric."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def score_counts(df: DataFrame, by: Sequence[str], y: str, score: str, weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    hit = F.col(y).cast("double") == 1.0
    return scored(df, score).groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(hit, w).otherwise(0.0)).alias("pos"), F.sum(F.when(hit, 0.0).otherwise(w)).alias("neg")
    )


def _running(counts: DataFrame, by: Sequence[str], lead: bool = False) -> DataFrame:
    """Counts at or above each score, with group totals."""
    return ordered_scan(
        counts, by, ["score"], descending=True, hot="all",
        sums={"tp": "pos", "fp": "neg"},
        totals={"P": ("sum", "pos"), "N": ("sum", "neg")},
        number="__i" if lead else None,
        lead={"__pos": "pos", "__neg": "neg"} if lead else None,
    )


def accuracy_f1(df: DataFrame, by: Sequence[str], y: str, label: str, weight: str | None = None) -> DataFrame:
    """Accuracy and F1 of hard labels; F1 is 0 when undefined."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    yes, said = F.col(y).cast("double") == 1.0, F.col(label).cast("double") == 1.0
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    sums = df.groupBy(*by).agg(total(yes == said).alias("ok"), F.sum(w).alias("n"), total(yes & said).alias("tp"), total(yes != said).alias("wrong"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")), F.lit(0.0))
    return sums.select(*by, F.try_divide("ok", "n").alias("accuracy"), f1.alias("f1"))


def auroc_ap(df: DataFrame, by: Sequence[str], y: str, score: str, weight: str | None = None) -> DataFrame:
    """Tie-aware area under ROC and step-wise average precision in one scan.

    Both are missing when a group has a single class (no positives for precision).
    """
    r = _running(score_counts(df, by, y, score, weight), by)
    # pairs won: positives here against negatives strictly below, ties count half
    below = F.col("N") - F.col("fp")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    step = F.sum(F.col("pos") * F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)))
    g = r.groupBy(*by).agg(won.alias("won"), step.alias("step"), F.max("P").alias("P"), F.max("N").alias("N"))
    return g.select(*by, F.try_divide(F.col("won"), F.col("P") * F.col("N")).alias("auroc"), F.try_divide("step", "P").alias("average_precision"))


def roc_curve(df: DataFrame, by: Sequence[str], y: str, score: str, drop_intermediate: bool = True) -> DataFrame:
    """ROC points at distinct scores, highest first, after a point (0, 0) with no threshold.

    ``drop_intermediate`` leaves out points whose step repeats the one before it.
    """
    r = _running(score_counts(df, by, y, score), by, lead=True)
    if drop_intermediate:
        same = (F.col("__pos") == F.col("pos")) & (F.col("__neg") == F.col("neg"))
        r = r.filter((F.col("__i") == 1) | F.col("__pos").isNull() | ~same)
    point = F.struct(
        F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"), F.col("score").alias("threshold"), F.col("__i").alias("position")
    )
    origin = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("position"))
    points = F.when(F.col("__i") == 1, F.array(origin, point)).otherwise(F.array(point))
    return r.select(*by, F.inline(points))


def best_cutoff(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """ROC point nearest to the perfect corner; the highest threshold wins ties.

    Squared distances are compared after rounding at 1e-12, so that ties do not depend on
    the last bit.
    """
    c = roc_curve(df, by, y, score)
    far = F.round(F.pow(1 - F.col("tpr"), F.lit(2.0)) + F.pow(F.col("fpr"), F.lit(2.0)), 12)
    best = c.groupBy(*by).agg(F.min_by(F.struct("tpr", "fpr", "threshold"), F.struct(far, F.col("position"))).alias("b"))
    return best.select(*by, F.col("b.tpr").alias("sensitivity"), (1 - F.col("b.fpr")).alias("specificity"), F.col("b.threshold").alias("threshold"))


def calibration_bins(df: DataFrame, by: Sequence[str], y: str, score: str, lower: float = 0.33, upper: float = 0.66) -> DataFrame:
    """Observed and predicted positives in three score groups cut at two quantiles."""
    df = scored(df, score)
    q = grouped_quantiles(df, by, score, {"q1": lower, "q2": upper})
    hit = F.col(y).cast("double") == 1.0
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count_if(hit).alias("pos"))
    rows = lookup(counts, q, by, hot="all") if by else counts.withColumn("__q", q.agg(F.first(F.struct("q1", "q2"))).scalar()).select("*", "__q.q1", "__q.q2")
    part = F.when(F.col("score") <= F.col("q1"), 1).when(F.col("score") <= F.col("q2"), 2).otherwise(3)
    return rows.groupBy(*by, part.alias("quantile")).agg(F.sum("pos").alias("observed"), F.sum(F.col("score") * F.col("n")).alias("predicted"))


def decision_curve(df: DataFrame, by: Sequence[str], y: str, score: str, steps: int = 100) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none at ``i / steps``.

    Scores are reduced to the number of thresholds they reach, at most ``steps`` values
    per group, before running counts are formed; rows are never multiplied.
    """
    grid = F.array(*[F.lit(i / steps) for i in range(steps)])
    reached = scored(df, score).withColumn("__k", F.size(F.filter(grid, lambda t: t <= F.col(score))))
    hit = F.col(y).cast("double") == 1.0
    counts = reached.groupBy(*by, "__k").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    # one bounded map per group: {thresholds reached -> counts}
    per_group = counts.groupBy(*by).agg(
        F.collect_list(F.struct("__k", "pos", "neg")).alias("cells"), F.sum("pos").alias("P"), (F.sum("pos") + F.sum("neg")).alias("n")
    )
    at = per_group.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    above = lambda f: F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["__k"] > F.col("i"), c[f]).otherwise(0))
    t = F.col("i") / F.lit(float(steps))
    odds = t / (1 - t)
    n, P = F.col("n"), F.col("P")
    return at.withColumns({"tp": above("pos"), "fp": above("neg")}).select(
        *by,
        t.alias("threshold"),
        (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit"),
        (P / n - (n - P) / n * odds).alias("treat_all"),
        F.lit(0.0).alias("treat_none"),
    )


def bootstrap_metric(df: DataFrame, by: Sequence[str], y: str, score: str, *, key: Sequence[str], seed, replicates: int = 100) -> DataFrame:
    """AUROC, average precision, accuracy and F1 (cut at 0.5) per bootstrap replicate.

    Each (row, replicate) gets a Poisson(1) weight keyed by the row, the usual stand-in for
    drawing n of n with replacement; it needs no global row count and no row exchange.
    Weights are summed per (replicate, score) map-side, so only distinct scores move.
    """
    reps = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weighted = reps.withColumn("__w", keyed_poisson(seed, "bootstrap", F.col("replicate"), *[F.col(k) for k in key])).filter("__w > 0")
    weighted = stage(score_counts(weighted, [*by, "replicate"], y, score, "__w"))  # read twice below
    sides = F.inline(F.array(F.struct(F.lit(1.0).alias("__y"), F.col("pos").alias("__w")), F.struct(F.lit(0.0).alias("__y"), F.col("neg").alias("__w"))))
    rows = threshold_label(weighted.select(*by, "replicate", "score", sides), "score", "__hard").filter("__w > 0")
    keys = [*by, "replicate"]
    ranked = auroc_ap(rows, keys, "__y", "score", "__w").withColumn("__k", F.struct(*keys))
    hard = accuracy_f1(rows, keys, "__y", "__hard", "__w").select(F.struct(*keys).alias("__k"), "accuracy", "f1")
    return ranked.join(hard, "__k").drop("__k")
