"""Classification and hazard models on Spark ML, their importances and dependence curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_uniform
from ..sources.sinks import stage
from . import forests
from .dependence import forest_dependence
from .intervals import in_force, person_period, stabbing_join, stitch_predictions
from .metrics_surv import c_index
from .ordered import lookup, ordered_scan, shuffle_partitions
from .sampling import permuted_lists, with_repetitions

PENALTIES = {"none": (0.0, 0.0), "lasso": (1.0, 1.0), "ridge": (1.0, 0.0), "elastic": (1.0, 0.5)}


def model_columns(df: DataFrame, bookkeeping: Sequence[str]) -> list[str]:
    """All numeric columns except the bookkeeping ones."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if c not in set(bookkeeping) and t in numeric]


def assemble(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """``features`` vector (and ``label``); rows with missing inputs are refused by Spark ML."""
    out = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    return out if label is None else out.withColumn("label", F.col(label).cast("double"))


def fit_tasks(spark) -> int:
    """Tasks among which the rows of an iterative fit are dealt, so that a small table uses all cores too."""
    return max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))


def dealt(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """``df`` written once, its rows dealt over ``tasks`` (``fit_tasks``) by a hash of ``keys``: every pass of a fit uses all tasks."""
    # by a hash: a shuffle by the keys themselves would be left out, or its parts be merged
    return stage(df.repartition(tasks or fit_tasks(df.sparkSession), F.xxhash64(*keys)))


def forest(trees: int = 500, min_leaf: int = 1, depth: int = 10, seed: int = 0) -> RandomForestClassifier:
    # nodes of many trees are split in one pass over the rows, as far as the histograms fit
    return RandomForestClassifier(numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed, maxMemoryInMB=1024)


def boosted(iterations: int = 100, rate: float = 0.1, min_leaf: int = 1, depth: int = 3, seed: int = 0) -> GBTClassifier:
    return GBTClassifier(maxIter=iterations, stepSize=rate, minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed)


def logistic(penalty: str = "none", strength: float = 0.0, mix: float | None = None, iterations: int = 100) -> LogisticRegression:
    """``strength`` is 1 / (C n) for an inverse penalty C; inputs come standardised."""
    if penalty not in PENALTIES:
        raise ValueError(f"penalty must be one of {sorted(PENALTIES)}")
    used, default_mix = PENALTIES[penalty]
    return LogisticRegression(regParam=used * strength, elasticNetParam=default_mix if mix is None else mix, standardization=False, maxIter=iterations)


def tune(estimator, grid: list[dict], df: DataFrame, *, id: str, seed, folds: int = 5, parallelism: int = 4, metric: str = "accuracy") -> CrossValidatorModel:
    """Grid search with folds keyed by entity, refitted at the best setting.

    ``metric``: accuracy (the default), f1, areaUnderROC or areaUnderPR.
    """
    judge = BinaryClassificationEvaluator(metricName=metric) if metric.startswith("area") else MulticlassClassificationEvaluator(metricName=metric)
    keyed = df.withColumn("fold", F.floor(keyed_uniform(seed, "fold", F.col(id)) * folds).cast("int"))
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=parallelism
    )
    return cv.fit(keyed)


def best_model(model: Model) -> Model:
    return model.bestModel if isinstance(model, CrossValidatorModel) else model


def score(model: Model, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1."""
    out = best_model(model).transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def coefficient_importance(spark, model: Model, names: Sequence[str]) -> DataFrame:
    """Absolute coefficient and whether it is non-zero, per feature."""
    rows = [(n, abs(float(b)), int(b != 0)) for n, b in zip(names, best_model(model).coefficients.toArray())]
    return spark.createDataFrame(rows, "name string, importance double, nonzero int")


def impurity_importance(spark, model: Model, names: Sequence[str]) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, best_model(model).featureImportances.toArray())]
    return spark.createDataFrame(rows, "name string, importance double")


def partial_dependence(model: Model, df: DataFrame, columns: Sequence[str], feature: str, points: int = 100) -> DataFrame:
    """Average score with ``feature`` set to each of ``points`` values over its range.

    Forests are read from counts of rows by leaf. For other models the grid is a fixed-length
    array attached to each row, so the work is rows x points and the average combines map-side.
    """
    if isinstance(best_model(model), RandomForestClassificationModel):
        return forest_dependence(best_model(model), df, columns, feature, points)
    low_high = df.agg(F.struct(F.min(feature).cast("double").alias("lo"), F.max(feature).cast("double").alias("hi"))).scalar()
    rows = df.select(*columns).withColumn("__r", low_high).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    value = F.col("__r.lo") + (F.col("__r.hi") - F.col("__r.lo")) * F.col("__i") / F.lit(float(points - 1))
    rows = rows.withColumn(feature, value).withColumn("__g", value)
    scored = score(model, assemble(rows, columns))
    return scored.groupBy(F.lit(feature).alias("feature"), F.col("__i").alias("point"), F.col("__g").alias("grid_value")).agg(F.avg("score").alias("average"))


def permuted_rows(df: DataFrame, variables: Sequence[str], *, key: Sequence[str], id: str, seed, static: Sequence[str] = (), replicates: int = 20, hot: Sequence | None = None) -> DataFrame:
    """``df`` once as it is (``variable`` NULL, ``replicate`` 0) and once for each variable and replicate with that one permuted.

    A replicate draws one permutation of the rows and one of the entities; ``static`` variables
    move by the latter, all rows of an entity together. ``key`` tells rows apart and starts with a numeric column.
    """
    variables, static = list(variables), [v for v in variables if v in set(static)]
    moving = [v for v in variables if v not in set(static)]
    rows = df
    if moving:
        rows = permuted_lists(rows.withColumn("__m", F.struct(*moving)), key=key, column="__m", seed=seed, replicates=replicates, name="__moving").drop("__m")
    if static:
        per_entity = df.groupBy(id).agg(F.max(F.struct(*static)).alias("__s"))
        moved = permuted_lists(per_entity, key=[id], column="__s", seed=seed, replicates=replicates, name="__static").select(id, "__static")
        rows = lookup(rows, moved.hint("merge"), [id], "left", hot=hot)
    # the values of all replicates came as lists: from here on a row is repeated where it lies
    rows = with_repetitions(rows, replicates, "replicate")
    others = [c for c in df.columns if c not in set(variables)]
    versions = []
    for v in variables:
        new = F.get("__static" if v in static else "__moving", F.col("replicate") - 1)[v]
        versions.append(F.struct(F.lit(v).alias("variable"), *[(new if c == v else F.col(c)).alias(c) for c in variables]))
    changed = rows.select("replicate", *others, F.inline(F.array(*versions)))
    return changed.unionByName(df.select("*", F.lit(None).cast("string").alias("variable"), F.lit(0).alias("replicate")))


def permutation_by_time(
    df: DataFrame, variables: Sequence[str], points: DataFrame, predict: Callable[[DataFrame], DataFrame], *, key: Sequence[str], id: str,
    start: str = "start", end: str = "end", event: str = "event", seed, static: Sequence[str] = (), replicates: int = 20, weights: str = "none", hot: Sequence | None = None,
) -> DataFrame:
    """(variable, eval_t, original, permuted): concordance at each time, and its mean when a variable is permuted.

    At a time an entity is represented by its newest interval that has started, with that
    interval's event and the entity's last end; pairs count whose earlier end is not after the time, and
    the score is the survival that ``predict`` adds as ``surv`` to rows with ``eval_t`` (and
    whatever else ``points`` carries). Variables, replicates and times are columns of one plan.
    Times without a usable pair are left out.
    """
    rows = stage(in_force(df, id=id, start=start, end=end, hot=hot))
    drawn = permuted_rows(rows, variables, key=key, id=id, seed=seed, static=static, replicates=replicates, hot=hot)
    scored = predict(stabbing_join(drawn, points, lower=start, upper="until_t", at="eval_t")).withColumn("__risk", -F.col("surv"))
    c = c_index(scored, ["variable", "replicate", "eval_t"], time="follow_up", event=event, risk="__risk", tau="eval_t", weights=weights, largest=rows.count()).filter(F.col("c_index").isNotNull())
    c = stage(c)
    base = c.filter("variable IS NULL").select("eval_t", F.col("c_index").alias("original"))
    return c.filter("variable IS NOT NULL").groupBy("variable", "eval_t").agg(F.avg("c_index").alias("permuted")).join(base, "eval_t").select("variable", "eval_t", "original", "permuted")


def permutation_importance(df: DataFrame, variables: Sequence[str], points: DataFrame, predict: Callable[[DataFrame], DataFrame], **kw) -> DataFrame:
    """(variable, importance, n_times): drop of the concordance when a variable is permuted, averaged over times; see ``permutation_by_time``."""
    by_time = permutation_by_time(df, variables, points, predict, **kw)
    return by_time.groupBy("variable").agg(F.avg(F.col("original") - F.col("permuted")).alias("importance"), F.count("*").alias("n_times"))


def hazard_forest(train: DataFrame, covariates: Sequence[str], edges: Sequence[float], *, trees: int = 100, depth: int = 8, min_leaf: int = 5, seed: int = 0) -> Model:
    """Discrete-time hazard: a forest on person-period rows with the bin as a covariate.

    Stands in for a forest on left-truncated intervals: same inputs and outputs, other
    estimator.
    """
    rows = person_period(train, start="start", end="end", event="event", edges=edges).withColumn("bin", F.col("bin").cast("double"))
    rows = dealt(rows.select("start", "end", *covariates, "bin", "y"), ["start", "end", *covariates, "bin"])
    return forest(trees, min_leaf, depth, seed).fit(assemble(rows, [*covariates, "bin"], "y"))


def hazard_survival(model: Model, test: DataFrame, covariates: Sequence[str], edges: Sequence[float], *, id: str, hot: Sequence | None = None) -> DataFrame:
    """Survival at every bin end: running product of one minus the bin hazards per entity."""
    edges = sorted(set(float(e) for e in edges))
    rows = stitch_predictions(test, id=id, start="start", end="end", times=edges[:-1], hot=hot)
    bins = F.array(*[F.lit(e) for e in edges[:-1]])
    rows = rows.withColumn("bin", (F.array_position(bins, F.col("eval_t")) - 1).cast("double"))
    scored = score(model, assemble(rows, [*covariates, "bin"]), "hazard")
    scored = scored.withColumn("__ln", F.log1p(-F.least("hazard", F.lit(1.0 - 1e-12))))
    run = ordered_scan(scored.select(id, "bin", "hazard", "__ln"), [id], ["bin"], sums={"__sum": "__ln"}, hot=[] if hot is None else hot)
    ends = F.array(*[F.lit(e) for e in edges[1:]])
    return run.select(id, F.element_at(ends, (F.col("bin") + 1).cast("int")).alias("eval_t"), "hazard", F.exp("__sum").alias("surv"))


def impute_forest(
    df: DataFrame, *, id: str, numeric: Sequence[str] = (), complete: Sequence[str] = (), categorical: Sequence[str] = (), sweeps: int = 5, trees: int = 100, depth: int = 8, seed: int = 0
) -> DataFrame:
    """Chained forest imputation of numeric and text columns; ``complete`` are numeric inputs without gaps.

    Start from column means and most frequent texts (of equally frequent ones the first), then
    refit each incomplete column on all others, those with fewest gaps first, and replace its missing cells. A
    sweep's change is the squared change of the numeric cells over their squares, and the share of
    text cells that changed. When each kind that has gaps changed more than in the sweep before,
    that sweep's table is returned. Texts are few-valued: their levels are categories of the trees. The table
    is dealt over all tasks and written after every column, so that a fit reads files and not the forests
    before it, and a lost executor repeats no training. Only rows with a gap are predicted. A column without any value stays as it is and is no input.
    """
    numeric, complete, categorical = list(numeric), list(complete), list(categorical)
    kept = [*complete, *numeric, *categorical]
    base = dealt(df.select(id, *kept, *[F.col(c).isNull().alias(f"__na_{c}") for c in numeric + categorical]), [id])
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"b_{c}") for c in complete] + [F.count_if(F.isnan(F.col(c).cast("double"))).alias(f"b_{c}") for c in numeric]
    gaps = base.agg(*[F.count_if(f"__na_{c}").alias(f"n_{c}") for c in numeric + categorical], *[F.avg(c).alias(f"m_{c}") for c in numeric], *bad, F.count("*").alias("rows")).first()
    rows = gaps["rows"]
    empty = [c for c in numeric + categorical if gaps[f"n_{c}"] == rows]
    used, texts = [c for c in numeric if c not in empty], [c for c in categorical if c not in empty]
    todo = sorted((c for c in used + texts if gaps[f"n_{c}"] > 0), key=lambda c: gaps[f"n_{c}"])
    inputs = [*complete, *used, *texts]
    if not todo or len(inputs) == 1:
        starts = {c: F.coalesce(F.col(c).cast("double"), F.lit(gaps[f"m_{c}"])) for c in used}
        return base.withColumns(starts).select(id, *kept)
    if invalid := [c for c in complete + used if gaps[f"b_{c}"]]:
        raise ValueError(f"inputs with gaps or NaN: {invalid}")
    levels, first = {}, {}
    for c in texts:
        counts = base.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).collect()  # one row per level of a categorical column
        first[c], levels[c] = counts[0][0], sorted(r[0] for r in counts)
    number = lambda c: F.array_position(F.array(*[F.lit(v) for v in levels[c]]), F.coalesce(F.col(c), F.lit(first[c]))) - 1
    starts = {c: F.coalesce(F.col(c).cast("double"), F.lit(gaps[f"m_{c}"])) for c in used} | {c: number(c).cast("double") for c in texts}
    cur = base.withColumns(starts)
    codings = forests.numeric_cuts(cur, complete + used) | {c: len(levels[c]) for c in texts}
    # a row's draws depend on what was given, not on what is filled
    key = F.xxhash64(id, *complete, *[F.when(~F.col(f"__na_{c}"), F.col(c)) for c in used + texts])
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(fit_tasks(df.sparkSession), rows // 20_000))  # small tables need no more
    last = {"numeric": float("inf"), "text": float("inf")}
    for _ in range(sweeps):
        before, sums = cur, {"numeric": [0.0, 0.0], "text": [0.0, 0.0]}
        for c in todo:
            gap, others = F.col(f"__na_{c}"), [x for x in inputs if x != c]
            fit = forests.fit_forest(
                cur.filter(~gap), c, others, [codings[x] for x in others], key=key, rows=rows - gaps[f"n_{c}"], classes=len(levels.get(c, ())), centre=0.0 if c in levels else gaps[f"m_{c}"],
                trees=trees, depth=depth, seed=seed,
            )
            filled = cur.filter(gap).withColumns({"__was": F.col(c), c: forests.predicted(fit)}).unionByName(cur.filter(~gap).withColumn("__was", F.col(c)))
            new = dealt(filled, [id], tasks)
            x, was = F.col(c), F.col("__was")
            change, size = (F.sum(F.when(gap, v).otherwise(0.0)) for v in (((x != was).cast("double"), F.lit(1.0)) if c in levels else (F.pow(x - was, F.lit(2.0)), F.pow(x, F.lit(2.0)))))
            r, kind = new.agg(change.alias("a"), size.alias("b")).first(), "text" if c in levels else "numeric"
            sums[kind] = [sums[kind][0] + r["a"], sums[kind][1] + r["b"]]
            cur = new.drop("__was")
            if c in used:
                codings |= forests.numeric_cuts(cur, [c])
        change = {k: a / (b or 1.0) for k, (a, b) in sums.items() if any((c in levels) == (k == "text") for c in todo)}
        if all(v >= last[k] for k, v in change.items()):
            cur = before
            break
        last |= change
    told = {c: F.element_at(F.array(*[F.lit(v) for v in levels[c]]), F.col(c).cast("int") + 1) for c in texts}
    return cur.withColumns(told).select(id, *kept)
