"""The whole feature selection: filters, scores, combination and cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import hash32
from tabloom.operators import selection as ops
from tabloom.operators.infer import problem_type
from tabloom.plans import cells as compact
from tabloom.plans.cells import fit_trees
from tabloom.session import stored_columns


# Fixed value: more features than this are not eliminated one by one; the report says so.
MAX_ITERATIVE = 100


@dataclass(frozen=True)
class SelectionConfig:
    max_features: int = 100
    correlation_threshold: float = 0.95
    variance_threshold: float = 0.01
    enable_statistical_tests: bool = True
    enable_model_based: bool = True
    enable_iterative: bool = False
    strategy: str = "union"  # "union", "ensemble", "best" or "first"
    elimination_step: float = 0.2
    compat: bool = False


@dataclass(frozen=True)
class SelectionResult:
    selected: list[str]
    steps: DataFrame
    scores: DataFrame  # (method, feature, position, score)
    problem: str


def numeric_label(df: DataFrame, label: str, out: str = "label") -> DataFrame:
    """The label as a double; texts and flags are numbered alphabetically over the whole table."""
    if not isinstance(df.schema[label].dataType, (T.StringType, T.BooleanType)):
        return df.withColumn(out, F.col(label).cast("double"))
    text = df.withColumn("__text", F.col(label).cast("string"))
    indexer = StringIndexer(inputCol="__text", outputCol=out, stringOrderType="alphabetAsc").fit(text)
    return indexer.transform(text).drop("__text")


def assembled(df: DataFrame, features: list[str], label: str, extra: list[str] | None = None) -> DataFrame:
    """(features vector, label double, extra...)."""
    labelled = numeric_label(df, label)
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(labelled)
    return vectors.select("features", "label", *(extra or []))


def class_indexed(data: DataFrame) -> DataFrame:
    """Labels as 0..k-1, as tree and logistic models need; a no-op if they already are."""
    found = sorted(r[0] for r in data.select("label").distinct().limit(1001).collect())
    if found == [float(i) for i in range(len(found))]:
        return data
    if len(found) > 1000:
        raise ValueError("more than 1000 classes: treat the target as continuous")
    code = F.lit(None).cast("double")
    for i, v in enumerate(found):
        code = F.when(F.col("label") == F.lit(v), F.lit(float(i))).otherwise(code)
    return data.withColumn("label", code)


def model_scores(data: DataFrame, features: list[str], problem: str, seed: int = 42, trees: int = 50) -> list[tuple[str, int, float]]:
    """(feature, position, score): |coefficient| for two classes, else forest importance. ``data`` is assembled."""
    if problem == "classification":
        data = class_indexed(data)
        classes = data.select("label").distinct().count()
        if classes == 2:
            model = LogisticRegression(maxIter=1000, tol=1e-6).fit(data)
            values = [abs(float(v)) for v in model.coefficients.toArray()]
        else:
            values = _importances(fit_trees(RandomForestClassifier(numTrees=trees, seed=seed), data, False), len(features))
    else:
        values = _importances(fit_trees(RandomForestRegressor(numTrees=trees, seed=seed), data, True), len(features))
    return [(f, i, v) for i, (f, v) in enumerate(zip(features, values))]


def _importances(model: object, size: int) -> list[float]:
    return [float(v) for v in model.featureImportances.toArray()[:size]]


def importance(df: DataFrame, features: list[str], target: str, seed: int = 42, trees: int = 50) -> DataFrame:
    """(feature, position, score): forest importance; up to 10 distinct whole or text values make classes."""
    dtype = df.schema[target].dataType
    coded = isinstance(dtype, (T.StringType, T.LongType, T.IntegerType))
    few = coded and df.select(target).where(F.col(target).isNotNull()).distinct().limit(11).count() <= 10
    data = assembled(df.where(F.col(target).isNotNull()), features, target)
    forest = RandomForestClassifier(numTrees=trees, seed=seed) if few else RandomForestRegressor(numTrees=trees, seed=seed)
    model = fit_trees(forest, class_indexed(data) if few else data, not few)
    rows = [(f, i, v) for i, (f, v) in enumerate(zip(features, _importances(model, len(features))))]
    return df.sparkSession.createDataFrame(rows, "feature string, position int, score double")


def recursive_elimination(
    df: DataFrame, features: list[str], label: str, problem: str, fold: str = "fold", folds: int = 3, step: float = 0.2
) -> list[str]:
    """Cross-validated elimination by smallest |coefficient|; the size with the best mean score wins.

    ``step`` below 1 removes that share of the remaining features per round (step 1 removes one), so the
    number of distributed fits grows with the logarithm of the number of features.
    """
    floor = max(1, min(5, len(features) // 4))
    # numbered once, so that every slice means the same classes
    df, label = numeric_label(df, label, "__label"), "__label"
    parts = _fold_moments(df, features, label, fold, folds) if problem == "regression" else None
    scores: dict[int, list[float]] = {}
    for f in range(folds):
        train, held = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        if parts:
            known = {k: m for k, m in parts.items() if k is not None}
            train = compact.Moments.total(known, (f,))
        for kept, model in _eliminate(train, features, label, problem, floor, step, df.sparkSession):
            if parts:
                own = parts[f].only([*[features.index(c) for c in kept], -1])
                score = 1 - own.squared_error(model.coefficients.toArray(), model.intercept) * own.n / own.products[-1, -1] if own.products[-1, -1] else 0.0
            else:
                score = _score(model.transform(assembled(held, kept, label)), problem)
            scores.setdefault(len(kept), []).append(score)
    best = max(sorted(scores), key=lambda size: sum(scores[size]) / len(scores[size]))
    whole = compact.Moments.total(parts) if parts else df
    chosen = next(kept for kept, _ in _eliminate(whole, features, label, problem, floor, step, df.sparkSession) if len(kept) == best)
    return [f for f in features if f in set(chosen)]


def _fold_moments(df: DataFrame, features: list[str], label: str, fold: str, folds: int) -> dict[int, compact.Moments] | None:
    """One pass that serves every fit and score of a linear elimination; only for large tables with every fold."""
    if len(features) >= compact.MAX_PRODUCTS or df.count() <= compact.LARGE_ROWS:
        return None
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]], fold)
    parts = compact.column_moments(numbers, [*features, label], fold)
    return parts if set(range(folds)) <= set(parts) and len(parts) > 1 else None


def _eliminate(df: DataFrame | compact.Moments, features: list[str], label: str, problem: str, floor: int, step: float, spark: SparkSession):
    kept = list(features)
    while True:
        if isinstance(df, compact.Moments):
            model = LinearRegression(maxIter=100, weightCol="weight").fit(df.only([*[features.index(c) for c in kept], -1]).table(spark))
            weights = abs(model.coefficients.toArray())
        elif problem == "classification":
            model = LogisticRegression(maxIter=100).fit(assembled(df, kept, label))
            weights = abs(model.coefficientMatrix.toArray()).sum(axis=0)
        else:
            model = LinearRegression(maxIter=100).fit(assembled(df, kept, label))
            weights = abs(model.coefficients.toArray())
        yield kept, model
        if len(kept) <= floor:
            return
        drop = max(1, int(step * len(kept))) if step < 1 else int(step)
        drop = min(drop, len(kept) - floor)
        order = sorted(range(len(kept)), key=lambda i: (weights[i], -i))
        gone = {kept[i] for i in order[:drop]}
        kept = [f for f in kept if f not in gone]


def _score(predictions: DataFrame, problem: str) -> float:
    if problem == "classification":
        return predictions.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
    return RegressionEvaluator(metricName="r2").evaluate(predictions)


def detect_problem(df: DataFrame, target: str) -> str:
    return problem_type(df, target).first()["problem_type"]


def select_features(
    df: DataFrame, features: list[str], target: str, config: SelectionConfig = SelectionConfig(),
    problem: str = "auto", key: str | None = None,
) -> SelectionResult:
    """Variance and correlation filters, then the enabled methods, then their combination and the cap."""
    spark = df.sparkSession
    problem = detect_problem(df, target) if problem == "auto" else problem
    extra = [key] if key and key not in features and key != target else []
    clean = stored_columns(ops.prepare(df.select(*features, target, *extra), features, target))
    varied = [r["feature"] for r in ops.variance_filter(clean, features, config.variance_threshold).orderBy("position").collect()]
    varied = varied or list(features)
    steps = [("variance_filter", len(features), len(varied))]
    left = ops.correlation_filter(clean, varied, config.correlation_threshold)
    steps.append(("correlation_filter", len(varied), len(left)))
    picks: list[tuple[str, list[str]]] = []
    scores: list[DataFrame] = []
    if config.enable_statistical_tests:
        stat = ops.statistical_scores(clean, left, target, problem)
        chosen = ops.select_k_best(stat, min(config.max_features, len(left))).orderBy("position").collect()
        picks.append(("statistical", [r["feature"] for r in chosen]))
        scores.append(stat.select(F.lit("statistical").alias("method"), "feature", "position", "score"))
    if config.enable_model_based:
        rows = model_scores(assembled(clean, left, target), left, problem)
        best = sorted(rows, key=lambda r: (-r[2], r[0]))[: config.max_features]
        picks.append(("model_based", [f for f, _, _ in best]))
        scores.append(spark.createDataFrame([("model_based", *r) for r in rows], "method string, feature string, position int, score double"))
    if config.enable_iterative and len(left) > MAX_ITERATIVE:
        steps.append(("iterative_skipped", len(left), len(left)))
    elif config.enable_iterative:
        hashed = hash32(key) if key else F.xxhash64(*left) % 3 + 3
        folded = clean.withColumn("fold", (F.abs(hashed) % 3).cast("int"))
        picks.append(("iterative", recursive_elimination(folded, left, target, problem, step=config.elimination_step)))
    final = _combine(spark, picks, left, config) if picks else left
    if len(final) > config.max_features and scores:
        ranked = ops.rank_normalised(ops.union_all(scores)).where(F.col("feature").isin(final))
        top = {r["feature"] for r in ops.select_k_best(ranked, config.max_features).collect()}
        final = [f for f in final if f in top]
    elif len(final) > config.max_features:  # no method gave scores: the features that vary most
        spread = ops.variances(clean, final).orderBy(F.desc_nulls_last("variance"), "position").limit(config.max_features)
        top = {r["feature"] for r in spread.collect()}
        final = [f for f in final if f in top]
    steps.append(("combination", len(left), len(final)))
    empty = spark.createDataFrame([], "method string, feature string, position int, score double")
    return SelectionResult(final, ops.selection_report(spark, steps), ops.union_all(scores) if scores else empty, problem)


def _combine(spark, picks: list[tuple[str, list[str]]], features: list[str], config: SelectionConfig) -> list[str]:
    place = {f: i for i, f in enumerate(features)}
    if config.strategy == "first":
        return sorted(picks[0][1], key=place.get)
    rows = [(m, f, place[f]) for m, chosen in picks for f in chosen]
    table = spark.createDataFrame(rows, "method string, feature string, position int")
    if config.strategy == "union":
        result = ops.combine_union(table)
    elif config.strategy == "ensemble":
        result = ops.combine_vote(table, len(picks), config.compat)
    else:
        result = ops.combine_best(table)
    return [r["feature"] for r in result.orderBy("position").collect()]
