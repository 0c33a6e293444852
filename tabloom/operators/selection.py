"""Feature filters, scores and ways to combine them.

Tables of scores have one row per feature and stay small; the data is touched by one aggregate per step.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, Window

from tabloom.functions.hashing import hash32
from tabloom.functions.numeric import to_numeric
from tabloom.operators.profile import kind_of, nan_to_null
from tabloom.operators.quantiles import exact_medians


def _entries(names: list[str], fields: dict[str, str]) -> Column:
    """array of structs (feature, position, fields...) out of wide aggregate columns."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.lit(i).alias("position"), *[F.col(f"{p}{i}").alias(a) for a, p in fields.items()])
            for i, n in enumerate(names)
        ]
    )


def prepare(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rows with a target; numbers filled with the median, texts filled with the mode and label-encoded."""
    from tabloom.operators.vocab import fit_vocabulary, join_vocabulary, vocabulary_size, CategoricalConfig
    from tabloom.sources.shaping import modes

    df = nan_to_null(df)
    types = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    numbers = [f for f in features if types[f] != "string"]
    texts = [f for f in features if types[f] == "string"]
    medians = exact_medians(df, {f: F.col(f).cast("double") for f in numbers})
    filled = df.withColumns(
        {f: F.coalesce(F.col(f).cast("double"), F.lit(float(medians[f] if medians[f] is not None else 0.0))) for f in numbers}
    ) if numbers else df
    if texts:
        common = modes(df, texts)
        filled = filled.withColumns({t: F.coalesce(F.col(t), F.lit(common.get(t, "unknown"))) for t in texts})
        vocab = fit_vocabulary(filled, texts, CategoricalConfig(limit_codes=False))
        sizes = vocabulary_size(vocab)
        for i, t in enumerate(texts):
            filled = join_vocabulary(filled, vocab, t, F.col(t), ["code"], f"__v{i}_", sizes[t][1])
            filled = filled.withColumn(t, F.col(f"__v{i}_code").cast("double")).drop(f"__v{i}_code")
    return filled.where(F.col(target).isNotNull())


def variances(df: DataFrame, features: list[str], sample: bool = False) -> DataFrame:
    """(feature, position, variance) in one aggregate."""
    fn = F.var_samp if sample else F.var_pop
    wide = df.agg(*[fn(F.col(f).cast("double")).alias(f"v{i}") for i, f in enumerate(features)])
    return wide.select(F.explode(_entries(features, {"variance": "v"})).alias("e")).select("e.*")


def variance_filter(df: DataFrame, features: list[str], threshold: float = 0.01) -> DataFrame:
    return variances(df, features).where(F.col("variance") > threshold).select("feature", "position", "variance")


#: Columns whose products are summed up in one pass; the driver then holds (6 * GROUP)**2 numbers at most.
GROUP = 200
#: Complete columns up to which all products are sums of one aggregate.
FEW = 16


def correlation_matrix(df: DataFrame, features: list[str]) -> np.ndarray:
    """Pearson matrix, k x k for k features on the driver; a pair counts the rows in which both values are there. NaN where
    a feature is constant. Up to GROUP features take two passes with nulls or without: one for their presence and scale,
    one for the products. More features take a pass of products per pair of groups."""
    values = df.select(*[to_numeric(F.col(f"`{f}`")).alias(f"f{i}") for i, f in enumerate(features)])
    facts = values.agg(F.count(F.lit(1)).alias("rows"), *[e for c in values.columns for e in (F.count(c).alias(c), F.avg(c).alias(f"m{c}"), F.stddev_pop(c).alias(f"s{c}"))]).first()
    if all(facts[c] == facts["rows"] for c in values.columns) and len(features) <= FEW and facts["rows"]:
        return _centred_correlations(values, facts)
    if all(facts[c] == facts["rows"] for c in values.columns):
        vectors = VectorAssembler(inputCols=values.columns, outputCol="v").transform(values).select("v")
        return Correlation.corr(vectors, "v").head()[0].toArray()
    scaled = values.select(*[((F.col(c) - F.lit(facts[f"m{c}"] or 0.0)) / F.lit(facts[f"s{c}"] or 1.0)).alias(c) for c in values.columns])
    matrix = np.eye(len(features))
    starts = list(range(0, len(features), GROUP))
    groups = [list(range(a, min(a + GROUP, len(features)))) for a in starts]
    for x, left in enumerate(groups):
        for y in range(x, len(groups)) if len(groups) == 1 else range(x + 1, len(groups)):
            columns = left + [c for c in groups[y] if c not in left]
            matrix[np.ix_(columns, columns)] = _masked_correlations(scaled, [f"f{i}" for i in columns])
    return matrix


def _centred_correlations(values: DataFrame, facts: Row) -> np.ndarray:
    """Correlations of a few columns without nulls from one aggregate of products of their deviations from the mean."""
    names = values.columns
    off = values.select(*[(F.col(c) - F.lit(facts[f"m{c}"])).alias(c) for c in names])
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    sums = off.agg(F.count(F.lit(1)), *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    matrix = np.eye(len(names))
    for (i, j), total in zip(pairs, sums[1:], strict=True):
        a, b = facts[f"s{names[i]}"], facts[f"s{names[j]}"]
        matrix[i, j] = matrix[j, i] = np.nan if min(a, b) < 1e-12 else total / (facts["rows"] * a * b)
    return np.clip(matrix, -1.0, 1.0)


def _masked_correlations(values: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlations over complete pairs from one Gramian of (values with 0 for null, their squares, presence): its blocks
    are the products, and for every pair the counts, sums and sums of squares over the rows that have both."""
    k = len(columns)
    filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    wide = values.select(*[e.alias(f"x{i}") for i, e in enumerate(filled)], *[(e * e).alias(f"q{i}") for i, e in enumerate(filled)], *[F.col(c).isNotNull().cast("double").alias(f"p{i}") for i, c in enumerate(columns)])
    vectors = VectorAssembler(inputCols=wide.columns, outputCol="z").transform(wide).select("z")
    g = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "z")).computeGramianMatrix().toArray()
    products, sums, squares, n = g[:k, :k], g[:k, 2 * k :], g[k : 2 * k, 2 * k :], g[2 * k :, 2 * k :]
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - sums**2 / n  # of the row's feature, over the rows that have the column's feature too
        constant = ~(spread > 1e-12 * squares)
        r = (products - sums * sums.T / n) / np.sqrt(spread * spread.T)
    r[constant | constant.T] = np.nan
    np.fill_diagonal(r, 1.0)
    return np.clip(r, -1.0, 1.0)


def correlated_columns(matrix: np.ndarray, features: list[str], threshold: float = 0.95) -> list[str]:
    """Features with an earlier feature (dropped or not) correlated beyond the threshold."""
    strong = np.nan_to_num(np.abs(matrix)) > threshold
    return [features[j] for j in range(len(features)) if strong[:j, j].any()]


def correlation_filter(df: DataFrame, features: list[str], threshold: float = 0.95) -> list[str]:
    if len(features) < 2:
        return list(features)
    drop = set(correlated_columns(correlation_matrix(df, features), features, threshold))
    return [f for f in features if f not in drop]


def correlation_pairs(spark: SparkSession, matrix: np.ndarray, features: list[str]) -> DataFrame:
    rows = [
        (features[i], features[j], float(matrix[i, j]))
        for i in range(len(features)) for j in range(i + 1, len(features)) if not np.isnan(matrix[i, j])
    ]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, r double")


def top_correlations(spark: SparkSession, matrix: np.ndarray, features: list[str], n: int = 5) -> DataFrame:
    pairs = correlation_pairs(spark, matrix, features).withColumn("abs_correlation", F.abs("r"))
    return pairs.orderBy(F.desc("abs_correlation"), "feature_a", "feature_b").limit(n)


def _class_stats(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(label, n, feature, position, s, mean, var) with one row per class and feature."""
    per_class = df.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"),
        *[e for i, f in enumerate(features) for e in (
            F.sum(F.col(f).cast("double")).alias(f"s{i}"),
            F.avg(F.col(f).cast("double")).alias(f"m{i}"),
            F.var_pop(F.col(f).cast("double")).alias(f"w{i}"),
        )],
    )
    return per_class.select("label", "n", F.explode(_entries(features, {"s": "s", "mean": "m", "var": "w"})).alias("e")).select("label", "n", "e.*")


def score_chi2(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, position, score): sums per class against the sums expected from the class shares."""
    stats = _class_stats(df, features, label)
    totals = stats.groupBy("feature").agg(F.sum("s").alias("total"), F.sum("n").alias("rows"))
    expected = F.col("n") / F.col("rows") * F.col("total")
    part = F.try_divide((F.col("s") - expected) * (F.col("s") - expected), expected)
    return stats.join(F.broadcast(totals), "feature").groupBy("feature", "position").agg(F.sum(part).alias("score"))


def score_anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, position, score): one-way F between classes."""
    stats = _class_stats(df, features, label)
    totals = stats.groupBy("feature").agg(
        (F.sum("s") / F.sum("n")).alias("grand"), F.sum("n").alias("rows"), F.count("*").alias("classes")
    )
    joined = stats.join(F.broadcast(totals), "feature").groupBy("feature", "position").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.max("rows").alias("rows"),
        F.max("classes").alias("classes"),
    )
    score = F.try_divide(
        F.try_divide(F.col("between"), F.col("classes") - 1), F.try_divide(F.col("within"), F.col("rows") - F.col("classes"))
    )
    return joined.select("feature", "position", score.alias("score"))


def score_regression_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, position, score): F of a one-variable linear fit, from the correlation."""
    y = F.col(target).cast("double")
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.corr(F.col(f).cast("double"), y).alias(f"r{i}") for i, f in enumerate(features)],
    )
    long = wide.select("n", F.explode(_entries(features, {"r": "r"})).alias("e")).select("n", "e.*")
    r2 = F.when(~F.isnan("r"), F.col("r") * F.col("r"))
    return long.select("feature", "position", (F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).alias("score"))


def statistical_scores(df: DataFrame, features: list[str], target: str, problem: str) -> DataFrame:
    """Chi-square if all features are non-negative, else ANOVA F; regression F for a continuous target."""
    if problem != "classification":
        return score_regression_f(df, features, target)
    lows = df.agg(*[F.min(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return (score_chi2 if all(v is not None and v >= 0 for v in lows) else score_anova_f)(df, features, target)


def rank_scores(scores: DataFrame) -> DataFrame:
    """Scores plus rank: best first, unknown scores last, names break ties. One row per feature, so one partition is enough."""
    value = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    best = Window.partitionBy(F.lit(0)).orderBy(value.desc_nulls_last(), F.asc("feature"))
    return scores.withColumn("rank", F.row_number().over(best))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    return rank_scores(scores).where(F.col("rank") <= k)


def select_by_importance(scores: DataFrame, threshold: float = 0.01, max_features: int = 100) -> DataFrame:
    return rank_scores(scores.where(F.col("score") >= threshold)).where(F.col("rank") <= max_features)


def combine_union(picks: DataFrame) -> DataFrame:
    """picks: (method, feature, position). Features any method chose, in feature order."""
    return picks.select("feature", "position").distinct()


def combine_vote(picks: DataFrame, methods: int, compat: bool = False) -> DataFrame:
    """Features chosen by a majority of the methods; ``compat`` asks for half of them, rounded down."""
    needed = max(1, methods // 2) if compat else methods // 2 + 1
    votes = picks.groupBy("feature", "position").agg(F.count_distinct("method").alias("votes"))
    return votes.where(F.col("votes") >= needed).select("feature", "position")


def combine_best(picks: DataFrame) -> DataFrame:
    """The choice of the method with the most features; the first method by name on a tie."""
    sizes = picks.groupBy("method").agg(F.count("*").alias("size"))
    longest = sizes.agg(F.min_by("method", F.struct((-F.col("size")).alias("s"), F.col("method"))).alias("method"))
    return picks.join(F.broadcast(longest), "method", "left_semi").select("feature", "position")


def rank_normalised(scores: DataFrame) -> DataFrame:
    """(method, feature, position, score) -> mean rank share per feature, so methods on other scales can be compared."""
    value = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    by_method = Window.partitionBy("method").orderBy(value.desc_nulls_last(), F.asc("feature"))
    sized = scores.withColumn("r", F.row_number().over(by_method)).withColumn("m", F.count("*").over(Window.partitionBy("method")))
    share = 1 - (F.col("r") - 1) / F.col("m")
    return sized.groupBy("feature", "position").agg(F.avg(share).alias("score"))


def fallback_select(df: DataFrame, features: list[str], max_features: int, variance: float = 0.01, threshold: float = 0.95) -> list[str]:
    """Drop flat and redundant features; if too many are left, take a stable hash-ordered sample."""
    keep_rows = variances(df, features, sample=True).where(F.coalesce("variance", F.lit(1.0)) >= variance)
    flat = set(features) - {r["feature"] for r in keep_rows.collect()}
    redundant = set(correlated_columns(correlation_matrix(df, features), features, threshold)) if len(features) > 1 else set()
    left = [f for f in features if f not in flat and f not in redundant]
    if len(left) <= max_features:
        return left
    spark = df.sparkSession
    names = spark.createDataFrame([(f,) for f in left], "feature string").orderBy(hash32("feature"), "feature").limit(max_features)
    chosen = {r["feature"] for r in names.collect()}
    return [f for f in left if f in chosen]


def selection_report(spark: SparkSession, steps: list[tuple[str, int, int]]) -> DataFrame:
    rows = [(i, s, b, a, b - a) for i, (s, b, a) in enumerate(steps)]
    return spark.createDataFrame(rows, "position int, step string, before bigint, after bigint, removed bigint")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
