"""Target transform for bounded continuous targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Fixed value: how far a target in [0, 1] is kept from its ends.
LOGIT_EPSILON = 1e-7


@dataclass(frozen=True)
class TargetTransform:
    applied: bool
    type: str | None = None
    original_min: float | None = None
    original_max: float | None = None
    epsilon: float = LOGIT_EPSILON
    reason: str | None = None


def classification_like(df: DataFrame, target: str) -> DataFrame:
    """(distinct, n, integer_like, classification_like) of a target; nulls are left out."""
    dtype = df.schema[target].dataType
    y = F.col(target)
    groups = df.where(y.isNotNull()).groupBy(y.alias("y"), y.cast("string").try_cast("double").alias("v")).agg(F.count("*").alias("cnt"))
    near = F.abs(F.col("v") - F.round("v")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.round("v"))
    facts = groups.agg(
        F.count("*").alias("distinct"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"),
        F.coalesce(F.bool_and(F.coalesce(near, F.lit(True))) & (F.count("v") > 0), F.lit(False)).alias("integer_like"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    by_type = isinstance(dtype, (T.BooleanType, T.StringType))
    ratio = F.col("distinct") / F.greatest(F.col("n"), F.lit(1))
    return facts.withColumn(
        "classification_like",
        F.lit(by_type) | (F.col("distinct") <= 20) | ((ratio <= 0.05) & F.col("integer_like")),
    )


def fit_target(df: DataFrame, target: str) -> TargetTransform:
    facts = classification_like(df, target).first()
    if facts["classification_like"]:
        return TargetTransform(False, reason="classification_like_target")
    bounded = facts["min"] is not None and facts["min"] >= 0 and facts["max"] <= 1 and facts["max"] > facts["min"]
    if not bounded:
        return TargetTransform(False, reason="unbounded_target")
    return TargetTransform(True, "logit", facts["min"], facts["max"])


def logit(y: Column, epsilon: float = LOGIT_EPSILON) -> Column:
    inside = F.least(F.greatest(y, F.lit(epsilon)), F.lit(1 - epsilon))
    return F.ln(inside / (1 - inside))


def inverse_logit(p: Column, epsilon: float = LOGIT_EPSILON) -> Column:
    return F.least(F.greatest(1 / (1 + F.exp(-p)), F.lit(epsilon)), F.lit(1 - epsilon))


def apply_target(df: DataFrame, target: str, transform: TargetTransform, out: str | None = None) -> DataFrame:
    value = F.col(target)
    return df.withColumn(out or target, logit(value.cast("double"), transform.epsilon) if transform.applied else value)


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    y = F.col(target).cast("double")
    return df.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"))
