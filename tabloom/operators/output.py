"""Output format detection, formatting and prediction statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class OutputFormat:
    id_column: str
    target_column: str
    value_type: str  # "binary", "probability", "categorical" or "continuous"


def id_column(columns: list[str]) -> str:
    return next((c for c in columns if "id" in c.lower()), columns[0])


def value_type_facts(sample: DataFrame, target: str) -> DataFrame:
    """(distinct, value_type) of the target column of a sample file; one aggregate."""
    y = F.col(target)
    textual = isinstance(sample.schema[target].dataType, T.StringType)
    number = y.cast("double") if not textual else F.lit(None).cast("double")
    groups = sample.where(y.isNotNull()).groupBy(y.alias("y"), number.alias("v")).agg(F.count("*").alias("cnt"))
    facts = groups.agg(
        F.count("*").alias("distinct"),
        F.coalesce(F.bool_and(F.coalesce(F.col("v").isin(0.0, 1.0), F.lit(False))), F.lit(True)).alias("zero_one"),
        F.coalesce(F.bool_and(F.coalesce(F.col("v").between(0.0, 1.0), F.lit(False))), F.lit(True)).alias("unit"),
        F.coalesce(F.bool_and(F.coalesce(F.col("v") == 0.5, F.lit(False))), F.lit(False)).alias("half"),
    )
    d = F.col("distinct")
    return facts.select(
        d,
        F.when(F.col("zero_one"), "binary")
        .when(F.col("unit") & (((d == 1) & F.col("half")) | (d > 2)), "probability")
        .when(F.lit(textual) | (d < 20), "categorical")
        .otherwise("continuous").alias("value_type"),
    )


def detect_format(sample: DataFrame) -> OutputFormat:
    ident = id_column(sample.columns)
    target = next(c for c in sample.columns if c != ident)
    return OutputFormat(ident, target, value_type_facts(sample, target).first()["value_type"])


def fallback_format(test_columns: list[str]) -> OutputFormat:
    ident = next((c for c in test_columns if "id" in c.lower()), "id")
    return OutputFormat(ident, "prediction", "binary")


def format_predictions(df: DataFrame, fmt: OutputFormat, prediction: Column, probability: Column | None = None) -> DataFrame:
    """(id, target) in the wanted form. Without the id column the first column stands in."""
    ident = F.col(fmt.id_column) if fmt.id_column in df.columns else F.col(df.columns[0])
    if fmt.value_type == "binary":
        value = prediction.cast("int")
    elif fmt.value_type == "probability":
        value = probability if probability is not None else prediction.cast("double")
    elif fmt.value_type == "categorical":
        value = prediction
    else:
        value = probability if probability is not None else prediction
    return df.select(ident.alias(fmt.id_column), value.alias(fmt.target_column))


def prediction_stats(df: DataFrame, prediction: str, confidence: str) -> DataFrame:
    p, c = F.col(prediction), F.col(confidence)
    return df.agg(
        F.count("*").alias("predictions_count"),
        F.sum(p).cast("bigint").alias("predicted_positive"),
        (F.count("*") - F.sum(p)).cast("bigint").alias("predicted_negative"),
        F.avg(p).alias("predicted_positive_rate"),
        F.min(c).alias("min_confidence"),
        F.max(c).alias("max_confidence"),
        F.avg(c).alias("mean_confidence"),
    )


def detailed_predictions(df: DataFrame, key: str, prediction: str, confidence: str) -> DataFrame:
    return df.select(key, F.col(prediction).alias("Prediction"), F.col(confidence).alias("Confidence"))
