"""Writing results. Every sink is a folder written by all tasks; nothing is forced into one file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_predictions(df: DataFrame, path: str, run_id: str | None = None) -> list[str]:
    """CSV with header under ``path``/current, and a copy under the run id."""
    targets = [f"{path}/current"] + ([f"{path}/run={run_id}"] if run_id else [])
    for target in targets:
        df.write.mode("overwrite").option("header", True).csv(target)
    return targets


def write_report(report: DataFrame | dict, path: str, spark: SparkSession | None = None) -> None:
    """A report table or dictionary as JSON lines."""
    if isinstance(report, dict):
        if spark is None:
            raise ValueError("a dictionary report needs the session")
        report = spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in report.items()], "item string, content string")
    report.write.mode("overwrite").json(path)


def write_matrix(df: DataFrame, path: str, key: list[str], features: list[str], label: str | None = None) -> None:
    """Feature matrix with key and label as Parquet; names live in the schema."""
    extra = [label] if label and label not in features else []
    df.select(*key, *features, *extra).write.mode("overwrite").parquet(path)


def write_cv_results(leaderboard: DataFrame, path: str) -> None:
    leaderboard.select(
        F.col("model").alias("Model"), F.col("mean").alias("Mean_Score"), F.col("std").alias("Std_Score")
    ).write.mode("overwrite").option("header", True).csv(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
