"""Scoring batches and keeping models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.operators import output
from tabloom.operators.target import TargetTransform, inverse_logit
from tabloom.plans.engine import FeatureModel


def confidence(df: DataFrame) -> Column:
    """Probability of class 1, the highest probability for more classes, else the prediction itself."""
    if "probability" not in df.columns:
        return F.col("prediction")
    p = vector_to_array(F.col("probability"))
    return F.when(F.size(p) == 2, F.get(p, F.lit(1))).otherwise(F.array_max(p))


def score(features: DataFrame, names: list[str], model: Model, transform: TargetTransform | None = None) -> DataFrame:
    """Feature rows plus ``prediction`` and ``confidence``; lazily, with no step between rows."""
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(features))
    if transform and transform.applied:
        scored = scored.withColumn("prediction", inverse_logit(F.col("prediction"), transform.epsilon))
    return scored.withColumn("confidence", confidence(scored)).drop("features", "rawPrediction", "probability")


def class_names(scored: DataFrame, names: list[str]) -> DataFrame:
    """``prediction`` as the name of the class whose code it was."""
    named = IndexToString(inputCol="prediction", outputCol="__class", labels=names).transform(scored)
    return named.withColumn("prediction", F.col("__class")).drop("__class")


@dataclass
class Scorer:
    """A fitted feature model with a fitted predictor."""

    features: FeatureModel
    model: Model
    transform: TargetTransform | None = None
    names: list[str] | None = None  # of the classes, in the order of their codes

    def score(self, raw: DataFrame) -> DataFrame:
        """``prediction`` is the class itself where the scorer knows the classes."""
        scored = score(self.features.transform(raw), self.features.feature_names, self.model, self.transform)
        return class_names(scored, self.names) if self.names else scored

    def submit(self, raw: DataFrame, fmt: output.OutputFormat) -> DataFrame:
        return output.format_predictions(self.score(raw), fmt, F.col("prediction"), F.col("confidence"))

    def save(self, path: str, run_id: str, spark: SparkSession) -> None:
        self.features.save(f"{path}/run={run_id}/features", spark)
        named = [IndexToString(inputCol="prediction", outputCol="class", labels=self.names)] if self.names else []
        PipelineModel([self.model, *named]).write().overwrite().save(f"{path}/run={run_id}/model")

    @staticmethod
    def load(path: str, run_id: str, spark: SparkSession) -> Scorer:
        model, *named = PipelineModel.load(f"{path}/run={run_id}/model").stages
        return Scorer(FeatureModel.load(f"{path}/run={run_id}/features", spark), model, names=named[0].getLabels() if named else None)


def register_run(spark: SparkSession, path: str, run_id: str, model: str) -> None:
    """Append to the table of runs, with the time of registration."""
    row = spark.createDataFrame([(run_id, model)], "run_id string, model string").withColumn("registered", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{path}/runs")


def latest_run(spark: SparkSession, path: str) -> str | None:
    """The run registered last; of equal times the greater id."""
    return spark.read.parquet(f"{path}/runs").agg(F.max_by("run_id", F.struct("registered", "run_id"))).first()[0]
