"""From the leaderboard to a saved model: pick the best candidate, fit it on all rows, keep it with its class names."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.plans import training
from tabloom.plans.scoring import confidence, register_run
from tabloom.plans.training import STACK, CvResult

MAX_CLASSES = 1000


def class_table(df: DataFrame, target: str) -> list[str]:
    """The target's values as texts, in their own order; more than MAX_CLASSES are an error. Nulls are no class."""
    found = [r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: treat the target as continuous")
    texts = [r[0] for r in df.sparkSession.createDataFrame([(v,) for v in found], df.select(target).schema).select(F.col(target).cast("string")).collect()] if found else []
    return texts


def coded(df: DataFrame, target: str, names: list[str], out: str = "label") -> DataFrame:
    """Rows with a known class and its code; rows without one cannot be learnt from and go."""
    codes = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))]) if names else F.lit(None)
    return df.withColumn(out, F.try_element_at(codes, F.col(target).cast("string")) if names else codes.cast("double")).where(F.col(out).isNotNull())


def board_results(board: DataFrame, run_id: str) -> list[CvResult]:
    """The candidates of one run as the leaderboard has them, one row each."""
    out = []
    for r in board.where(F.col("run_id") == run_id).collect():
        params = {}
        for key, text in (r["params"] or {}).items():
            try:
                params[key] = ast.literal_eval(text)
            except (ValueError, SyntaxError):  # a plain word
                params[key] = text
        out.append(CvResult(r["model"], [] if r["mean"] is None else [r["mean"]], params, r["tuned"], r["status"]))
    return out


def best_result(results: list[CvResult]) -> CvResult:
    """The greatest mean; of equal ones a single model before a stack, then the first name (as `best_model`)."""
    scored = [r for r in results if r.scores]
    if not scored:
        raise ValueError("no candidate has a score")
    return min(scored, key=lambda r: (-r.mean, r.model == STACK, r.model))


@dataclass
class Winner:
    """The winning candidate, fitted on all rows; its pipeline takes the feature columns and gives prediction and, for
    classes, their names in ``class``."""

    candidate: CvResult
    pipeline: PipelineModel
    names: list[str] | None

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with ``prediction`` (the class itself for classes) and ``confidence``."""
        columns = df.columns
        scored = self.pipeline.transform(df)
        value = F.col("class") if self.names else F.col("prediction")
        return scored.withColumn("confidence", confidence(scored)).select(*columns, value.alias("prediction"), "confidence")

    def save(self, spark: SparkSession, path: str, run_id: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/run={run_id}/winner")
        facts = [(self.candidate.model, {k: str(v) for k, v in self.candidate.params.items()}, self.candidate.mean)]
        spark.createDataFrame(facts, "model string, params map<string,string>, mean double").coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run_id}/candidate")
        register_run(spark, path, run_id, self.candidate.model)

    @staticmethod
    def load(spark: SparkSession, path: str, run_id: str) -> Winner:
        pipeline = PipelineModel.load(f"{path}/run={run_id}/winner")
        named = [s for s in pipeline.stages if isinstance(s, IndexToString)]
        kept = spark.read.parquet(f"{path}/run={run_id}/candidate").withColumn("run_id", F.lit(run_id)).withColumns({"tuned": F.lit(False), "status": F.lit("ok")})
        return Winner(board_results(kept, run_id)[0], pipeline, named[0].getLabels() if named else None)


def fit_winner(df: DataFrame, features: list[str], target: str, results: list[CvResult], problem: str, fold: str = "fold") -> Winner:
    """Fit the best candidate on all rows. A stack needs the column of folds for its out-of-fold predictions; its members are
    the candidates it names, with their parameters. Rows without a target are left out."""
    best = best_result(results)
    names = class_table(df, target) if problem == "classification" else None
    rows = coded(df, target, names) if names is not None else df.withColumn("label", F.col(target).cast("double")).where("label IS NOT NULL")
    classes = max(2, len(names)) if names is not None else 2
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    data = assembler.transform(rows).select("features", "label", *([fold] if best.model == STACK else [])).withColumnsRenamed({fold: "fold"})
    frame = training.training_frame(data)
    try:
        if best.model == STACK:
            members = [next(r for r in results if r.model == m) for m in best.params["members"]]
            model = training.fit_stack(frame, members, problem, classes)
        else:
            model = training.fit_model(frame, best.model, problem, best.params, classes)
    finally:
        frame.unpersist()
    named = [IndexToString(inputCol="prediction", outputCol="class", labels=names)] if names else []
    return Winner(best, PipelineModel([assembler, model, *named]), names)
