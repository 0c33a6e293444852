"""Leaderboard to saved winner, also in a session of its own; searches that keep a deadline."""

import subprocess
import sys
import time

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.plans import selection, training, winner
from tabloom.plans.training import BOOSTING, FOREST, LINEAR, LOGISTIC, RIDGE, STACK, CvResult


@pytest.fixture(scope="module")
def data(spark):
    i = F.col("id")
    a, b = F.pmod(i * 7919, F.lit(101)) / 10, F.pmod(i * 104729, F.lit(89)) / 10
    kind = F.when(a + b > 12, "high").when(a > 4, "mid").otherwise("low")
    return spark.range(0, 600).select("id", a.alias("a"), b.alias("b"), (3 * a - b + 1).alias("y"), kind.alias("kind"), F.pmod(i, F.lit(5)).cast("int").alias("fold")).persist()


RESULTS = [CvResult(LINEAR, [-1.0]), CvResult(RIDGE, [-0.5], {"alpha": 0.25}), CvResult(FOREST, [-0.7], {"n_estimators": 3, "max_depth": 4})]


def test_the_best_candidate_is_refitted(spark, data):
    board = training.leaderboard(spark, "r1", [*RESULTS, CvResult(BOOSTING, [], status="failed: x")])
    read = winner.board_results(board, "r1")
    best = winner.best_result(read)
    assert (best.model, best.params) == (RIDGE, {"alpha": 0.25})
    assert training.best_model(board).first()["model"] == best.model
    made = winner.fit_winner(data, ["a", "b"], "y", read, "regression")
    direct = training.fit_model(selection.assembled(data, ["a", "b"], "y"), RIDGE, "regression", {"alpha": 0.25})
    assert made.pipeline.stages[1].coefficients.toArray() == pytest.approx(direct.coefficients.toArray())
    with pytest.raises(ValueError, match="no candidate"):
        winner.best_result([CvResult(LINEAR, [])])


def test_ties_go_to_single_models():
    assert winner.best_result([CvResult(STACK, [0.5]), CvResult(LOGISTIC, [0.5]), CvResult(FOREST, [0.5])]).model == LOGISTIC
    assert winner.best_result([CvResult(STACK, [0.6]), CvResult(LOGISTIC, [0.5])]).model == STACK


@pytest.mark.parametrize("problem", ["regression", "classification"])
def test_a_stack_is_saved_and_loaded_elsewhere(spark, data, tmp_path, problem):
    target, first = ("y", LINEAR) if problem == "regression" else ("kind", LOGISTIC)
    members = [CvResult(first, [0.1], {} if problem == "regression" else {"max_iter": 20}), CvResult(FOREST, [0.1], {"n_estimators": 3, "max_depth": 4})]
    made = winner.fit_winner(data, ["a", "b"], target, [*members, CvResult(STACK, [0.9], {"members": [m.model for m in members]})], problem)
    assert isinstance(made.pipeline.stages[1], training.StackedModel)
    made.save(spark, str(tmp_path), "r1")
    want = made.predict(data).orderBy("id").select("id", F.col("prediction").cast("string").alias("p"), F.round("confidence", 9).alias("c"))
    again = winner.Winner.load(spark, str(tmp_path), "r1")
    assert again.predict(data).orderBy("id").select("id", F.col("prediction").cast("string"), F.round("confidence", 9)).collect() == want.collect()
    assert again.names == made.names and again.candidate.params == made.candidate.params
    data.write.parquet(f"{tmp_path}/data")
    want.write.parquet(f"{tmp_path}/want")
    code = f"""
from tabloom.session import build_session
from tabloom.plans.winner import Winner
from pyspark.sql import functions as F
spark = build_session("other", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
got = Winner.load(spark, {str(tmp_path)!r}, "r1").predict(spark.read.parquet({f"{tmp_path}/data"!r})).select("id", F.col("prediction").cast("string").alias("p"), F.round("confidence", 9).alias("c"))
want = spark.read.parquet({f"{tmp_path}/want"!r})
assert got.exceptAll(want).count() == 0 and got.count() == 600
print("equal scores")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent), timeout=300)
    assert "equal scores" in done.stdout, done.stderr[-2000:]


def test_class_names_come_out(spark, data, tmp_path):
    made = winner.fit_winner(data, ["a", "b"], "kind", [CvResult(FOREST, [1.0], {"n_estimators": 20, "max_depth": 8})], "classification")
    assert made.names == ["high", "low", "mid"]
    got = made.predict(data.withColumn("class", F.lit("clash")).drop("class"))
    assert got.where(F.col("prediction") == F.col("kind")).count() > 570
    odd = spark.createDataFrame([(1.0, 2.0, 7), (5.0, 1.0, 3), (9.0, 9.0, None), (2.0, 2.0, 7), (5.0, 2.0, 3)], "a double, b double, code int")
    numbers = winner.fit_winner(odd, ["a", "b"], "code", [CvResult(FOREST, [1.0], {"n_estimators": 5, "max_depth": 3})], "classification")
    assert numbers.names == ["3", "7"] and {r["prediction"] for r in numbers.predict(odd).collect()} <= {"3", "7"}
    with pytest.raises(ValueError, match="more than 1000 classes"):
        winner.class_table(spark.range(0, 1500), "id")


def test_pipeline_with_a_stack_round_trips(spark, data, tmp_path):
    frame = selection.assembled(data, ["a", "b"], "y", ["fold"])
    stack = training.fit_stack(frame, [CvResult(LINEAR, []), CvResult(RIDGE, [], {"alpha": 1.0})], "regression")
    PipelineModel([stack]).write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert again.stages[0].uid == stack.uid and len(again.stages[0].bases) == 2
    assert again.transform(frame).agg(F.sum("prediction")).first()[0] == pytest.approx(stack.transform(frame).agg(F.sum("prediction")).first()[0])


def test_search_halves_and_keeps_the_deadline(data, monkeypatch):
    frame = training.training_frame(selection.assembled(data.where("fold < 2").coalesce(1), ["a", "b"], "y", ["fold"]))
    sizes = []
    real = training.cross_validate

    def scored(d, n, p, f=None, params=None, c=2):
        sizes.append((params or {}).get("n_estimators"))
        return real(d, n, p, f, params, c) if params else CvResult(n, [-1.0])

    monkeypatch.setattr(training, "cross_validate", scored)
    monkeypatch.setattr(training, "draw_params", lambda name, trials, seed=42: [{"n_estimators": 9, "max_depth": d} for d in (1, 2, 4, 5)][:trials])
    best = training.search_within(frame, FOREST, "regression", 4, 600)
    assert sorted(sizes) == [1, 1, 1, 1, 3, 3, 9] and best.tuned and best.params["n_estimators"] == 9 and best.params["max_depth"] >= 4
    assert best.status == "ok, 7 runs"
    start = time.monotonic()
    monkeypatch.setattr(training, "draw_params", lambda name, trials, seed=42: [{"n_estimators": 2000, "max_depth": 5}] * trials)
    cut = training.search_within(frame, BOOSTING, "regression", 3, 2, workers=1)
    assert time.monotonic() - start < 30 and not cut.tuned and cut.status == "ok, 0 runs, 3 cut by the deadline" and cut.scores == [-1.0]
    assert training.search_within(frame, FOREST, "regression", 3, 0).status == "ok, 0 runs, 3 cut by the deadline"
    frame.unpersist()


def test_failures_of_trials_are_recorded(data, monkeypatch):
    frame = selection.assembled(data, ["a", "b"], "y", ["fold"])
    monkeypatch.setattr(training, "draw_params", lambda *a: [{"alpha": "no number"}, {"alpha": 0.1}])
    best = training.search_within(frame, RIDGE, "regression", 2, 600)
    assert best.tuned and best.params == {"alpha": 0.1} and best.status.startswith("ok, 1 runs, 1 failed")
