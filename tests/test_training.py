import pytest
from pyspark.sql import functions as F

from tabloom.operators import output, selection as ops, target
from tabloom.plans import engine, scoring, selection, training
from tabloom.sources import readers, shaping, writers


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(0, 400).select(
        F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("a"), ((F.col("id") * 7919) % 101).cast("double").alias("b"),
        (F.col("id") % 5).cast("int").alias("fold"),
    ).withColumns({"y": F.col("a") * 3 + F.col("b") / 10, "c": (F.col("a") > 8).cast("int")})
    return df.cache()


def test_overrides_are_clamped(spark):
    rows = [("Gradient Boosting", "max_depth", 25.0), ("Gradient Boosting", "learning_rate", 1e-6), ("Random Forest", "n_estimators", 150.4),
            ("Linear Regression", "fit_intercept", 0.0), ("Random Forest", "colour", 1.0), ("Nobody", "max_depth", 1.0)]
    got = {(r["model"], r["parameter"]): r["clamped"] for r in training.clamp_overrides(spark.createDataFrame(rows, "model string, parameter string, value double")).collect()}
    assert got == {
        ("Gradient Boosting", "max_depth"): 12.0, ("Gradient Boosting", "learning_rate"): 0.01,
        ("Random Forest", "n_estimators"): 150.0, ("Linear Regression", "fit_intercept"): 0.0,
    }


def test_candidate_order():
    names = ["Logistic", "Forest", "Boosting", "Linear"]
    order, tune = training.candidate_order(names, ["Boosting", "Forest"], ["Logistic"], ["Forest", "Linear"])
    assert order == ["Boosting", "Forest", "Linear"] and tune == ["Forest"]
    assert training.candidate_order(names, [], names, ["Forest"]) == (names, ["Forest"])


@pytest.mark.parametrize("rows,trials", [(100, 25), (2001, 40), (6000, 100), (10**9, 100)])
def test_search_budget(rows, trials):
    budget = training.search_budget(rows)
    assert budget.trials == trials


def test_cross_validation_of_a_linear_target(data):
    frame = selection.assembled(data, ["a", "b"], "y", ["fold"])
    result = training.cross_validate(frame, training.LINEAR, "regression")
    assert len(result.scores) == 5 and result.mean == pytest.approx(0.0, abs=1e-6) and result.std >= 0


def test_ridge_equals_the_closed_form(spark, data):
    import numpy as np

    frame = selection.assembled(data, ["a", "b"], "y")
    # one standard deviation each, so that the penalty means the same on both sides
    pdf = data.select("a", "b", "y").toPandas()
    x = (pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=1)
    want = np.linalg.solve(x.T @ x + 50.0 * np.eye(2), x.T @ (pdf["y"] - pdf["y"].mean()))
    model = training.fit_model(frame, training.RIDGE, "regression", {"alpha": 50.0})
    got = model.coefficients.toArray() * pdf[["a", "b"]].std(ddof=1).to_numpy()
    assert got == pytest.approx(want, rel=1e-2)


def test_candidates_run_concurrently_and_failures_are_recorded(spark, data):
    frame = selection.assembled(data, ["a", "b"], "c", ["fold"])
    results = training.run_candidates(frame, [training.LOGISTIC, "Nothing", training.FOREST], "classification",
                                      params={training.FOREST: {"n_estimators": 3, "max_depth": 3}, training.LOGISTIC: {"max_iter": 20}})
    board = training.leaderboard(spark, "r", results)
    rows = {r["model"]: r for r in board.collect()}
    assert rows["Nothing"]["status"].startswith("failed") and rows["Nothing"]["mean"] is None
    assert rows[training.FOREST]["mean"] > 0.9
    assert training.best_model(board).first()["model"] in (training.LOGISTIC, training.FOREST)


def test_a_stack_must_be_strictly_better(spark):
    rows = [("r", training.STACK, 0.9), ("r", "Ridge", 0.9), ("s", training.STACK, 0.91), ("s", "Ridge", 0.9)]
    board = spark.createDataFrame(rows, "run_id string, model string, mean double")
    assert {r["run_id"]: r["model"] for r in training.best_model(board).collect()} == {"r": "Ridge", "s": training.STACK}


def test_search_is_repeatable(data):
    assert training.draw_params(training.FOREST, 5) == training.draw_params(training.FOREST, 5)
    frame = selection.assembled(data, ["a", "b"], "y", ["fold"])
    seen = []
    best = training.search(frame, training.RIDGE, "regression", 3, on_trial=lambda *t: seen.append(t))
    assert best.tuned and len(seen) == 3 and best.mean == max(t[2] for t in seen)


def test_stack_uses_out_of_fold_predictions(data):
    frame = selection.assembled(data, ["a", "b"], "c", ["fold"])
    members = [training.CvResult(training.LOGISTIC, [], {"max_iter": 20}), training.CvResult(training.FOREST, [], {"n_estimators": 3, "max_depth": 3})]
    oof = training.out_of_fold(frame, members, "classification", 2)
    assert oof.count() == 400 and {"m0_1", "m1_1"} <= set(oof.columns)
    model = training.fit_stack(frame, members, "classification")
    assert model.transform(frame).agg(training.metric("classification")).first()[0] > 0.95
    assert len(training.stack_scores(frame, members, "classification").scores) == 5


def test_selection_steps_and_cap(spark, data):
    df = data.withColumns({"flat": F.lit(1.0), "twin": F.col("a") * 2, "noise": F.rand(1)})
    result = selection.select_features(df, ["a", "b", "flat", "twin", "noise"], "c", selection.SelectionConfig(max_features=2))
    assert len(result.selected) == 2 and "a" in result.selected and "flat" not in result.selected
    steps = {r["step"]: (r["before"], r["after"]) for r in result.steps.collect()}
    assert steps["variance_filter"] == (5, 4) and steps["correlation_filter"] == (4, 3)


def test_elimination_keeps_the_informative_feature(data):
    df = data.withColumn("noise", F.rand(3))
    kept = selection.recursive_elimination(df, ["a", "noise", "b"], "y", "regression", folds=2, step=1)
    assert {"a", "b"} <= set(kept)


@pytest.mark.parametrize("lists,union,vote,best", [([["f1", "f2", "f3"], ["f3", "f4"], ["f2", "f3", "f4", "f5"]], 5, {"f2", "f3", "f4"}, 4)])
def test_combinations(spark, lists, union, vote, best):
    rows = [(f"m{i}", f, int(f[1])) for i, fs in enumerate(lists) for f in fs]
    picks = spark.createDataFrame(rows, "method string, feature string, position int")
    assert ops.combine_union(picks).count() == union
    assert {r["feature"] for r in ops.combine_vote(picks, 3).collect()} == vote
    assert ops.combine_best(picks).count() == best


@pytest.mark.parametrize("values,expected", [
    ([0, 1, 1], "binary"), ([0.2, 0.5, 0.9], "probability"), ([0.5, 0.5], "probability"), (["a", "b"], "categorical"),
    ([1, 2, 3], "categorical"), ([float(i) * 3.7 for i in range(30)], "continuous"),
])
def test_value_types(spark, values, expected):
    kind = "string" if isinstance(values[0], str) else "double" if isinstance(values[0], float) else "int"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id int, answer {kind}")
    assert output.detect_format(df) == output.OutputFormat("row_id", "answer", expected)


def test_format_without_the_id_column(spark):
    df = spark.createDataFrame([(7, 1.0)], "key int, p double")
    assert output.format_predictions(df, output.OutputFormat("id", "t", "binary"), F.col("p")).collect()[0].asDict() == {"id": 7, "t": 1}
    assert output.fallback_format(["a", "PassengerId"]).id_column == "PassengerId"


def test_target_transform_round_trip(spark):
    df = spark.createDataFrame([(i / 100.0 + 0.001,) for i in range(60)], "y double")
    fitted = target.fit_target(df, "y")
    assert fitted.applied
    back = target.apply_target(df, "y", fitted, "z").select("y", target.inverse_logit(F.col("z")).alias("w"))
    assert all(abs(r["y"] - r["w"]) < 1e-9 for r in back.collect())
    assert target.fit_target(spark.createDataFrame([(i % 2,) for i in range(50)], "y int"), "y").reason == "classification_like_target"
    assert target.fit_target(spark.createDataFrame([(float(i * i),) for i in range(50)], "y double"), "y").reason == "unbounded_target"


def test_scorer_end_to_end(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    features = engine.FeatureEngine(engine.EngineConfig(keep=("o_orderkey",)), target="o_orderstatus").fit(o)
    frame = selection.assembled(features.transform(o), features.feature_names, "o_orderstatus")
    model = training.build_model(training.FOREST, "classification", {"n_estimators": 3, "max_depth": 3}).fit(frame)
    scorer = scoring.Scorer(features, model)
    scorer.save(str(tmp_path), "r1", spark)
    scoring.register_run(spark, str(tmp_path), "r1", "forest")
    scoring.register_run(spark, str(tmp_path), "r2", "forest")
    assert scoring.latest_run(spark, str(tmp_path)) == "r2"
    again = scoring.Scorer.load(str(tmp_path), "r1", spark)
    assert again.score(o).orderBy("o_orderkey").collect() == scorer.score(o).orderBy("o_orderkey").collect()


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id int, name string, target double")
    for name, part in (("train", df), ("test", df.drop("target"))):
        part.write.option("header", True).csv(str(tmp_path / name))
    train, test = readers.load_pair(spark, str(tmp_path / "train"), str(tmp_path / "test"))
    assert train.columns == ["id", "name", "target"] and test.schema["id"] == train.schema["id"]
    assert readers.scan_source(spark, readers.SourceConfig("csv", str(tmp_path / "train"), where="id = 2", limit=1)).count() == 1
    writers.write_report({"status": "ok", "n": 3}, str(tmp_path / "report"), spark)
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    assert readers.jdbc_options(readers.SourceConfig("postgresql", url="jdbc:x", query="SELECT 1"))["dbtable"] == "(SELECT 1) q"
    assert readers.jdbc_options(readers.SourceConfig("sql", url="jdbc:x", table="t", schema_name="s", partition_column="id",
                                                     lower_bound=0, upper_bound=9, num_partitions=3))["numPartitions"] == "3"
    with pytest.raises(ValueError):
        readers.jdbc_options(readers.SourceConfig("mysql"))
    with pytest.raises(ValueError):
        shaping.require_columns(df, ["zz"])


def test_ingest(spark):
    df = spark.createDataFrame([(1, "5", 1.0), (1, "5", 1.0), (2, "x", 3.0), (3, "7", None)], "k int, code string, v double")
    good, bad = shaping.ingest(df, shaping.IngestConfig(drop_duplicates=True, missing_strategy="auto", column_types={"code": "int"}, rename_columns={"v": "w"}))
    assert sorted(tuple(r) for r in good.collect()) == [(1, 5, 1.0), (3, 7, 1.0)]
    assert [r["code"] for r in bad.collect()] == ["x"]


def test_stratified_split_keeps_shares(spark):
    df = spark.range(0, 1000).select("id", F.when(F.col("id") % 20 == 0, "rare").otherwise("common").alias("c"))
    got = {(r["c"], r["is_test"]): r["count"] for r in shaping.split_stratified(df, "id", "c", 0.2).groupBy("c", "is_test").count().collect()}
    assert got[("rare", True)] == 10 and got[("common", True)] == 190


def test_folds_come_from_the_data(data):
    frame = selection.assembled(data, ["a", "b"], "y", ["fold"])
    with pytest.raises(ValueError, match="3 folds expected, the data has 5"):
        training.cross_validate(frame, training.LINEAR, "regression", 3)
    with pytest.raises(ValueError, match="every row needs"):
        training.cross_validate(frame.withColumn("fold", F.when(F.col("fold") > 0, F.col("fold"))), training.LINEAR, "regression")


def test_failed_trials_are_reported(data, monkeypatch):
    frame = selection.assembled(data, ["a", "b"], "y", ["fold"])
    monkeypatch.setattr(training, "draw_params", lambda *a: [{"alpha": "no number"}, {"alpha": 0.1}])
    best = training.search(frame, training.RIDGE, "regression", 2)
    assert best.tuned and best.params == {"alpha": 0.1} and best.status.startswith("ok, 1 of 2 trials failed")
    with pytest.raises(ValueError, match="at most 30 levels"):
        training.build_model(training.FOREST, "regression", {"max_depth": 31})


def test_newest_run_is_the_last_registered(spark, tmp_path):
    from tabloom.plans import scoring

    for run in ("r9", "r10"):
        scoring.register_run(spark, str(tmp_path), run, "model")
    assert scoring.latest_run(spark, str(tmp_path)) == "r10"
