"""Weighted cells and moments give what a fit on all rows gives."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.plans import cells as compact, selection, training
from tabloom.plans.training import BOOSTING, FOREST, LINEAR, RIDGE


@pytest.fixture(scope="module")
def data(spark):
    """Few values per feature, so that many rows share a cell; the label also varies inside cells."""
    i = F.col("id")
    df = spark.range(0, 3000).select((i % 7).cast("double").alias("a"), ((i * 31) % 11).cast("double").alias("b"), (i % 3).cast("int").alias("fold"), ((i * 7919) % 13).alias("n"))
    return df.withColumns({"y": F.col("a") * 3 + F.col("b") * F.col("a") / 10 + F.col("n") / 50, "c": ((F.col("a") > 3) & (F.col("n") > 2)).cast("int")}).cache()


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(compact, "LARGE_ROWS", 0)


def test_boosting_on_cells_equals_boosting_on_rows(data, large):
    params = {"n_estimators": 4, "max_depth": 3}
    for label, problem in (("y", "regression"), ("c", "classification")):
        frame = selection.assembled(data, ["a", "b"], label, ["fold"])
        with training.Trainer(frame, problem, large=10**9) as rows:
            plain = training.cross_validate(frame, BOOSTING, problem, params=params, trainer=rows)
        with training.Trainer(frame, problem) as trainer:
            got = training.cross_validate(frame, BOOSTING, problem, params=params, trainer=trainer)
            assert trainer.cells(BOOSTING).frame.count() <= 7 * 11 * 3 * 2
            model = trainer.fit(BOOSTING, params, (0,))
            raw = model.transform(frame.where("fold = 0")).agg(training.metric(problem)).first()[0]
        assert got.scores == pytest.approx(plain.scores, rel=1e-9)
        assert got.scores[0] == pytest.approx(raw, rel=1e-9)


def test_a_forest_on_cells_counts_rows(data, large, tmp_path):
    frame = selection.assembled(data, ["a", "b"], "y", ["fold"])
    scores = training.cross_validate(frame, FOREST, "regression", params={"n_estimators": 8, "max_depth": 6}).scores
    with training.Trainer(frame, "regression", large=10**9) as rows:
        plain = training.cross_validate(frame, FOREST, "regression", params={"n_estimators": 8, "max_depth": 6}, trainer=rows).scores
    assert scores == pytest.approx(plain, abs=1.0)
    # a leaf of 2,000 rows at least is no leaf of 2,000 cells: 3,000 rows can hold but one
    cells = compact.Cells.of(frame, True, 3000)
    wide = cells.fit(training.build_model(FOREST, "regression", {"n_estimators": 2, "min_samples_leaf": 900}))
    assert 3 <= wide.model.trees[0].numNodes <= 7
    wide.write().overwrite().save(f"{tmp_path}/m")
    again = compact.BinnedModel.load(f"{tmp_path}/m")
    assert again.transform(frame).select("prediction").collect() == wide.transform(frame).select("prediction").collect()
    assert "features" in again.transform(frame).columns


def test_least_squares_on_moments_equals_rows(spark, data, large):
    frame = selection.assembled(data.withColumn("tiny", F.col("n") * 1e-6 + F.col("a") * 1e-7).withColumn("same", F.lit(5.0)), ["a", "b", "tiny", "same"], "y", ["fold"])
    for name, params in ((LINEAR, None), (RIDGE, {"alpha": 50.0})):
        with training.Trainer(frame, "regression", large=10**9) as rows:
            plain = training.cross_validate(frame, name, "regression", params=params, trainer=rows)
            wanted = rows.fit(name, params, (1,))
        got = training.cross_validate(frame, name, "regression", params=params)
        assert got.scores == pytest.approx(plain.scores, rel=1e-6)
        with training.Trainer(frame, "regression") as trainer:
            made = trainer.fit(name, params, (1,))
        assert made.coefficients.toArray() == pytest.approx(wanted.coefficients.toArray(), rel=1e-6, abs=1e-9)
    members = [training.CvResult(LINEAR, []), training.CvResult(RIDGE, [], {"alpha": 1.0})]
    stacked = training.stack_scores(frame, members, "regression").scores
    compact.LARGE_ROWS = 10**9
    assert stacked == pytest.approx(training.stack_scores(frame, members, "regression").scores, rel=1e-5)


def test_missing_labels_are_refused(spark, large):
    frame = spark.createDataFrame([(float(i), None if i == 3 else 2.0 * i, i % 2) for i in range(8)], "a double, y double, fold int")
    with pytest.raises(ValueError, match="null"):
        training.cross_validate(selection.assembled(frame, ["a"], "y", ["fold"]), LINEAR, "regression")


def test_elimination_reads_a_large_table_once(spark, data, monkeypatch):
    wanted = selection.recursive_elimination(data, ["a", "b", "n"], "y", "regression", step=1)
    monkeypatch.setattr(compact, "LARGE_ROWS", 0)
    made = []
    monkeypatch.setattr(selection, "assembled", lambda *a, **k: made.append(a))
    assert selection.recursive_elimination(data, ["a", "b", "n"], "y", "regression", step=1) == wanted and not made


def test_a_search_prepares_once_for_all_trials(data, large, monkeypatch):
    frame, made, of = selection.assembled(data, ["a", "b"], "y", ["fold"]), [], compact.Cells.of
    monkeypatch.setattr(compact.Cells, "of", staticmethod(lambda *a: made.append(1) or of(*a)))
    monkeypatch.setitem(training.SEARCH_SPACES, BOOSTING, {"n_estimators": ("int", 2, 4), "max_depth": ("int", 2, 3)})
    best = training.search_within(frame, BOOSTING, "regression", 2, 600)
    assert best.tuned and len(best.scores) == 3 and len(made) == 1


def test_cells_are_packed_and_folds_share_them(spark, data, large):
    frame = selection.assembled(data.withColumn("kind", (F.col("n") % 3).cast("int")), ["a", "b"], "kind", ["fold"])
    with training.Trainer(frame, "classification", 3) as trainer:
        cells = trainer.cells(FOREST)
        assert [t for _, t in cells.stored.select("w0").dtypes] == ["bigint"] and cells.frame.count() > 7 * 11 * 3
        # a fit sees a cell once for a class, whatever the number of folds it lies in
        left = cells.without((0,))
        assert left.count() == data.where("fold <> 0").withColumn("kind", F.col("n") % 3).select("a", "b", "kind").distinct().count()
        assert left.agg(F.sum("weight")).first()[0] == data.where("fold <> 0").count()
        wanted = data.groupBy("a", "b", "fold", (F.col("n") % 3).cast("double").alias("label")).count()
        found = cells.frame.select(F.get(vector_to_array("features"), F.lit(0)).alias("a"), F.get(vector_to_array("features"), F.lit(1)).alias("b"), "fold", "label", F.col("weight").cast("bigint"))
        assert sorted(found.collect()) == sorted(wanted.collect())


def test_bins_by_lookup_equal_bins_by_cuts(spark):
    inf, nan = float("inf"), float("nan")
    cuts = [[-inf, -5e-324, 0.0, 1.0, 1.0000000000000002], [], [2.5], [1.0, inf]] + [[float(k) for k in range(31)]] * 20
    values = [-inf, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1.5, 2.5, 30.0, 31.0, inf, None]
    wide = spark.createDataFrame([(i, *[v] * len(cuts)) for i, v in enumerate(values)], "i int, " + ", ".join(f"x{k} double" for k in range(len(cuts))))
    binned, bins = compact._with_bins(wide, cuts)
    want = [tuple(r) for r in wide.select(*[compact._bin(F.coalesce(f"x{k}", F.lit(nan)), c) for k, c in enumerate(cuts)]).collect()]
    assert [tuple(r) for r in binned.orderBy("i").select(*bins).collect()][:-2] == want[:-2]
    packed = compact._packed(bins)
    made = compact.Cells(binned.select(*[w.alias(f"w{k}") for k, w in enumerate(packed)], F.lit(1).alias("weight")), cuts, 14, True)
    assert len(packed) == 2 and [tuple(int(x) for x in r["features"]) for r in made.frame.collect()] == [tuple(r) for r in binned.select(*bins).collect()]


def test_large_scans_for_trees_are_not_kept(spark, large, monkeypatch):
    i = F.col("id")
    rows = spark.range(0, 3000, 1, 8).select((i % 7).cast("double").alias("a"), (i % 5).cast("double").alias("b"), ((i % 7) > 3).cast("int").alias("c"), (i % 3).cast("int").alias("fold"))
    frame = selection.assembled(rows, ["a", "b"], "c", ["fold"])
    for names, kept in (([FOREST, BOOSTING], False), ([FOREST, RIDGE], True), (None, True)):
        held = training.training_frame(frame, names)
        assert (held.storageLevel.useMemory or held.storageLevel.useDisk) == kept
        held.unpersist()
    monkeypatch.setattr(compact, "LARGE_ROWS", 3000)
    held = training.training_frame(frame, [FOREST])
    assert held.storageLevel.useMemory
    held.unpersist()
    monkeypatch.setattr(compact, "LARGE_ROWS", 0)
    scores = training.cross_validate(training.training_frame(frame, [FOREST]), FOREST, "classification", 3, {"n_estimators": 3, "max_depth": 4}).scores
    assert scores == [1.0] * 3
