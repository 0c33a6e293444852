import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabloom.functions.numeric import NumericConfig
from tabloom.functions.text import TextConfig
from tabloom.operators.vocab import CategoricalConfig
from tabloom.plans import engine

SCHEMA = "id bigint, size int, amount double, colour string, note string, day timestamp, y int"


def rows(n, colours=("red", "green", "blue")):
    start = datetime(2020, 1, 1)
    out = []
    for i in range(n):
        out.append((
            i, (i * 37) % 101, None if i % 10 == 0 else float((i * 7919) % 1000) + 0.5, None if i % 9 == 0 else colours[i % len(colours)],
            f"note {i} written by hand for test number {i}", None if i % 12 == 0 else start + timedelta(days=i, hours=i % 24), i % 2,
        ))
    return out


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(rows(200), SCHEMA)


@pytest.fixture(scope="module")
def model(train):
    config = engine.EngineConfig(
        keep=("id",), numeric=NumericConfig(enable_polynomial=True), type_hints={"colour": "categorical"}, interactions=(("size", "amount"), ("size", "none")),
        specs=({"name": "per size", "operation": "ratio", "inputs": ["amount", "size"]}, {"name": "bad", "operation": "log", "inputs": ["none"]}),
    )
    return engine.FeatureEngine(config, target="y").fit(train)


def test_output_columns_are_fixed_at_fit(spark, model, train):
    names = model.transform(train).columns
    assert names == ["id", "y", *model.feature_names]
    for n, colours in ((20, ("red", "pink")), (15, ("violet",)), (1, ("red",))):
        batch = spark.createDataFrame(rows(n, colours), SCHEMA)
        out = model.transform(batch)
        assert out.columns == names and out.count() == n
    assert model.transform(train.drop("y")).columns == [c for c in names if c != "y"]
    assert model.transform(train.drop("colour", "amount")).columns == names


def test_features_are_finite_and_complete(model, train):
    out = model.transform(train)
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in model.feature_names]
    assert all(v == 0 for v in out.agg(*bad).first())
    assert len(set(model.feature_names)) == len(model.feature_names)


def test_scaled_columns_have_mean_zero_where_nothing_is_missing(model, train):
    mean, std = model.transform(train).agg(F.avg("size_scaled"), F.stddev_pop("size_scaled")).first()
    assert abs(mean) < 1e-9 and abs(std - 1) < 1e-9


def test_flags_are_binary_and_bins_are_few(model, train):
    out = model.transform(train)
    for c in model.feature_names:
        if c.endswith(("_is_rare", "_was_missing", "_above_median", "_is_weekend", "_has_email")):
            assert {r[0] for r in out.select(c).distinct().collect()} <= {0.0, 1.0}, c
        if c.endswith("_bin"):
            assert out.select(c).distinct().count() <= 5


def test_unknown_values_and_nulls_have_codes_of_their_own(spark, model):
    batch = spark.createDataFrame([r for r in rows(40, ("red", "pink"))], SCHEMA)
    got = {
        (r["colour"], r["colour_encoded"], r["colour_frequency"])
        for r in batch.join(model.transform(batch).drop("y"), "id").select("colour", "colour_encoded", "colour_frequency").collect()
    }
    codes = {c: code for c, code, _ in got}
    assert codes["red"] == 2.0 and codes["pink"] == 3.0 and codes[None] == 4.0
    assert {f for c, _, f in got if c in ("pink", None)} == {0.0}


def test_interactions_and_formulas(model, train):
    assert {"size_x_amount", "per_size"} <= set(model.feature_names)
    assert "size_x_none" not in model.feature_names and model.spec_report["failed"][0]["name"] == "bad"
    row = train.where("id = 1").join(model.transform(train).drop("y"), "id").first()
    assert row["size_x_amount"] == pytest.approx(row["size"] * row["amount"])
    assert row["per_size"] == pytest.approx(row["amount"] / row["size"])


def test_a_batch_does_not_change_fitted_values(spark, model, train):
    one = train.where("id = 7")
    whole = model.transform(train).where("id = 7").first()
    assert model.transform(one).first() == whole


def test_infinite_and_broken_numbers_become_zero(spark):
    df = spark.createDataFrame([(1, 2.0, "3"), (2, float("inf"), "x"), (3, float("nan"), None)] * 20, "k int, a double, b string")
    fitted = engine.FeatureEngine(engine.EngineConfig(keep=("k",), type_hints={"a": "numerical", "b": "numerical"})).fit(df)
    out = fitted.transform(df)
    assert out.where("k = 2").first()["b_scaled"] == 0.0
    assert all(math.isfinite(v) for r in out.collect() for v in r)


def test_selected_features_only(model, train):
    small = model.select(["colour_encoded", "size_bin", "gone"])
    assert small.transform(train).columns == ["id", "y", "size_bin", "colour_encoded"]
    assert model.select(["gone"]).feature_names == model.feature_names
    plan = small.transform(train)._jdf.queryExecution().optimizedPlan().toString()
    assert "note" not in plan.split("LocalRelation")[0] or "regexp_count" not in plan


def test_empty_columns_leave_a_lineage_row(spark):
    df = spark.createDataFrame([(i, None, i * 1.5) for i in range(30)], "k int, nothing string, v double")
    fitted = engine.FeatureEngine(engine.EngineConfig(keep=("k",))).fit(df)
    lost = fitted.lineage(spark).where("feature IS NULL").collect()
    assert [(r["source"], r["processor"]) for r in lost] == [("nothing", "empty")]


def test_save_and_load(spark, model, train, tmp_path):
    model.save(str(tmp_path / "m"), spark)
    again = engine.FeatureModel.load(str(tmp_path / "m"), spark)
    assert again.feature_names == model.feature_names
    assert again.transform(train).orderBy("id").collect() == model.transform(train).orderBy("id").collect()


def test_many_categories_share_other(spark):
    df = spark.createDataFrame([(i, f"c{i % 80}") for i in range(800)], "k int, c string")
    hints = {"c": "categorical"}
    limited = engine.FeatureEngine(engine.EngineConfig(keep=("k",), type_hints=hints, categorical=CategoricalConfig(max_categories=10, limit_codes=True))).fit(df)
    out = limited.transform(df)
    assert out.select("c_encoded").distinct().count() == 10
    full = engine.FeatureEngine(
        engine.EngineConfig(keep=("k",), type_hints=hints, categorical=CategoricalConfig(max_categories=10, limit_codes=False), broadcast_bytes=0)
    ).fit(df)
    out = full.transform(df)
    assert out.count() == 800 and out.select("c_encoded").distinct().count() == 80
    assert out.where("c_frequency > 0").select("c_encoded").distinct().count() == 9


def test_target_encoding_is_out_of_fold_for_training_rows(spark, train):
    config = engine.EngineConfig(keep=("id",), type_hints={"colour": "categorical"}, categorical=CategoricalConfig(encoding_method="target"))
    fitted = engine.FeatureEngine(config, target="y").fit(train)
    plain = fitted.transform(train)
    inside = fitted.encode_out_of_fold(train, plain, "id", 5)
    assert inside.count() == 200 and sorted(inside.columns) == sorted(plain.columns)
    assert inside.where("colour_target BETWEEN 0 AND 1").count() == 200
    assert inside.join(plain.select("id", F.col("colour_target").alias("t")), "id").where("abs(t - colour_target) > 1e-12").count() > 0


def test_tfidf_columns(spark):
    df = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["the red cat sat down", "the blue cat ran away", "dogs ran home again", "a red dog was here", "cat and dog and cat"])],
        "k int, body string",
    )
    config = engine.EngineConfig(keep=("k",), type_hints={"body": "text"}, text=TextConfig(enable_tfidf=True, max_tfidf_features=5, stop_words=("the", "and")))
    fitted = engine.FeatureEngine(config).fit(df)
    names = [f"body_tfidf_{i}" for i in range(5)]
    assert set(names) <= set(fitted.feature_names)
    for r in fitted.transform(df).select(*names).collect():
        assert sum(v * v for v in r) == pytest.approx(1.0) or sum(v * v for v in r) == 0.0


def test_alignment_and_stacking(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    out = engine.align_test(a, ["x", "z"], ["k"])
    assert out.columns == ["k", "x", "z"] and tuple(out.first()) == (1, 2.0, 0.0)
    both = engine.stack_tables(a, a.drop("x"))
    left, right = engine.split_stacked(both)
    assert left.first()["x"] == 2.0 and right.first()["x"] is None


def test_a_real_value_named_other_keeps_the_rows(spark):
    df = spark.range(0, 600).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("OTHER")).otherwise(F.concat(F.lit("v"), (F.col("id") % 70).cast("string"))).alias("c"), (F.col("id") % 2).alias("y"))
    for limit in (True, False):
        config = engine.EngineConfig(keep=("id",), type_hints={"c": "categorical"}, categorical=CategoricalConfig(max_categories=10, limit_codes=limit))
        out = engine.FeatureEngine(config, target="y").fit(df).transform(df)
        assert out.count() == 600 and out.select("id").distinct().count() == 600
        real = out.join(df.select("id", "c"), "id").groupBy((F.col("c") == "OTHER").alias("real")).agg(F.collect_set("c_encoded").alias("codes")).collect()
        codes = {r["real"]: set(r["codes"]) for r in real}
        assert len(codes[True]) == 1 and not codes[True] & codes[False]


def test_target_means_of_the_tail_unseen_and_null_values(spark):
    rows = [(i, "big", 100.0) for i in range(40)] + [(100 + i, f"t{i}", 10.0 + i) for i in range(20)] + [(200 + i, None, 7.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, c string, y double")
    config = engine.EngineConfig(keep=("id",), type_hints={"c": "categorical"}, categorical=CategoricalConfig(encoding_method="target", max_categories=2, limit_codes=True))
    model = engine.FeatureEngine(config, target="y").fit(df)
    later = spark.createDataFrame([(1, "big"), (2, "t3"), (3, "never seen"), (4, None)], "id bigint, c string")
    got = {r["id"]: r["c_target"] for r in model.transform(later).collect()}
    assert got == {1: 100.0, 2: 19.5, 3: 19.5, 4: 7.0}


def test_correlations_count_complete_pairs(spark):
    import numpy as np

    from tabloom.operators.selection import correlation_matrix

    df = spark.range(0, 90).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("b"), F.lit(1.0).alias("flat"))
    m = correlation_matrix(df, ["a", "b", "flat"])
    assert abs(m[0, 1] - 1.0) < 1e-12 and np.isnan(m[0, 2]) and np.isnan(m[1, 2])
