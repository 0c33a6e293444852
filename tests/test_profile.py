from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabloom.operators import domains, infer, profile


def types(df, **options):
    return {r["column"]: r["detected_type"] for r in infer.typed_profile(df, **options).collect()}


def test_small_integers_and_epochs(spark):
    start = datetime(2021, 1, 1)
    rows = [(i % 4, i + 1, int((start + timedelta(days=i)).timestamp()) + (i * i) % 5) for i in range(10)]
    got = types(spark.createDataFrame(rows, "num_reported_accidents int, small_sequence int, seen bigint"))
    assert got == {"num_reported_accidents": "numerical", "small_sequence": "numerical", "seen": "datetime"}


def test_ids(spark):
    rows = [(i + 1, i + 100, f"AB{i:06d}") for i in range(30)]
    got = types(spark.createDataFrame(rows, "record_sequence int, record_id int, code string"))
    assert got["record_id"] == "id" and got["code"] == "id" and got["record_sequence"] == "id"
    few = types(spark.createDataFrame(rows[:10], "record_sequence int, record_id int, code string"))
    assert few["record_sequence"] == "numerical"  # ten numbers in a small range are amounts, not ids


def test_overrides(spark):
    rows = [("yes" if i % 2 else "no", 30 + 10 * (i % 4), i % 4) for i in range(20)]
    df = spark.createDataFrame(rows, "holiday string, speed_limit int, num_lanes int")
    hints = {"holiday": "categorical", "speed_limit": "numerical", "num_lanes": "text", "absent": "id", "speed": "unknown"}
    out = {r["column"]: r for r in infer.typed_profile(df, overrides=hints).collect()}
    assert out["num_lanes"]["detected_type"] == "text"
    assert "manual_override" in out["num_lanes"]["patterns"] and out["num_lanes"]["confidence"] == 1.0
    assert set(out) == {"holiday", "speed_limit", "num_lanes"}


def test_names_are_matched_on_tokens_unless_compat(spark):
    df = spark.createDataFrame([(float(i) * 1.7 + (i % 3),) for i in range(50)], "width double")
    assert types(df) == {"width": "numerical"}
    assert types(df, compat=True) == {"width": "id"}  # 'width' contains 'id'


def test_empty_one_row_constant_and_null_columns(spark):
    schema = "a int, b string, c double, e boolean, t timestamp"
    empty = spark.createDataFrame([], schema)
    assert set(types(empty).values()) == {"empty"}
    assert profile.missing_cells(empty).first()["missing_percentage"] == 0.0
    assert profile.duplicate_rows(empty).first()[0] == 0
    one = spark.createDataFrame([(1, "x", 1.0, True, datetime(2020, 1, 1))], schema)
    assert set(types(one)) == {"a", "b", "c", "e", "t"}
    constant = spark.createDataFrame([(5, "x", 2.5, None, None)] * 30, schema)
    assert types(constant) == {"a": "categorical", "b": "categorical", "c": "categorical", "e": "empty", "t": "empty"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    row = profile.null_counts(df).first()
    assert (row["nulls"], row["n"]) == (2, 3)
    assert profile.distinct_stats(df).first()["distinct"] == 1


def test_duplicates_with_long_texts(spark):
    long = "word " * 100
    df = spark.createDataFrame([(long,), (long,), (long + "x",), (None,), (None,)], "t string")
    assert profile.duplicate_rows(df).first()[0] == 2


def test_sequential_needs_equal_steps(spark):
    rows = [(i, i * 7 + 3, i * i, 5) for i in range(20)]
    got = {r["column"]: r["sequential"] for r in profile.equal_steps(spark.createDataFrame(rows, "a int, b int, c int, d int")).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_close_fractions_are_ids_only_in_compat(spark):
    df = spark.createDataFrame([(i * 0.013 + (i % 7) * 0.0001,) for i in range(200)], "reading double")
    assert types(df) == {"reading": "numerical"}
    assert types(df, compat=True) == {"reading": "id"}


def test_auto_distinct_gives_the_same_types(spark, sf):
    for name in ("orders", "customer", "part", "documents", "lineitem"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        assert types(df, exact_distinct="auto") == types(df), name


@pytest.mark.parametrize("n,expected", [(20, "classification"), (21, "regression")])
def test_problem_type_of_fractions(spark, n, expected):
    df = spark.createDataFrame([((i % n) / 19.0,) for i in range(100)], "y double")
    assert infer.problem_type(df, "y").first()["problem_type"] == expected


def test_target_from_schemas(spark):
    train = spark.createDataFrame([(1, 2, 3)], "id int, survived int, age int")
    assert infer.target_from_schemas(train, train.select("age")) == "survived"
    assert infer.target_from_schemas(train, train) is None


def test_domains(spark):
    catalog = spark.createDataFrame(
        [("t", "price"), ("t", "loan_amount"), ("h", "age"), ("h", "body_weight"), ("x", "zzz")], "table string, column string"
    )
    scores = {(r["table"], r["domain"]): r["score"] for r in domains.domain_scores(catalog).collect()}
    # price 2+1, loan 2, amount 2+1
    assert scores[("t", "finance")] == 8
    assert scores[("h", "healthcare")] == 6
    assert not any(t == "x" for t, _ in scores)
    advice = {(r["table"], r["message"]) for r in domains.domain_advice(catalog).collect()}
    assert ("h", "Weight over squared height gives the body mass index") in advice
    groups = {(r["column"], r["semantic_group"]) for r in domains.semantic_groups(catalog).collect()}
    assert ("body_weight", "measurements") in groups


def test_table_catalog(spark):
    df = spark.createDataFrame([(1, 2)], "a int, order_date int")
    cat = domains.table_catalog({"t": df}).withColumn("detected_type", F.lit("datetime"))
    assert {r["domain"] for r in domains.rank_domains(cat).collect()} >= {"time_series", "ecommerce"}


def test_wide_tables_are_profiled_in_batches(spark, monkeypatch):
    df = spark.range(0, 50).select(*[(F.col("id") * (i + 1) + i).alias(f"c{i}") for i in range(12)])
    whole = profile.profile_rows(df)
    monkeypatch.setattr(profile, "WIDE_BATCH", 5)
    monkeypatch.setattr(profile, "DISTINCT_BATCH", 5)
    assert profile.profile_rows(df) == whole and len(whole) == 12
