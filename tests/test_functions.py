import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.functions import derived, numeric, temporal, text


def values(spark, column, rows, schema="x double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_equal_width_edges_lower_the_first_edge():
    edges = numeric.equal_width_edges(0.0, 10.0, 100, 5)
    assert edges == pytest.approx([-0.01, 2.0, 4.0, 6.0, 8.0, 10.0])


def test_equal_width_edges_of_a_constant_are_widened():
    assert numeric.equal_width_edges(5.0, 5.0, 1, 5) == pytest.approx([4.995, 5.0, 5.005])
    assert numeric.equal_width_edges(0.0, 0.0, 1, 5) == pytest.approx([-0.001, 0.0, 0.001])


def test_bins_are_right_closed_and_clamped(spark):
    edges = tuple(numeric.equal_width_edges(0.0, 10.0, 100, 5))
    rows = [(v,) for v in (0.0, 2.0, 2.1, 10.0, 11.0, -5.0)]
    assert values(spark, numeric.bin_index(F.col("x"), edges), rows) == [0, 0, 1, 4, 4, 0]
    assert values(spark, numeric.bin_index(F.col("x"), edges, clamp=False), rows) == [0, 0, 1, 4, 0, 0]


def test_binning_needs_two_bins():
    assert numeric.usable_edges([1.0, 1.0, 2.0]) == ()
    assert numeric.usable_edges([1.0, 2.0, 3.0]) == (1.0, 2.0, 3.0)


def test_to_numeric_takes_out_text_nan_and_infinity(spark):
    rows = [("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)]
    assert values(spark, numeric.to_numeric(F.col("x")), rows, "x string") == [1.5, None, None, None, None]


def test_standard_score_of_a_constant_is_zero(spark):
    assert values(spark, numeric.scale_standard(F.col("x"), 3.0, 0.0), [(3.0,)]) == [0.0]


def test_numeric_feature_names_depend_on_the_fit_only():
    params = numeric.NumericParams("a", 1.0, 1.0, 1.0, 1.0, 2.0, True, True, (0.0, 1.0, 2.0))
    config = numeric.NumericConfig(enable_polynomial=True, polynomial_degree=3)
    names = ["a_scaled", "a_bin", "a_log", "a_squared", "a_cubed", "a_above_median", "a_was_missing"]
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession() is not None
    assert list(numeric.numeric_features(params, config)) == names


def test_text_counts(spark):
    rows = [("Hello World 42!",), ("",), ("日本 café \U0001f600",)]
    df = spark.createDataFrame(rows, "x string")
    out = df.select(
        text.char_length(F.col("x")), text.word_count(F.col("x")), text.uppercase_ratio(F.col("x")), text.digit_count(F.col("x")),
        text.special_char_count(F.col("x")),
    ).collect()
    assert tuple(out[0]) == (15, 3, 2 / 15, 2, 1)
    assert tuple(out[1]) == (0, 0, 0.0, 0, 0)
    assert tuple(out[2]) == (9, 3, 0.0, 0, 4)


@pytest.mark.parametrize(
    "check,hit,miss",
    [
        (text.has_email, "write to a.b@example.org now", "a@b"),
        (text.has_url, "see https://example.org/x", "example.org"),
        (text.has_phone, "call 555-123-4567", "call 5551234"),
        (text.has_title, "Dr. Who", "Drive"),
    ],
)
def test_text_flags(spark, check, hit, miss):
    assert values(spark, check(F.col("x")), [(hit,), (miss,)], "x string") == [1, 0]


def test_ngrams_follow_stop_word_removal(spark):
    df = spark.createDataFrame([("The cat and the Dog",), ("a",), ("",)], "x string").select(text.words(F.col("x"), ["the", "and"]).alias("w"))
    grams = [r[0] for r in df.select(text.ngrams(F.col("w"), (1, 2))).collect()]
    assert grams == [["cat", "dog", "cat dog"], [], []]
    assert df.select(text.ngrams(F.col("w"), (1, 3))).first()[0] == ["cat", "dog", "cat dog"]


def test_dates_of_all_shapes_parse(spark):
    rows = [("2020-02-29",), ("2020-02-29 01:02:03",), ("2020-02-29T01:02:03",), ("02/29/2020",), ("20200229",), ("2021-02-29",), ("soon",)]
    got = values(spark, F.date_format(temporal.parse_text(F.col("x")), "yyyy-MM-dd"), rows, "x string")
    assert got == ["2020-02-29"] * 5 + [None, None]


def test_fractions_zones_minutes_and_month_names(spark):
    cases = {
        "2020-02-29T01:02:03.5": "2020-02-29 01:02:03.500000", "2020-02-29 01:02:03.123456789": "2020-02-29 01:02:03.123456", "2020-02-29T01:02:03Z": "2020-02-29 01:02:03.000000",
        "2020-02-29T01:02:03.25+02:30": "2020-02-28 22:32:03.250000", "2020-02-29 01:02:03 -0800": "2020-02-29 09:02:03.000000", "2020-02-29 01:02": "2020-02-29 01:02:00.000000",
        "02/29/2020 13:45": "2020-02-29 13:45:00.000000", "2/9/2020 1:05 PM": "2020-02-09 13:05:00.000000", "12/31/1999 12:00:01 am": "1999-12-31 00:00:01.000000", "29 Feb 2020": "2020-02-29 00:00:00.000000",
        "29-FEB-2020": "2020-02-29 00:00:00.000000", "February 29, 2020": "2020-02-29 00:00:00.000000", "Sept 3, 2021 10:00": "2021-09-03 10:00:00.000000", "may 5 2021": "2021-05-05 00:00:00.000000",
        "2020/02/29 05:06:07": "2020-02-29 05:06:07.000000", "2020.2.9": "2020-02-09 00:00:00.000000", "25/12/2020": "2020-12-25 00:00:00.000000", "03.04.2020": "2020-03-04 00:00:00.000000", " 2020-01-02 ": "2020-01-02 00:00:00.000000",
        "2020-01/02": None, "31 Feb 2020": None, "13/13/2020": None, "2020-02-29 25:00": None, "2020-02-29 01:02:03 Mars": None, "march of 2020": None, "1.2.3": None, "20201301": None, "12/31/1999 13:00 pm": None, "": None,
    }
    got = values(spark, F.date_format(temporal.parse_text(F.col("x")), "yyyy-MM-dd HH:mm:ss.SSSSSS"), [(c,) for c in cases], "x string")
    assert dict(zip(cases, got)) == cases
    swapped = values(spark, F.date_format(temporal.parse_text(F.col("x"), True), "yyyy-MM-dd"), [("03.04.2020",), ("12/25/2020",), ("2020-03-04",)], "x string")
    assert swapped == ["2020-04-03", "2020-12-25", "2020-03-04"]
    assert values(spark, temporal.date_shape(F.col("x")), [("29 Feb 2020",), ("may 5 2021 10:00",), ("2020-01-01",), ("1/2/2020",), ("20200101",), ("x",), (None,)], "x string") == ["day_name", "name_day", "iso", "numeric", "compact", None, None]


@pytest.mark.parametrize("unit,value", [("s", 1577836800), ("ms", 1577836800000), ("us", 1577836800000000), ("ns", 1577836800000000000)])
def test_epochs_of_all_units_parse(spark, unit, value):
    assert values(spark, F.year(temporal.parse(F.col("x"), "epoch", unit)), [(value,)], "x bigint") == [2020]


def test_edge_dates(spark):
    rows = [(datetime(1900, 1, 1),), (datetime(2099, 12, 31),), (datetime(2000, 2, 29),), (datetime(2020, 4, 1),), (None,)]
    parts = temporal.boundaries(F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "x timestamp").select(*parts.values()).collect()]
    # weekend, month start, month end, quarter start, year start
    assert got == [(0, 1, 0, 1, 1), (0, 0, 1, 0, 0), (0, 0, 1, 0, 0), (0, 1, 0, 1, 0), (0, 0, 0, 0, 0)]


def test_cyclical_values_stay_in_range(spark):
    df = spark.range(0, 400).select(F.timestamp_seconds(F.col("id") * 7919).alias("x"))
    for name, col in temporal.cyclical(F.col("x")).items():
        low, high = df.agg(F.min(col), F.max(col)).first()
        assert -1.0 <= low <= high <= 1.0, name


def test_ratio_and_zero_denominator(spark):
    df = spark.createDataFrame([(10.0, 2.0), (1.0, 0.0)], "a double, b double")
    spec = derived.feature_spec({"name": "ratio ab", "operation": "Ratio", "inputs": ["a", "b"]})
    assert spec.name == "ratio_ab"
    assert [r[0] for r in df.select(derived.spec_column(spec)).collect()] == [5.0, 1.0 / 1e-6]


def test_log_of_zero_and_negative(spark):
    got = values(spark, derived.log_abs(F.col("x")), [(0.0,), (-math.e,)])
    assert got == pytest.approx([math.log(1e-6), 1.0])


@pytest.mark.parametrize(
    "raw",
    [
        "text", {}, {"name": "a", "operation": "power", "inputs": ["x"]}, {"name": "a", "operation": "ratio", "inputs": ["x"]},
        {"name": "a", "operation": "log", "inputs": ["x", "y"]}, {"name": "a", "operation": "sum", "inputs": ["x"]},
        {"name": "a", "operation": "binary_threshold", "inputs": ["x"]}, {"name": "a", "operation": "log", "inputs": []},
        {"name": "a", "operation": "binary_threshold", "inputs": ["x"], "parameters": {"threshold": "high"}},
    ],
)
def test_bad_specs_are_refused(raw):
    with pytest.raises(ValueError):
        derived.feature_spec(raw)


def test_unique_names():
    assert derived.unique_name("a", {"b"}) == "a"
    assert derived.unique_name("a", {"a", "a_2"}) == "a_3"


def test_apply_specs_reports_failures(spark):
    train = spark.createDataFrame([(10.0, 2.0), (20.0, 4.0)], "a double, b double")
    specs = [{"name": "ratio_ab", "operation": "ratio", "inputs": ["a", "b"]}, {"name": "bad", "operation": "log", "inputs": ["zz"]}]
    out, test, summary = derived.apply_specs(train, train, specs)
    assert [r["ratio_ab"] for r in out.collect()] == [5.0, 5.0]
    assert test.columns == out.columns
    assert (summary["successful"], len(summary["failed_features"])) == (1, 1)
    assert "zz" in summary["failed_features"][0]["reason"]
