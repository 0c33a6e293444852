"""The paths taken beyond a size bound must give what the plain paths give, also when one key holds a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tabloom.functions.hashing import hash32
from tabloom.operators import infer, ordered, quantiles, selection as ops, vocab
from tabloom.operators.profile import gap_stats
from tabloom.operators.quantiles import exact_quantiles, hash_cutoffs
from tabloom.plans import selection


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows belong to key 0 and carry one value; scores repeat."""
    return spark.range(0, 9000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 50).alias("k"), (hash32("id") % 1000).cast("double").alias("v"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 700).cast("string"))).alias("word"),
    )


@pytest.mark.parametrize("direct_rows", [10, 100, 1_000_000])
def test_quantiles_equal_numpy(skewed, direct_rows):
    data = skewed.select("v", (F.col("v") * F.col("id")).alias("w"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    got = exact_quantiles(data, {"v": F.col("v"), "w": F.col("w")}, probs, direct_rows)
    frame = data.toPandas()
    for c in ("v", "w"):
        assert got[c] == pytest.approx(np.quantile(frame[c], probs))


def test_quantile_batches_stay_within_the_bound():
    from tabloom.operators.quantiles import _bounded

    assert _bounded([0, 1, 2, 3], [5, 5, 9, 1], 10) == [[0, 1], [2, 3]]
    assert _bounded([], [], 10) == []


def test_quantiles_with_one_hot_value(spark):
    data = spark.range(0, 3001).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = exact_quantiles(data, {"x": F.col("x")}, [0.2, 0.5], direct_rows=20)["x"]
    assert got == pytest.approx(np.quantile(data.toPandas()["x"], [0.2, 0.5]))


def test_quantile_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), {"x": F.col("x")}, [0.5]) == {"x": None}


def test_hash_cutoffs_equal_a_sort(skewed):
    got = {(r["grp"], r["share"]): r["cutoff"] for r in hash_cutoffs(skewed, F.col("k"), hash32("id"), [0.2, 0.5]).collect()}
    frame = skewed.select("k", hash32("id").alias("h")).toPandas()
    for k, part in frame.groupby("k"):
        hs = np.sort(part["h"].to_numpy())
        for share in (0.2, 0.5):
            assert got[(k, share)] == hs[int(np.ceil(round(share * len(hs), 6))) - 1]


@pytest.mark.parametrize("chunks", [2, 7])
def test_split_windows_equal_plain_windows(skewed, chunks):
    order = ["v", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    want = skewed.select(
        "id", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.row_number().over(w).alias("n"), F.lag("word").over(w).alias("p"),
    ).orderBy("id").collect()
    made = {
        "m": ordered.running_max(skewed, ["k"], order, "v", "o", 0, chunks), "s": ordered.running_sum(skewed, ["k"], order, "v", "o", 0, chunks),
        "n": ordered.row_number(skewed, ["k"], order, "o", 0, chunks), "p": ordered.previous(skewed, ["k"], order, "word", "o", 0, chunks),
    }
    for name, df in made.items():
        assert [r["o"] for r in df.orderBy("id").collect()] == [r[name] for r in want], name


def test_no_chunk_holds_a_hot_key(skewed):
    sizes = ordered.chunked(skewed, ["k"], ["v", "id"], 6).groupBy(ordered.CHUNK).count().collect()
    assert max(r["count"] for r in sizes) < 9000 / 3


def test_bound_decides_the_path(skewed):
    assert ordered.largest_group(skewed, ["k"]) == 3000
    plain = ordered.row_number(skewed, ["k"], ["id"], "o", bound=3000)
    assert "__chunk" not in plain.columns


def test_hot_split_join_equals_broadcast_join(skewed):
    words = vocab.label_codes(vocab.value_counts(skewed, ["word"]))
    with_null = skewed.withColumn("word", F.when(F.col("id") % 10 != 1, F.col("word")))
    sides = [
        vocab.join_vocabulary(with_null, words, "word", F.col("word"), ["code", "cnt"], "v_", 1, broadcast_bytes=limit)
        .orderBy("id").select("id", "v_code", "v_cnt").collect()
        for limit in (1 << 20, 0)
    ]
    assert sides[0] == sides[1]


def test_hot_rows_are_spread_before_the_shuffle_join(skewed):
    words = vocab.label_codes(vocab.value_counts(skewed, ["word"]))
    joined = vocab.join_vocabulary(skewed, words, "word", F.col("word"), ["code"], "v_", 1, broadcast_bytes=0)
    assert joined.count() == 9000
    assert joined.where("word = 'hot'").select("v_code").distinct().count() == 1


def test_label_codes_by_range(skewed):
    counts = vocab.value_counts(skewed, ["word"])
    plain = {r["value"]: r["code"] for r in vocab.label_codes(counts).collect()}
    split = {r["value"]: r["code"] for r in vocab.label_codes(counts, bound=0, chunks=5).collect()}
    assert plain == split == {v: i for i, v in enumerate(sorted(plain))}


def test_gap_stats_by_chunks(skewed):
    frame = np.sort(skewed.toPandas()["v"].to_numpy())
    row = gap_stats(skewed, "v", bound=0, chunks=5).first()
    gaps = np.diff(frame)
    assert row["gaps"] == len(gaps)
    assert row["std_gap"] == pytest.approx(np.std(gaps, ddof=1))


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_results_do_not_depend_on_partitions(spark, skewed, partitions):
    from tabloom.operators.folds import stratified_kfold

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = stratified_kfold(skewed.repartition(int(partitions)), "id", "k", 5)
        sizes = {(r["k"], r["fold"]): r["count"] for r in df.groupBy("k", "fold").count().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hot = [sizes[(0, f)] for f in range(5)]
    assert sum(hot) == 3000 and max(hot) - min(hot) <= 1


def test_spread_only_touches_few_partition_scans(spark, sf, skewed):
    from tabloom.session import spread

    scan = spark.read.parquet(f"{sf}/orders.parquet")
    assert spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = skewed.groupBy("k").count()
    assert spread(grouped) is grouped
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide) is wide


def _jobs(spark, group, work):
    """Number of Spark jobs that a piece of work starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = work()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_passes_do_not_grow_with_columns_and_quantiles(spark, skewed):
    base = skewed.select("id", "v", *[((F.col("v") * (i + 3)) % 701 + F.col("id") / 9000).alias(f"c{i}") for i in range(11)]).repartition(4).persist()
    base.count()
    one = {"c0": F.col("c0")}
    many = {f"c{i}": F.col(f"c{i}") for i in range(11)} | {"v": F.when(F.col("id") % 7 > 0, F.col("v"))}
    _, few = _jobs(spark, "few", lambda: exact_quantiles(base, one, [0.5], 1500, {"c0": 9000}))
    got, lots = _jobs(spark, "many", lambda: exact_quantiles(base, many, [0.01, 0.25, 0.5, 0.9], 1500))
    frame = base.toPandas()
    frame.loc[frame.id % 7 == 0, "v"] = np.nan
    for c in many:
        assert got[c] == pytest.approx(np.nanquantile(frame[c], [0.01, 0.25, 0.5, 0.9]))
    assert lots <= few + 3  # the count of values, which the first call was given
    base.unpersist()


def test_own_quantiles_for_each_column(skewed):
    got = exact_quantiles(skewed, {"a": F.col("v"), "b": -F.col("v")}, {"a": [0.5], "b": [0.0, 1.0]}, 100)
    v = skewed.toPandas()["v"]
    assert got["a"] == [pytest.approx(v.median())] and got["b"] == [-v.max(), -v.min()]


def test_correlations_with_nulls_in_two_passes(spark, monkeypatch):
    from tabloom.operators import selection

    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 7)) @ rng.normal(size=(7, 7)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 3.25
    names = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    got, jobs = _jobs(spark, "corr", lambda: selection.correlation_matrix(df, names))
    import pandas as pd

    want = pd.DataFrame(x).corr().to_numpy()
    want[5, 5] = 1.0
    assert np.allclose(got, want, equal_nan=True, atol=1e-8) and jobs <= 8
    monkeypatch.setattr(selection, "GROUP", 3)
    assert np.allclose(selection.correlation_matrix(df, names), want, equal_nan=True, atol=1e-8)


def test_quantile_counts_copy_no_rows(skewed, monkeypatch):
    data = skewed.select(F.when(F.col("id") % 7 != 0, F.col("v")).alias("v0"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("v") * F.col("id")).alias("v1"))
    brackets = [quantiles._Bracket(0, None, None, 0, data.where("v0 IS NOT NULL").count(), []), quantiles._Bracket(1, 5000.0, 4e6, 0, data.where("v1 > 5000 AND v1 < 4e6").count(), [])]
    edges = [[3.0, 500.0], [5000.5, 1e6, 3e6]]
    wide, long = quantiles._counts_wide(data, brackets, edges), quantiles._counts_long(data, brackets, edges)
    assert {k: n for k, n in wide.items() if n} == long and len(wide) == 12
    monkeypatch.setattr(quantiles, "_counts_long", lambda *_: pytest.fail("rows were copied"))
    got = exact_quantiles(skewed, {"v": F.col("v"), "k": F.col("k")}, [0.5], 100)
    frame = skewed.select("v", "k").toPandas()
    assert got == {c: [pytest.approx(frame[c].median())] for c in ("v", "k")}


def test_text_targets_are_read_as_numbers_once_a_value(skewed):
    found = infer.problem_type(skewed, "word")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    keys = first[first.index("[") + 1 : first.index("]")]
    assert keys.startswith("word#") and "," not in keys
    assert found.first()["n"] == 9000 and found.first()["distinct"] == skewed.select("word").distinct().count() and not found.first()["integer_like"]


def test_selection_reads_its_rows_by_column(skewed, monkeypatch):
    plans = []
    whole = ops.variance_filter
    monkeypatch.setattr(ops, "variance_filter", lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), whole(df, *rest))[1])
    data = skewed.withColumn("v", F.when(F.col("id") % 4 != 0, F.col("v")))
    result = selection.select_features(data, ["id", "v"], "k", selection.SelectionConfig(enable_model_based=False), key="word")
    assert result.selected == ["id", "v"] and "FileScan parquet" in plans[0] and "ExistingRDD" not in plans[0]


def test_correlations_of_a_few_columns_need_no_vectors(skewed, monkeypatch):
    data = skewed.select("v", "k", (F.col("v") * 3 - F.col("k") / 100 + 1e6).alias("w"), F.lit(0.1).alias("flat"), (-F.col("v")).alias("minus"))
    whole = ops.correlation_matrix(data, ["v", "k", "w", "minus"])
    assert np.allclose(whole, data.select("v", "k", "w", "minus").toPandas().corr().to_numpy(), atol=1e-9)
    monkeypatch.setattr(ops.Correlation, "corr", lambda *_: pytest.fail("vectors were made"))
    few = ops.correlation_matrix(data, ["v", "flat", "minus"])
    assert np.isnan(few[0, 1]) and np.isnan(few[1, 2]) and few[1, 1] == 1 and few[0, 2] == pytest.approx(-1)
    assert ops.correlation_filter(data, ["v", "k", "w", "minus"]) == ["v", "k"]
