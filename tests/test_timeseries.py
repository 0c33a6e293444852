"""Time-series features: plain paths against pandas, split paths of hot keys against the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import timeseries as series

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 has a third of the rows, one key is null, values are null now and then, times repeat and one in 97 is null."""
    i = F.col("id")
    return spark.range(0, 1500).select(
        "id", F.when(i % 3 == 0, 0).when(i % 31 != 5, 1 + i % 5).alias("k"), F.when(i % 97 != 8, F.timestamp_seconds(F.pmod(i * 7919, F.lit(40000)) * 60)).alias("t"),
        F.when(i % 13 != 4, 1000 + F.pmod(i * 104729, F.lit(1009)) / 7).alias("v"),
    ).repartition(6).persist()


def frame(df, *columns):
    return df.select("id", *columns).toPandas().sort_values("id").reset_index(drop=True)


def groups(skewed):
    f = skewed.toPandas()
    f["t"] = pd.to_datetime(f.t)
    for _, part in f.groupby("k", dropna=False):
        yield part.sort_values(["t", "id"], na_position="first")


@pytest.mark.parametrize(("bound", "block"), [(10_000, 100), (0, 7), (0, 100)])
def test_lags_and_rows(skewed, bound, block):
    got = frame(series.lags(skewed, ["k"], ORDER, "v", [1, 4], bound, block), "v_lag_1", "v_lag_4")
    want = pd.concat([g.assign(a=g.v.shift(1), b=g.v.shift(4)) for g in groups(skewed)]).sort_values("id")
    assert np.allclose(got.v_lag_1, want.a, equal_nan=True) and np.allclose(got.v_lag_4, want.b, equal_nan=True)
    got = frame(series.rolling_rows(skewed, ["k"], ORDER, "v", 5, bound, block), "v_roll_n", "v_roll_mean", "v_roll_std")
    want = pd.concat([g.assign(n=(r := g.v.rolling(5, min_periods=1)).count(), m=r.mean(), s=r.std()) for g in groups(skewed)]).sort_values("id")
    for a, b in (("v_roll_n", "n"), ("v_roll_mean", "m"), ("v_roll_std", "s")):
        assert np.allclose(got[a].astype(float), want[b], equal_nan=True), a


@pytest.mark.parametrize("spans", [1, 3, 1000])
def test_seconds(skewed, spans):
    got = frame(series.rolling_seconds(skewed, ["k"], "t", "v", 3600, spans), "v_roll_n", "v_roll_mean", "v_roll_std")
    rows = []
    for g in groups(skewed):
        for r in g.itertuples():
            near = g[(g.t <= r.t) & (g.t >= r.t - pd.Timedelta(hours=1))].v.dropna()
            rows.append((r.id, np.nan if r.t is pd.NaT else len(near), near.mean(), near.std()))
    want = pd.DataFrame(rows, columns=["id", "n", "m", "s"]).sort_values("id")
    for a, b in (("v_roll_n", "n"), ("v_roll_mean", "m"), ("v_roll_std", "s")):
        assert np.allclose(got[a].astype(float), want[b], equal_nan=True), a


@pytest.mark.parametrize(("bound", "block"), [(10_000, None), (0, 20)])
@pytest.mark.parametrize("decay", [0.5, 0.9])
def test_weighted_moments(skewed, bound, block, decay):
    got = frame(series.weighted_moments(skewed, ["k"], ORDER, "v", decay, bound, block), "v_ew_mean", "v_ew_var")
    want = []
    for g in groups(skewed):
        v = g.v.to_numpy()
        for n, i in enumerate(g.id):
            x = v[: n + 1]
            w = decay ** np.arange(n, -1, -1) * ~np.isnan(x)
            m = np.nansum(w * x) / w.sum() if w.sum() else np.nan
            want.append((i, m, np.nansum(w * (x - m) ** 2) / w.sum() if w.sum() else np.nan))
    want = pd.DataFrame(want, columns=["id", "m", "s"]).sort_values("id")
    assert np.allclose(got.v_ew_mean, want.m, equal_nan=True) and np.allclose(got.v_ew_var, want.s, equal_nan=True, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("bound", [10_000, 0])
def test_volatility(skewed, bound):
    got = frame(series.volatility(skewed, ["k"], ORDER, "v", 4, bound, 9), "log_return", "volatility")
    want = pd.concat([g.assign(x=(x := np.log(g.v / g.v.shift(1))), s=x.rolling(4, min_periods=1).std()) for g in groups(skewed)]).sort_values("id")
    assert np.allclose(got.log_return, want.x, equal_nan=True) and np.allclose(got.volatility, want.s, equal_nan=True)


@pytest.mark.parametrize("period", [7, 6])
@pytest.mark.parametrize("block", [4, 100_000])
def test_decomposition(spark, period, block):
    """A line plus a season comes back as it went in, gaps included."""
    season = [3.0, -1.0, 0.0, 2.0, -2.0, -2.5, 0.5][:period]
    season = [s - sum(season) / period for s in season]
    rows = [(k, f"2021-{1 + d // 28:02d}-{1 + d % 28:02d} 05:00:00", float(d)) for k in ("a", None) for d in range(0, 300)]
    df = spark.createDataFrame(rows, "k string, ts string, d double").select("k", F.col("ts").cast("timestamp").alias("ts"), "d")
    day = F.unix_date(F.col("ts").cast("date"))
    df = df.withColumn("v", 0.25 * day + F.element_at(F.array(*[F.lit(s) for s in season]), (day % period + 1).cast("int")))
    days = series.daily_series(df, ["k"], "ts", "v", bound=0)
    assert days.groupBy("k").agg(F.count("*").alias("n"), F.max("day").alias("b"), F.min("day").alias("a")).where("n <> b - a + 1").count() == 0
    full = series.daily_series(spark.range(0, 200).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), (0.5 * F.col("id") + F.element_at(F.array(*[F.lit(s) for s in season]), (F.col("id") % period + 1).cast("int"))).alias("v")), ["k"], "ts", "v")
    out = series.decompose(full, ["k"], period, block=block).orderBy("day").toPandas()
    inner = out[period : -period]
    assert np.allclose(inner.trend, 0.5 * inner.day) and np.allclose(out.seasonal, [season[x % period] for x in out.day]) and np.allclose(inner.residual, 0, atol=1e-9)
    assert out.trend.isna().sum() == 2 * (period // 2)
    alone = series.decompose(full.drop("k"), [], period, block=block).orderBy("day").toPandas()
    assert np.allclose(alone.seasonal, out.seasonal) and list(alone.columns) == ["day", "value", "filled", "trend", "seasonal", "residual"]


def test_gaps_are_straight_lines(spark):
    rows = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-01-01", 3.0), ("a", "2020-01-05", 10.0), ("b", None, 1.0), ("b", "2020-01-02", None), ("c", "2020-01-02", 7.0)], "k string, ts string, v double")
    got = [tuple(r) for r in series.daily_series(rows, ["k"], "ts", "v").orderBy("k", "day").collect()]
    first = 18262
    assert got == [("a", first, 2.0, False), ("a", first + 1, 4.0, True), ("a", first + 2, 6.0, True), ("a", first + 3, 8.0, True), ("a", first + 4, 10.0, False), ("c", first + 1, 7.0, False)]


@pytest.mark.parametrize(("bound", "chunks"), [(10_000, None), (0, 5)])
def test_history_and_as_of(skewed, bound, chunks):
    asked = skewed.select("id", "k", "t")
    got = series.history(asked, skewed, ["k"], "t", "v", bound, chunks).toPandas().sort_values("id").reset_index(drop=True)
    last = series.as_of(asked, skewed.select("k", "t", F.col("id").alias("other"), "v"), ["k"], "t", ["other", "v"], ["other"], bound, chunks).toPandas().sort_values("id").reset_index(drop=True)
    f = skewed.toPandas().sort_values("id").reset_index(drop=True)
    for i, r in f.iterrows():
        past = f[((f.k == r.k) | (f.k.isna() & pd.isna(r.k))) & (f.t < r.t)]
        assert got.past_n[i] == len(past)
        assert np.allclose(got.past_mean[i], past.v.mean(), equal_nan=True)
        assert np.allclose(got.past_seconds[i], (r.t - past.t.max()).total_seconds() if len(past) else np.nan, equal_nan=True)
        top = past.sort_values(["t", "id"]).tail(1)
        assert (pd.isna(last.last_other[i]) and not len(top)) or last.last_other[i] == top.id.iloc[0]


def test_empty_tables_and_bad_arguments(spark, skewed):
    none = skewed.limit(0)
    for made in (series.lags(none, ["k"], ORDER, "v", [2]), series.rolling_seconds(none, ["k"], "t", "v", 5), series.weighted_moments(none, ["k"], ORDER, "v", 0.5), series.history(none, none, ["k"], "t", "v"), series.daily_series(none, ["k"], "t", "v")):
        assert made.count() == 0
    for call in (lambda: series.lags(none, ["k"], ORDER, "v", [0]), lambda: series.weighted_moments(none, ["k"], ORDER, "v", 1.0), lambda: series.bucketize(F.col("v"), [1, 2], ["a"]), lambda: series.decompose(none, [], 1)):
        with pytest.raises(ValueError):
            call()


def test_buckets(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (9.9,), (10.0,)], "x double")
    assert [r[0] for r in df.select(series.bucketize(F.col("x"), [0, 10], ["low", "mid", "high"])).collect()] == [None, "low", "mid", "mid", "high"]


def test_windows_of_seconds_cost_the_same_per_row_however_many_rows_they_hold(spark):
    """Forty thousand rows in one window: recomputing each frame would take 800 million steps. The odd value far away must
    not cost the others their digits."""
    import time

    rows = spark.range(40_000).select(
        (F.col("id") % 2).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 20)).alias("t"), F.when(F.col("id") == 0, 1e12).otherwise((F.col("id") % 7) / 100).alias("v"),
    )
    begin = time.monotonic()
    got = series.rolling_seconds(rows, ["k"], "t", "v", 1900).orderBy("t").collect()
    took = time.monotonic() - begin
    last = [r for r in got if r["t"] == got[-1]["t"]]
    held = [(i % 7) / 100 for i in range(40_000) if i % 2 == 0 and i // 20 >= 1999 - 1900]
    even = next(r for r in last if r["k"] == 0)
    mean = sum(held) / len(held)
    assert even["v_roll_n"] == len(held) and even["v_roll_mean"] == pytest.approx(mean, rel=1e-12)
    assert even["v_roll_std"] == pytest.approx((sum((x - mean) ** 2 for x in held) / (len(held) - 1)) ** 0.5, rel=1e-9)
    plan = series.rolling_seconds(rows, ["k"], "t", "v", 1900)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan.lower() and "-1900000000" not in plan and took < 60
