"""Lags, rolling statistics, volatility, seasons, point-in-time history and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.catalog.common import Catalog, rounded, scratch, table
from tabloom.catalog.modelling import _as_stream
from tabloom.operators import keywords
from tabloom.operators import timeseries as series
from tabloom.streaming import changes

CAT = Catalog()
ORDER = ["ts", "event_id"]


def _off_halves(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded a hair above: means of prices often lie exactly between two rounded values, where engines differ."""
    return rounded(df.withColumns({c: F.col(c) + 1e-7 for c in columns}), digits, *columns)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


CAT.add(
    "q_lag",
    lambda spark, d: series.lags(_events(spark, d), ["user_id"], ORDER, "value", [1, 3]).select("event_id", "value_lag_1", "value_lag_3"),
    """SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
CAT.add(
    "q_roll_rows",
    lambda spark, d: rounded(
        series.rolling_rows(_events(spark, d), ["user_id"], ORDER, "value", 7).select("event_id", "value_roll_n", "value_roll_mean", "value_roll_std"), 6, "value_roll_mean", "value_roll_std"
    ),
    """SELECT event_id, count(value) OVER w AS value_roll_n, round(avg(value) OVER w, 6) AS value_roll_mean, round(stddev_samp(value) OVER w, 6) AS value_roll_std
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
CAT.add(
    "q_roll_seconds",
    lambda spark, d: rounded(
        series.rolling_seconds(_events(spark, d), ["event_type"], "ts", "value", 7200).select("event_id", "value_roll_n", "value_roll_mean", "value_roll_std"), 6, "value_roll_mean", "value_roll_std"
    ),
    """SELECT event_id, count(value) OVER w AS value_roll_n, round(avg(value) OVER w, 6) AS value_roll_mean, round(stddev_samp(value) OVER w, 6) AS value_roll_std
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECONDS PRECEDING AND CURRENT ROW)""",
)
CAT.add(
    "q_volatility",
    lambda spark, d: rounded(series.volatility(_events(spark, d), ["user_id"], ORDER, "value", 10).select("event_id", "log_return", "volatility"), 6, "log_return", "volatility"),
    """WITH r AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS x FROM events)
SELECT event_id, round(x, 6) AS log_return, round(stddev_samp(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS volatility FROM r""",
)
CAT.add(
    "q_weighted_moments",
    lambda spark, d: rounded(series.weighted_moments(_events(spark, d), ["user_id"], ORDER, "value", 0.9).select("event_id", "value_ew_mean", "value_ew_var"), 6, "value_ew_mean", "value_ew_var"),
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT a.event_id, sum(pow(0.9, a.i - b.i) * b.value) / sum(pow(0.9, a.i - b.i)) AS mean FROM n a JOIN n b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id)
SELECT a.event_id, round(any_value(m.mean), 6) AS value_ew_mean, round(sum(pow(0.9, a.i - b.i) * (b.value - m.mean) * (b.value - m.mean)) / sum(pow(0.9, a.i - b.i)), 6) AS value_ew_var
FROM n a JOIN m USING (event_id) JOIN n b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id""",
)


def _seasons(spark: SparkSession, d: str) -> DataFrame:
    days = series.daily_series(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice")
    return _off_halves(series.decompose(days, ["o_orderpriority"], 7), 4, "value", "trend", "seasonal", "residual")


CAT.add(
    "q_seasons", _seasons,
    """WITH k AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
g AS (SELECT *, lag(day) OVER w AS d0, lag(v) OVER w AS v0 FROM k WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day)),
s AS (SELECT o_orderpriority, x AS day, CASE WHEN x = g.day THEN v ELSE v0 + (v - v0) * ((x - d0) / (g.day - d0)) END AS value, x <> g.day AS filled
 FROM (SELECT *, unnest(range(coalesce(d0 + 1, day), day + 1)) AS x FROM g) g),
t AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS trend FROM s WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
m AS (SELECT o_orderpriority, day % 7 AS p, avg(value - trend) AS m FROM t GROUP BY ALL),
c AS (SELECT *, m - avg(m) OVER (PARTITION BY o_orderpriority) AS seasonal FROM m)
SELECT t.o_orderpriority, day, round(value + 1e-7, 4) AS value, filled, round(trend + 1e-7, 4) AS trend, round(seasonal + 1e-7, 4) AS seasonal, round(value - trend - seasonal + 1e-7, 4) AS residual
FROM t LEFT JOIN c ON t.o_orderpriority = c.o_orderpriority AND t.day % 7 = c.p""",
)


def _history(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return _off_halves(series.history(orders.drop("o_totalprice"), orders, ["o_custkey"], "o_orderdate", "o_totalprice"), 4, "past_mean").drop("o_custkey", "o_orderdate")


CAT.add(
    "q_history", _history,
    """SELECT a.o_orderkey, count(b.o_orderkey) AS past_n, round(avg(b.o_totalprice) + 1e-7, 4) AS past_mean, CAST(epoch(any_value(a.o_orderdate)) - epoch(max(b.o_orderdate)) AS DOUBLE) AS past_seconds
FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY a.o_orderkey""",
)


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    asked = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    facts = e.where("event_type <> 'error'").select("user_id", "ts", F.col("event_id").alias("fact_id"), "value")
    return series.as_of(asked, facts, ["user_id"], "ts", ["fact_id", "value"], ["fact_id"]).drop("user_id", "ts")


CAT.add(
    "q_as_of", _as_of,
    """SELECT a.event_id, b.event_id AS last_fact_id, b.value AS last_value FROM events a
LEFT JOIN LATERAL (SELECT event_id, value FROM events f WHERE f.user_id = a.user_id AND f.event_type <> 'error' AND f.ts < a.ts ORDER BY f.ts DESC, f.event_id DESC LIMIT 1) b ON true
WHERE a.event_type = 'error'""",
)
CAT.add(
    "q_bucket",
    lambda spark, d: table(spark, d, "part").select("p_partkey", series.bucketize(F.col("p_size"), [10, 25, 40], ["small", "medium", "large", "huge"]).alias("size_group")),
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 25 THEN 'medium' WHEN p_size < 40 THEN 'large' ELSE 'huge' END AS size_group FROM part",
)


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    return rounded(keywords.keywords(table(spark, d, "documents"), "doc_id", "text", 5), 6, "score")


CAT.add(
    "q_keywords", _keywords,
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, unnest(ws) AS term, len(ws) AS size FROM w) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT doc_id, term, tf, df, tf / size * ln((1.0 + (SELECT count(*) FROM w WHERE len(ws) > 0)) / (1.0 + df)) AS score FROM t JOIN f USING (term))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank, term, tf, df, round(score, 6) AS score FROM s QUALIFY rank <= 5""",
)


def _stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The events whose type differs from the user's event before, kept up to date by a stream over the table's files."""
    source = _as_stream(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    path = scratch(spark, "changes")
    changes.stream_changes(source, path, f"{path}-checkpoint", ["user_id"], ["ts", "event_id"], "ts", "event_type", 3600).awaitTermination()
    return changes.read_changes(spark, path, source.schema).select("event_id", "user_id", "event_type")


CAT.add(
    "e7_stream_changes", _stream_changes,
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""",
)
