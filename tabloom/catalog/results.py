"""Output formats, prediction statistics, leaderboard rules, error analysis and run telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.catalog.common import Catalog, rounded, scratch, sql_hash, table
from tabloom.functions.hashing import hash32
from tabloom.operators import output, telemetry
from tabloom.plans import training
from tabloom.sources import writers

CAT = Catalog()

# -- output -----------------------------------------------------------------------------------------------


def _formats(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    samples = {
        "binary": o.select("o_orderkey", (F.col("o_totalprice") > 100000).cast("int").alias("y")),
        "probability": li.select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("y")),
        "categorical": o.select("o_orderkey", F.col("o_orderstatus").alias("y")),
        "codes": li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("y")),
        "continuous": o.select("o_orderkey", F.col("o_totalprice").alias("y")),
    }
    out = None
    for name, sample in samples.items():
        fmt = output.detect_format(sample)
        row = sample.agg(F.lit(name).alias("sample"), F.lit(fmt.id_column).alias("id_column"), F.lit(fmt.target_column).alias("target_column"),
                         F.lit(fmt.value_type).alias("value_type"), F.count("y").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def _sql_format(name: str, ident: str, tab: str, y: str, text: bool = False) -> str:
    v = "NULL::DOUBLE" if text else f"CAST({y} AS DOUBLE)"
    return f"""SELECT '{name}' AS sample, '{ident}' AS id_column, 'y' AS target_column,
 CASE WHEN coalesce(bool_and({v} IN (0, 1)), false) THEN 'binary'
  WHEN coalesce(bool_and({v} BETWEEN 0 AND 1), false) AND ((count(DISTINCT {y}) = 1 AND bool_and({v} = 0.5)) OR count(DISTINCT {y}) > 2) THEN 'probability'
  WHEN {str(text).lower()} OR count(DISTINCT {y}) < 20 THEN 'categorical' ELSE 'continuous' END AS value_type, count({y}) AS n FROM {tab}"""


CAT.add("r4_detect_format", _formats, "\nUNION ALL ".join([
    _sql_format("binary", "o_orderkey", "orders", "CAST(o_totalprice > 100000 AS INTEGER)"),
    _sql_format("probability", "id", "lineitem", "l_discount"),
    _sql_format("categorical", "o_orderkey", "orders", "o_orderstatus", True),
    _sql_format("codes", "id", "lineitem", "l_linenumber"),
    _sql_format("continuous", "o_orderkey", "orders", "o_totalprice"),
]))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labels as predictions and a share of the text length as probability."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("prediction"))
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("probability"))
    return labels.join(docs, "doc_id").select("doc_id", "prediction", "probability")


SQL_SCORED = "s AS (SELECT l.doc_id, quality AS p, n_chars / (n_chars + 1000) AS prob FROM labels l JOIN documents USING (doc_id))"
for kind, value in (("binary", "CAST(p AS BIGINT)"), ("probability", "prob"), ("categorical", "CAST(p AS DOUBLE)"), ("continuous", "prob")):
    CAT.add(
        f"r5_format_{kind}",
        lambda spark, d, kind=kind: output.format_predictions(
            _scored(spark, d), output.OutputFormat("doc_id", "answer", kind), F.col("prediction"), F.col("probability")
        ),
        f"WITH {SQL_SCORED} SELECT doc_id, {value} AS answer FROM s",
    )
CAT.add(
    "r6_fallback_format",
    lambda spark, d: output.format_predictions(
        _scored(spark, d), output.fallback_format(_scored(spark, d).columns), F.col("prediction"), F.col("probability")
    ),
    f"WITH {SQL_SCORED} SELECT doc_id, CAST(p AS BIGINT) AS prediction FROM s",
)
CAT.add(
    "r7_prediction_stats",
    lambda spark, d: rounded(output.prediction_stats(_scored(spark, d), "prediction", "probability"), 6,
                             "predicted_positive_rate", "min_confidence", "max_confidence", "mean_confidence"),
    f"""WITH {SQL_SCORED} SELECT count(*) AS predictions_count, CAST(sum(p) AS BIGINT) AS predicted_positive, CAST(count(*) - sum(p) AS BIGINT) AS predicted_negative,
 round(avg(p), 6) AS predicted_positive_rate, round(min(prob), 6) AS min_confidence, round(max(prob), 6) AS max_confidence, round(avg(prob), 6) AS mean_confidence FROM s""",
)
CAT.add(
    "r8_detailed_predictions",
    lambda spark, d: output.detailed_predictions(_scored(spark, d), "doc_id", "prediction", "probability"),
    f'WITH {SQL_SCORED} SELECT doc_id, CAST(p AS DOUBLE) AS "Prediction", prob AS "Confidence" FROM s',
)

# -- rules over runs of candidates: a user is a run, an event type a model, a value a score ------------------

MODELS = {"click": "Random Forest", "view": "Gradient Boosting", "purchase": "Logistic Regression", "signup": "Linear Regression", "error": "Stacking Ensemble"}
SQL_MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODELS.items()) + " END"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    name = F.lit(None).cast("string")
    for k, v in MODELS.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), name.alias("model"), "event_id", "ts", F.col("value").alias("score"))


SQL_RUNS = f"runs AS (SELECT user_id AS run_id, {SQL_MODEL} AS model, event_id, ts, value AS score FROM events)"
PARAMETERS = [(m, p) for m, ps in training.PARAMETER_LIMITS.items() for p in ps]


def _suggestions(spark: SparkSession, d: str) -> DataFrame:
    """A suggestion per event: its model, one of that model's parameters, and a value around the limits."""
    e = _runs(spark, d)
    pick = hash32("event_id") % 4
    name = F.when(pick == 0, "max_depth").when(pick == 1, "n_estimators").when(pick == 2, "learning_rate").otherwise("C")
    value = F.when(pick == 1, F.col("score") * 37).when(pick == 2, F.col("score") / 200).otherwise(F.col("score"))
    return e.select("event_id", "model", name.alias("parameter"), value.alias("value"))


SQL_LIMITS = ", ".join(
    f"('{m}', '{p}', '{k}', {'NULL' if lo is None else float(lo)}, {'NULL' if hi is None else float(hi)})"
    for m, ps in training.PARAMETER_LIMITS.items() for p, (k, lo, hi) in ps.items()
)
CAT.add(
    "m11_param_overrides",
    lambda spark, d: training.clamp_overrides(_suggestions(spark, d)).select("event_id", "model", "parameter", "clamped"),
    f"""WITH {SQL_RUNS}, lim(model, parameter, type, low, high) AS (VALUES {SQL_LIMITS}),
 s AS (SELECT event_id, model, {sql_hash('event_id')} % 4 AS k, score FROM runs),
 n AS (SELECT event_id, model, CASE k WHEN 0 THEN 'max_depth' WHEN 1 THEN 'n_estimators' WHEN 2 THEN 'learning_rate' ELSE 'C' END AS parameter,
  CASE k WHEN 1 THEN score * 37 WHEN 2 THEN score / 200 ELSE score END AS value FROM s)
SELECT event_id, model, parameter, CASE WHEN type = 'float' THEN round(greatest(least(value, high), low), 6)
 ELSE greatest(least(round_even(value, 0), high), low) END AS clamped FROM n JOIN lim USING (model, parameter)""",
)


def _guided(spark: SparkSession, d: str) -> DataFrame:
    """Per run: models it tried, in order of first use; recommended after a score above 80, excluded after one below 1."""
    r = _runs(spark, d).withColumnRenamed("run_id", "scope")
    models = r.groupBy("scope", "model").agg(F.min("event_id").alias("position"))
    wishes = r.where("score > 80 OR score < 1").select(
        "scope", "model", F.when(F.col("score") > 80, "recommended").otherwise("excluded").alias("kind"), F.col("event_id").alias("position")
    )
    return training.order_candidates(models, wishes)


CAT.add(
    "m12_candidate_order", _guided,
    f"""WITH {SQL_RUNS}, m AS (SELECT run_id AS scope, model, min(event_id) AS position FROM runs GROUP BY 1, 2),
 w AS (SELECT run_id AS scope, model, min(event_id) AS wish FROM runs WHERE score > 80 GROUP BY 1, 2),
 b AS (SELECT DISTINCT run_id AS scope, model, true AS banned FROM runs WHERE score < 1),
 j AS (SELECT scope, model, position, wish, coalesce(banned, false) AS banned, count(*) FILTER (WHERE NOT coalesce(banned, false)) OVER (PARTITION BY scope) AS free
  FROM m LEFT JOIN w USING (scope, model) LEFT JOIN b USING (scope, model))
SELECT scope, model, row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN free > 0 THEN wish END NULLS LAST, position, model) AS rank
FROM j WHERE NOT banned OR free = 0""",
)


def _board(spark: SparkSession, d: str) -> DataFrame:
    return training.fold_scores_board(_runs(spark, d))


SQL_BOARD = f"{SQL_RUNS}, board AS (SELECT run_id, model, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS folds FROM runs GROUP BY 1, 2)"
CAT.add(
    "m13_best_model",
    lambda spark, d: rounded(training.best_model(_board(spark, d)), 6, "mean"),
    f"""WITH {SQL_BOARD} SELECT run_id, model, round(mean, 6) AS mean FROM board
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY mean DESC, model = 'Stacking Ensemble', model) = 1""",
)
CAT.add("m15_leaderboard", lambda spark, d: rounded(_board(spark, d), 6, "mean", "std"),
        f"WITH {SQL_BOARD} SELECT run_id, model, round(mean, 6) AS mean, round(std, 6) AS std, folds FROM board")


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("documents", "events", "orders", "lineitem"):
        n = table(spark, d, t).count()
        b = training.search_budget(n)
        row = table(spark, d, t).agg(F.lit(t).alias("table"), F.count("*").alias("n"), F.lit(b.trials).alias("trials"), F.lit(b.seconds).alias("seconds"))
        out = row if out is None else out.unionByName(row)
    return out


CAT.add(
    "m10_search_budget", _budgets,
    "\nUNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS n, CAST(CASE WHEN count(*) <= 2000 THEN 25 WHEN count(*) <= 5000 THEN 40 ELSE 100 END AS BIGINT) AS trials,
 CAST(CASE WHEN count(*) <= 2000 THEN 240 WHEN count(*) <= 5000 THEN 360 ELSE 600 END AS BIGINT) AS seconds FROM {t}"""
        for t in ("documents", "events", "orders", "lineitem")
    ),
)

# -- error analysis: discounted price against a plain estimate -------------------------------------------------


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("y"),
        (F.lit(150000.0) + F.col("o_custkey") * 10).alias("prediction"),
    )


SQL_ERR = "e AS (SELECT o_orderkey, o_custkey, month(o_orderdate) AS month, o_totalprice AS y, 150000.0::DOUBLE + o_custkey * 10 AS prediction FROM orders)"
CAT.add(
    "m17_error_stats",
    lambda spark, d: rounded(training.error_stats(_errors(spark, d), "y", "prediction"), 4, "mean_absolute_error", "rmse", "max_error"),
    f"WITH {SQL_ERR} SELECT round(avg(abs(y - prediction)), 4) AS mean_absolute_error, round(sqrt(avg((y - prediction) * (y - prediction))), 4) AS rmse, round(max(abs(y - prediction)), 4) AS max_error FROM e",
)
CAT.add(
    "m17_largest_errors",
    lambda spark, d: rounded(training.largest_errors(_errors(spark, d), ["o_orderkey"], "y", "prediction", 100), 4, "abs_error"),
    f"WITH {SQL_ERR} SELECT o_orderkey, y, prediction, round(abs(y - prediction), 4) AS abs_error FROM e ORDER BY abs(y - prediction) DESC, o_orderkey LIMIT 100",
)
CAT.add(
    "m17_error_correlations",
    lambda spark, d: rounded(training.error_correlations(_errors(spark, d), ["o_custkey", "month"], "y", "prediction"), 6, "r"),
    f"WITH {SQL_ERR} SELECT 'o_custkey' AS feature, round(corr(o_custkey, abs(y - prediction)), 6) AS r FROM e UNION ALL SELECT 'month', round(corr(month, abs(y - prediction)), 6) FROM e",
)
CAT.add(
    "m8_metric_regression",
    lambda spark, d: _errors(spark, d).withColumnRenamed("y", "label").agg(F.round(training.metric("regression") / 1e6, 6).alias("score")),
    f"WITH {SQL_ERR} SELECT round(-avg((prediction - y) * (prediction - y)) / 1e6, 6) AS score FROM e",
)
CAT.add(
    "m8_metric_accuracy",
    lambda spark, d: table(spark, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction")).agg(
        F.round(training.metric("classification"), 8).alias("score")
    ),
    "SELECT round(avg(CAST(quality = toxic AS INTEGER)), 8) AS score FROM labels",
)

# -- telemetry ----------------------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "trials")
    e = table(spark, d, "events")
    log = telemetry.trial_log(e, "event_type", F.col("event_id"), "value", "ts").select("model", "trial", "score")
    writers.append_table(log.where("trial % 2 = 0"), path)
    writers.append_table(log.where("trial % 2 = 1"), path)
    return spark.read.parquet(path)


CAT.add("e1_trial_log", _log, "SELECT event_type AS model, event_id AS trial, value AS score FROM events")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


SQL_BEST = "SELECT event_id, max(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best_score FROM events"
for suffix, options in (("", {}), ("_range_split", {"bound": 0, "chunks": 8})):
    CAT.add(
        f"e2_running_best{suffix}",
        lambda spark, d, options=options: telemetry.running_best(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "value", **options)
        .select("event_id", "best_score"),
        SQL_BEST,
    )
    CAT.add(
        f"e7_suppress_unchanged{suffix}",
        lambda spark, d, options=options: telemetry.suppress_unchanged(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", **options).select("event_id"),
        """SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS NULL OR p <> event_type""",
    )
CAT.add(
    "e3_latest_state",
    lambda spark, d: telemetry.latest_state(_events(spark, d), "user_id", ["ts", "event_id"], ["event_type", "value"]),
    "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
CAT.add(
    "e4_stage_durations",
    lambda spark, d: telemetry.stage_durations(_events(spark, d), "user_id", "event_type", "ts"),
    "SELECT user_id, event_type, CAST(floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000) AS BIGINT) AS duration_seconds, count(*) AS events FROM events GROUP BY 1, 2",
)
CAT.add(
    "e5_completion_pct",
    lambda spark, d: rounded(telemetry.completion_pct(_events(spark, d), "user_id", F.col("event_type") == "purchase", F.count("*")), 6, "pct"),
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) AS total,
 round(least(greatest(count(*) FILTER (WHERE event_type = 'purchase') * 100.0 / count(*), 0), 100), 6) AS pct FROM events GROUP BY 1""",
)
CAT.add(
    "e6_list_runs",
    lambda spark, d: telemetry.list_runs(_events(spark, d).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id", "ts"),
    "SELECT user_id, min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS last_seen, count(*) AS events FROM events GROUP BY 1",
)
CAT.add("e6_get_run", lambda spark, d: telemetry.get_run(_events(spark, d).drop("ts"), "user_id", 3),
        "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 3")
CAT.add(
    "e8_tuning_summary",
    lambda spark, d: rounded(telemetry.tuning_summary(_events(spark, d), "user_id", ["ts", "event_id"], "value"), 6, "recent_std"),
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, count(*) AS trials, max(value) AS best_score, round(stddev_pop(value) FILTER (WHERE rn <= 5), 6) AS recent_std FROM r GROUP BY 1""",
)
