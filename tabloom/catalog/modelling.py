"""Models, cross-validation, search, stacking and scoring, and the stream forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.catalog.common import Catalog, scratch, sql_hash, table
from tabloom.functions.hashing import bucket, hash32
from tabloom.operators import output
from tabloom.plans import engine, scoring, training, winner
from tabloom.plans.selection import assembled
from tabloom.streaming import streams

CAT = Catalog()

PRICE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "unit"]
FLAG_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "age_days"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a hash of the whole row as key, folds, a price target and a three-class target."""
    li = table(spark, d, "lineitem")
    key = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.withColumns({
        "key": key, "fold": bucket(key, 5).cast("int"), "unit": F.col("l_extendedprice") / F.col("l_quantity"),
        "age_days": F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")),
        "returned": (F.col("l_returnflag") == "R").cast("int"),
    })


def _price(spark: SparkSession, d: str) -> DataFrame:
    return assembled(_lines(spark, d), PRICE_FEATURES, "l_extendedprice", ["fold", "key"])


def _returned(spark: SparkSession, d: str) -> DataFrame:
    return assembled(_lines(spark, d), FLAG_FEATURES, "returned", ["fold", "key"])


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return assembled(_lines(spark, d), FLAG_FEATURES, "l_returnflag", ["fold", "key"])


def _scores(spark: SparkSession, results: list[training.CvResult]) -> DataFrame:
    rows = [(r.model, i, float(s)) for r in results for i, s in enumerate(r.scores)]
    return spark.createDataFrame(rows, "model string, fold int, score double")


def _cv(name: str, problem: str, data, params: dict | None = None, classes: int = 2):
    def query(spark: SparkSession, d: str) -> DataFrame:
        frame = training.training_frame(data(spark, d), [name])
        try:
            return _scores(spark, [training.cross_validate(frame, name, problem, 5, params, classes)])
        finally:
            frame.unpersist()

    return query


def _linear(spark: SparkSession, d: str) -> DataFrame:
    """One predictor, where least squares has a closed form SQL can state."""
    o = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    model = training.build_model(training.LINEAR, "regression").fit(assembled(o, ["l_quantity"], "l_extendedprice"))
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 2), round(float(model.intercept), 2))], "slope double, intercept double"
    )


CAT.add("m1_linear_regression", _linear,
        "SELECT round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
CAT.add("m2_ridge", _cv(training.RIDGE, "regression", _price, {"alpha": 1.0}))
CAT.add("m3_logistic_regression", _cv(training.LOGISTIC, "classification", _returned, {"C": 1.0, "max_iter": 50}))
CAT.add("m4_random_forest", _cv(training.FOREST, "classification", _flags, {"n_estimators": 10, "max_depth": 5}, 3))
CAT.add("m5_gradient_boosting", _cv(training.BOOSTING, "regression", _price, {"n_estimators": 5, "max_depth": 3}))
CAT.add("m8_cross_val_score", _cv(training.FOREST, "regression", _price, {"n_estimators": 10, "max_depth": 5}))


def _multiclass_boosting(spark: SparkSession, d: str) -> DataFrame:
    frame = _flags(spark, d)
    model = training.fit_model(frame, training.BOOSTING, "classification", {"n_estimators": 3, "max_depth": 3}, classes=3)
    return model.transform(frame).groupBy("label", "prediction").agg(F.count("*").alias("n"))


CAT.add("m5_gradient_boosting_multiclass", _multiclass_boosting)


def _search(spark: SparkSession, d: str) -> DataFrame:
    frame = training.training_frame(_price(spark, d))
    try:
        return _scores(spark, [training.search(frame, training.RIDGE, "regression", 10)])
    finally:
        frame.unpersist()


CAT.add("m9_search", _search)


def _stack(spark: SparkSession, d: str) -> DataFrame:
    frame = training.training_frame(_price(spark, d))
    try:
        members = [
            training.CvResult(training.LINEAR, []), training.CvResult(training.FOREST, [], {"n_estimators": 5, "max_depth": 4}),
        ]
        model = training.fit_stack(frame, members, "regression")
        return model.transform(frame).groupBy("fold").agg(training.metric("regression").alias("score"), F.count("*").alias("n"))
    finally:
        frame.unpersist()


CAT.add("m14_stacking", _stack)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    frame = training.training_frame(_price(spark, d))
    try:
        params = {training.FOREST: {"n_estimators": 5, "max_depth": 4}, training.RIDGE: {"alpha": 0.1}}
        results = training.run_candidates(
            frame, [training.LINEAR, training.RIDGE, training.FOREST, "Unknown Model"], "regression", params=params
        )
        return training.leaderboard(spark, "r1", results).drop("params")
    finally:
        frame.unpersist()


CAT.add("m18_concurrent_candidates", _candidates)


def _final(spark: SparkSession, d: str) -> DataFrame:
    frame = _returned(spark, d)
    model = training.build_model(training.LOGISTIC, "classification", {"max_iter": 50}).fit(frame)
    scored = model.transform(frame)
    return scored.select("key", "prediction", scoring.confidence(scored).alias("confidence"))


CAT.add("m16_final_fit", _final)
CAT.add("r2_confidence", lambda spark, d: _final(spark, d).groupBy("prediction").agg(
    F.count("*").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high")))


def _refit_winner(spark: SparkSession, d: str) -> DataFrame:
    """Leaderboard of two candidates with a closed form, the winner fitted on all rows, saved, loaded and applied."""
    lines = table(spark, d, "lineitem").withColumn("fold", bucket("l_orderkey", 5).cast("int"))
    frame = training.training_frame(assembled(lines, ["l_quantity"], "l_extendedprice", ["fold"]))
    try:
        tried = [training.cross_validate(frame, training.LINEAR, "regression", 5, {"fit_intercept": own}) for own in (True, False)]
    finally:
        frame.unpersist()
    board = training.leaderboard(spark, "r1", tried)
    path = scratch(spark, "winner")
    winner.fit_winner(lines, ["l_quantity"], "l_extendedprice", winner.board_results(board, "r1"), "regression").save(spark, path, "r1")
    kept = winner.Winner.load(spark, path, scoring.latest_run(spark, path))
    made = kept.predict(lines.select("l_quantity").distinct())
    return made.select("l_quantity", F.round("prediction", 2).alias("prediction"), F.lit(round(kept.candidate.mean / 1e6, 4)).alias("mean_score"))


CAT.add(
    "m16_refit_winner", _refit_winner,
    f"""WITH l AS (SELECT l_quantity AS x, l_extendedprice AS y, {sql_hash("l_orderkey")} % 5 AS f FROM lineitem),
fits AS (SELECT g.f, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, sum(x * y) / sum(x * x) AS c FROM l JOIN (SELECT DISTINCT f FROM l) g ON l.f <> g.f GROUP BY g.f),
scores AS (SELECT f, -avg((y - a * x - b) * (y - a * x - b)) AS own, -avg((y - c * x) * (y - c * x)) AS none FROM l JOIN fits USING (f) GROUP BY f),
board AS (SELECT avg(own) AS own, avg(none) AS none FROM scores), whole AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, sum(x * y) / sum(x * x) AS c FROM l)
SELECT DISTINCT x AS l_quantity, round(CASE WHEN own >= none THEN a * x + b ELSE c * x END, 2) AS prediction, round(greatest(own, none) / 1e6, 4) AS mean_score FROM l, board, whole""",
)


def _stack_scores(spark: SparkSession, d: str) -> DataFrame:
    """A stack scored on rows it was not fitted on: fitted anew without each fold."""
    frame = training.training_frame(_price(spark, d))
    try:
        members = [training.CvResult(training.LINEAR, []), training.CvResult(training.RIDGE, [], {"alpha": 1.0})]
        return _scores(spark, [training.stack_scores(frame, members, "regression")])
    finally:
        frame.unpersist()


CAT.add("m14_stack_scores", _stack_scores)


def _deadline_search(spark: SparkSession, d: str) -> DataFrame:
    """Forests and boosting searched by halving on all rows; the seconds hold for each."""
    orders = table(spark, d, "orders").withColumns({"fold": bucket("o_orderkey", 3).cast("int"), "month": F.month("o_orderdate"), "year": F.year("o_orderdate")})
    frame = training.training_frame(assembled(orders, ["month", "year", "o_custkey"], "o_totalprice", ["fold"]))
    try:
        budget = training.Budget(6, 30, 6, 30)
        found = training.run_candidates(frame, [training.FOREST, training.BOOSTING], "regression", tune=[training.FOREST, training.BOOSTING], budget=budget)
        return training.leaderboard(spark, "r1", found).select("model", "mean", "std", "tuned", "status")
    finally:
        frame.unpersist()


CAT.add("m9_deadline_search", _deadline_search)


def _class_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in, names out: the place of a line in its order decides its class, which a forest of one feature learns exactly."""
    place = F.col("l_linenumber")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(place == 1, "first").when(place < 5, "middle").otherwise("late").alias("place"))
    made = winner.fit_winner(lines, ["l_linenumber"], "place", [training.CvResult(training.FOREST, [1.0], {"n_estimators": 5, "max_depth": 4})], "classification")
    path = scratch(spark, "classes")
    made.save(spark, path, "r1")
    scored = winner.Winner.load(spark, path, "r1").predict(lines)
    return scored.groupBy("l_linenumber", "prediction").agg(F.count("*").alias("n"))


CAT.add(
    "r1_class_names", _class_names,
    "SELECT l_linenumber, CASE WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber < 5 THEN 'middle' ELSE 'late' END AS prediction, count(*) AS n FROM lineitem GROUP BY ALL",
)


def _orders_scorer(spark: SparkSession, d: str) -> scoring.Scorer:
    o = table(spark, d, "orders")
    train = o.where(hash32("o_orderkey") % 5 != 0)
    features = engine.FeatureEngine(
        engine.EngineConfig(keep=("o_orderkey",), type_hints={"o_orderpriority": "categorical"}), target="o_orderstatus"
    ).fit(train)
    matrix = features.transform(train)
    names = features.feature_names
    data = assembled(matrix, names, "o_orderstatus")
    model = training.build_model(training.FOREST, "classification", {"n_estimators": 5, "max_depth": 4}).fit(data)
    return scoring.Scorer(features, model)


def _score(spark: SparkSession, d: str) -> DataFrame:
    scorer = _orders_scorer(spark, d)
    path = scratch(spark, "scorer")
    scorer.save(path, "r1", spark)
    scoring.register_run(spark, path, "r1", training.FOREST)
    newest = scoring.Scorer.load(path, scoring.latest_run(spark, path), spark)
    return newest.submit(table(spark, d, "orders"), output.OutputFormat("o_orderkey", "status", "categorical"))


CAT.add("r1_score", _score)

# -- streams: the tables arrive as files and are read until they are used up ------------------------------------


def _as_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files, one file or a folder of part files, as a stream of one-file batches. The pattern stands for the
    one name, which makes Spark list what it finds there."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}.parque[t]")


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run to the end into a Parquet table and read that."""
    path = scratch(spark, name)
    query = streams.append_log(stream, f"{path}/out", f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _stream_features(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    model = engine.FeatureEngine(engine.EngineConfig(keep=("o_orderkey",), type_hints={"o_orderpriority": "categorical"}), target="o_orderstatus").fit(o)
    small = model.select(["o_orderpriority_encoded", "o_orderpriority_frequency", "o_orderdate_year", "o_totalprice_above_median"])
    return _run(spark, streams.stream_features(_as_stream(spark, d, "orders"), small), "features")


CAT.add(
    "u1_stream_features", _stream_features,
    """WITH v AS (SELECT o_orderpriority, count(*) AS cnt, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderstatus, CAST(code AS DOUBLE) AS o_orderpriority_encoded, CAST(cnt AS DOUBLE) AS o_orderpriority_frequency, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year,
 CAST(o_totalprice > (SELECT median(o_totalprice) FROM orders) AS DOUBLE) AS o_totalprice_above_median FROM orders JOIN v USING (o_orderpriority)""",
)
CAT.add(
    "u2_stream_score",
    lambda spark, d: _run(
        spark, streams.stream_score(_as_stream(spark, d, "orders"), _orders_scorer(spark, d)).select("o_orderkey", "prediction", "confidence"), "scores"
    ),
)
CAT.add(
    "u3_stream_dedup",
    lambda spark, d: _run(
        spark, streams.stream_distinct(_as_stream(spark, d, "events"), ["user_id", "event_type"]), "dedup",
    ),
    "SELECT DISTINCT user_id, event_type FROM events",
)


def _stream_profile(spark: SparkSession, d: str) -> DataFrame:
    """All windows, the open one too: each batch replaces the table of windows."""
    shown = streams.stream_profile(_as_stream(spark, d, "events").select("ts", "value"), "ts", "value", "1 day", delay="1 hour")
    path = scratch(spark, "profile")
    streams.replace_table(shown, path, f"{path}-checkpoint").awaitTermination()
    out = streams.read_table(spark, path, shown.schema)
    return out.select(
        F.unix_seconds("window_start").alias("day"), "n", "nulls", F.round("mean", 10).alias("mean"), F.round("std", 6).alias("std"), "min", "max"
    )


CAT.add(
    "u4_stream_profile", _stream_profile,
    """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n, count(*) - count(value) AS nulls, round(avg(value), 10) AS mean, round(stddev_pop(value), 6) AS std,
 min(value) AS min, max(value) AS max FROM events GROUP BY 1""",
)
