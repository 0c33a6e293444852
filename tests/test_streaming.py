from pyspark.sql import functions as F

from tabloom.operators import telemetry
from tabloom.plans import engine
from tabloom.streaming import streams


def files(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_features_equal_batch_features(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    model = engine.FeatureEngine(engine.EngineConfig(keep=("o_orderkey",)), target="o_orderstatus").fit(o)
    stream = streams.stream_features(files(spark, o, str(tmp_path / "in")), model)
    streams.append_log(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = model.transform(o)
    assert got.columns == want.columns
    assert got.orderBy("o_orderkey").collect() == want.orderBy("o_orderkey").collect()


def test_latest_state_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    stream = streams.stream_latest_state(files(spark, e, str(tmp_path / "in")), "user_id", "ts", ["event_type", "event_id"])
    query = stream.writeStream.format("memory").queryName("latest_state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["user_id"]: r["event_id"] for r in spark.table("latest_state").collect()}
    want = {r["user_id"]: r["event_id"] for r in telemetry.latest_state(e, "user_id", ["ts", "event_id"], ["event_type", "event_id"]).collect()}
    assert got == want


def test_stream_dedup_over_batches(spark, tmp_path):
    df = spark.range(0, 90).select((F.col("id") % 30).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    stream = streams.stream_dedup(files(spark, df, str(tmp_path / "in")), ["k"], "ts", "1 day")
    streams.append_log(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_registered_streams_read_folders_of_part_files(spark, sf, tmp_path):
    import duckdb

    from tabloom.catalog import modelling
    from oracle_check import compare

    for name in ("orders", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").orderBy(F.rand(3)).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("u1_stream_features", "u3_stream_dedup", "u4_stream_profile"):
        assert compare(spark, con, name, modelling.CAT.queries[name], modelling.CAT.sql[name], str(tmp_path)) == "", name
