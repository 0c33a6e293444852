"""Changes on a stream equal the batch form, in any file order and after a restart."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabloom.operators.telemetry import latest_state, suppress_unchanged
from tabloom.streaming import changes

SCHEMA = "run string, ts timestamp, id bigint, v string"
START = datetime(2024, 1, 1)


def events(n=400, seed=3):
    rng = random.Random(seed)
    # a third of all events belong to one run; values stay for a while; times repeat
    return [(rng.choice(["hot", "a", "b", None, "c", "hot"]), START + timedelta(minutes=i // 2), i, rng.choice(["x", "x", "x", "y", None])) for i in range(n)]


def batch_form(df):
    return {r["id"] for r in suppress_unchanged(df.withColumn("k", F.struct("run")), ["k"], ["ts", "id"], "v").collect()}


def run(spark, source, path, delay):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    changes.stream_changes(stream, path, f"{path}-checkpoint", ["run"], ["ts", "id"], "ts", "v", delay, buckets=5).awaitTermination()


def put(spark, rows, source, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{source}-{n}")
    __import__("pathlib").Path(source).mkdir(exist_ok=True)
    part = next(__import__("pathlib").Path(f"{source}-{n}").glob("part-*"))
    shutil.copy(part, f"{source}/{n}.parquet")


@pytest.mark.parametrize("order", ["sorted", "shuffled"])
def test_equal_to_the_batch_form(spark, tmp_path, order):
    rows = events()
    parts = [rows[i : i + 80] for i in range(0, 400, 80)]
    if order == "shuffled":
        mixed = rows[:]
        random.Random(9).shuffle(mixed)
        parts = [mixed[i : i + 80] for i in range(0, 400, 80)]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    delay = 86_400 if order == "shuffled" else 600
    for n, part in enumerate(parts):  # a new query each time: every batch is a restart
        put(spark, part, source, n)
        run(spark, source, path, delay)
        seen = spark.createDataFrame([r for p in parts[: n + 1] for r in p], SCHEMA)
        got = changes.read_changes(spark, path, seen.schema)
        if n in (1, 4):
            assert {r["id"] for r in got.collect()} == batch_form(seen)
    assert len(changes.folders(spark, f"{path}/manifest")) <= 2
    last = changes.latest_per_key(spark, path, seen.schema, ["run"], ["ts", "id"], ["v", "id"])
    assert sorted(map(str, last.collect())) == sorted(map(str, latest_state(seen, "run", ["ts", "id"], ["v", "id"]).collect()))


def test_many_files_in_one_go_and_a_batch_that_runs_again(spark, tmp_path):
    rows = events(200)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(4):
        put(spark, rows[n * 50 : (n + 1) * 50], source, n)
    run(spark, source, path, 3600)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["id"] for r in changes.read_changes(spark, path, df.schema).collect()} == batch_form(df)
    number = max(changes._versions(spark, path))
    again = spark.createDataFrame(rows[150:], SCHEMA)
    changes.merge_batch(again, number, path, ["run"], ["ts", "id"], "ts", "v", 3600, 5)
    assert {r["id"] for r in changes.read_changes(spark, path, df.schema).collect()} == batch_form(df)


def test_settled_events_leave_the_state(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", START + timedelta(minutes=i), i, "same") for i in range(300)]
    for n in range(3):
        changes.merge_batch(spark.createDataFrame(rows[n * 100 : (n + 1) * 100], SCHEMA), n, path, ["run"], ["ts", "id"], "ts", "v", 600, 3)
    held = spark.read.parquet(f"{path}/events/version=2")
    assert held.count() == 1 + 1 + 11 and [r["id"] for r in changes.read_changes(spark, path, spark.createDataFrame(rows[:1], SCHEMA).schema).collect()] == [0]


def test_empty_batches_and_no_state(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    changes.merge_batch(none, 0, str(tmp_path / "out"), ["run"], ["ts", "id"], "ts", "v", 600)
    assert changes.read_changes(spark, str(tmp_path / "out"), none.schema).count() == 0
    changes.merge_batch(spark.createDataFrame([("a", None, 1, "x"), ("a", None, 2, "x")], SCHEMA), 1, str(tmp_path / "out"), ["run"], ["ts", "id"], "ts", "v", 600)
    assert [r["id"] for r in changes.read_changes(spark, str(tmp_path / "out"), none.schema).collect()] == [1]
