"""Changes only, on a stream: an event counts if its value differs from the one before it in the same run.

The state is a table in files: per bucket of keys the events that still matter, each with whether it is a change. A batch
rewrites the buckets it touches and nothing else, as a version of its own, and a small manifest says which version of
which bucket holds. A batch that runs again writes the same version; a restart goes on from the newest manifest.

Events may come in any order as long as they are at most ``delay`` behind the newest one seen: all events of that span
are kept, so a late one is put between its neighbours and both are judged again. Older events are settled: of them only
changes stay, and the last of each key, so the state grows with the changes, not with the events. An event later than
``delay`` is judged against what stayed: it may be reported where the batch form would not, and never removes a change
that was settled. Versions that no manifest needs any more are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.ordered import GROUP_ROWS, previous

BUCKETS = 64
_MANIFEST = "bucket int, version bigint, newest timestamp"


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, on any file system Spark reaches; none if it is absent."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that were written to the end."""
    found = []
    for name in folders(spark, f"{path}/manifest"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{name}/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def _manifest(spark: SparkSession, path: str, version: int) -> list:
    """One row per bucket that has events."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect()


def _events(spark: SparkSession, path: str, rows: list, schema: T.StructType) -> DataFrame:
    files = sorted(f"{path}/events/version={r.version}/bucket={r.bucket}" for r in rows)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _state_schema(events: DataFrame) -> T.StructType:
    return T.StructType([*events.schema.fields, T.StructField("is_change", T.BooleanType())])


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str], ts: str, value: str, delay_seconds: int, buckets: int = BUCKETS, bound: int = GROUP_ROWS) -> None:
    """Put one batch into the state. order: columns that tell a key's events apart, the time first; the same event twice is one."""
    spark = batch.sparkSession
    schema = _state_schema(batch)
    before = [v for v in _versions(spark, path) if v < number]
    old = _manifest(spark, path, before[-1]) if before else []
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")
    fresh = batch.withColumn("bucket", bucket)
    touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}  # at most `buckets` values
    if not touched:
        return
    newest = max([r.newest for r in old if r.newest] + [r[0] for r in fresh.agg(F.max(F.col(ts).cast("timestamp"))).collect() if r[0]], default=None)
    held = _events(spark, path, [r for r in old if r.bucket in touched], schema)
    merged = fresh.drop("bucket").withColumn("is_change", F.lit(None).cast("boolean")).unionByName(held)
    once = merged.groupBy(*keys, *order).agg(F.max_by(F.struct(*[c for c in schema.names if c not in (*keys, *order)]), F.col("is_change").isNotNull().cast("int")).alias("__rest")).select(*keys, *order, "__rest.*")
    seen = once.withColumns({"__keys": F.struct(*keys), "__seen": F.struct(F.col(value).alias("v"))})
    tagged = previous(seen, ["__keys"], order, "__seen", "__prior", bound)
    judged = tagged.withColumn("is_change", F.col("__prior").isNull() | ~F.col("__prior.v").eqNullSafe(F.col(value))).select(*schema.names)
    open_from = F.lit(newest) - F.make_dt_interval(secs=F.lit(delay_seconds)) if newest else F.lit(None).cast("timestamp")
    is_open = F.coalesce(F.col(ts).cast("timestamp") >= open_from, F.lit(newest is None))
    # of the settled events the last of each key stays: the next event is compared with it
    last = judged.where(~is_open).groupBy(*keys).agg(F.max(F.struct(*order)).alias("__last"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}"))
    kept = judged.alias("e").join(last.alias("l"), same, "left").where(is_open | F.col("is_change") | F.struct(*[F.col(f"e.{c}") for c in order]).eqNullSafe(F.col("__last")))
    out = kept.select(*[F.col(f"e.{c}") for c in schema.names]).withColumn("bucket", bucket)
    out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events/version={number}")
    rows = [(b, number, newest) for b in sorted(touched)] + [(r.bucket, r.version, newest) for r in old if r.bucket not in touched]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
    _clean(spark, path, number)


def _clean(spark: SparkSession, path: str, newest: int) -> None:
    """Delete what neither the newest manifest nor the one before it (for a batch that runs again) names."""
    kept = _versions(spark, path)[-2:]
    needed = {r.version for v in kept for r in _manifest(spark, path, v)}
    for folder, alive in (("events", needed), ("manifest", set(kept))):
        for name in folders(spark, f"{path}/{folder}"):
            version = int(name.split("=")[1])
            if version < newest and version not in alive:
                delete_folder(spark, f"{path}/{folder}/{name}")


def stream_changes(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], ts: str, value: str, delay_seconds: int, buckets: int = BUCKETS, available_now: bool = True) -> StreamingQuery:
    """Keep the table of changes of a stream up to date."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch.persist(), number, path, keys, order, ts, value, delay_seconds, buckets)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The changes so far, with the stream's columns."""
    done = _versions(spark, path)
    rows = _manifest(spark, path, done[-1]) if done else []
    return _events(spark, path, rows, T.StructType([*schema.fields, T.StructField("is_change", T.BooleanType())])).where("is_change").drop("is_change")


def latest_per_key(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The last known state of every key, from the same table: bounded by the keys, unlike an aggregation on the stream."""
    done = _versions(spark, path)
    rows = _manifest(spark, path, done[-1]) if done else []
    held = _events(spark, path, rows, T.StructType([*schema.fields, T.StructField("is_change", T.BooleanType())]))
    return held.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("s")).select(*keys, "s.*")
