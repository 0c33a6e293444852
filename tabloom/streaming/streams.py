"""The fitted features, scores and profiles on streams.

Everything here takes a streaming DataFrame and gives one back; sinks and triggers are the caller's. The
output columns are fixed at fit time, so a query can restart from its checkpoint after a refit only with a
new checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.engine import FeatureModel
from tabloom.plans.scoring import Scorer


def stream_features(stream: DataFrame, model: FeatureModel) -> DataFrame:
    """The batch projection on a stream; vocabularies join as a static side."""
    return model.transform(stream)


def stream_score(stream: DataFrame, scorer: Scorer) -> DataFrame:
    return scorer.score(stream)


def stream_dedup(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First row per key; keys are forgotten once the watermark has passed them, so state stays bounded."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_distinct(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key over all time: no key is forgotten, so the state grows with the number of keys."""
    return stream.select(*keys).dropDuplicates(keys)


def stream_profile(stream: DataFrame, ts: str, value: str, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows, nulls and moments of a value per time window, for watching drift."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    v = F.col(value).cast("double")
    return stamped.groupBy(span.alias("w")).agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    ).select(F.col("w.start").alias("window_start"), "n", "nulls", "mean", "std", "min", "max")


def stream_latest_state(stream: DataFrame, run: str, ts: str, fields: list[str]) -> DataFrame:
    """Newest event per run; to be written in update or complete mode."""
    last = F.max_by(F.struct(*fields), F.struct(ts, *fields)).alias("s")
    return stream.groupBy(run).agg(last).select(run, "s.*")


def append_log(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once per checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replace_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole present result of an aggregating stream: every batch writes a version of its own, and read_table
    takes the newest. A batch that runs again writes the same version."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version written by replace_table."""
    newest = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.LongType())])).parquet(path).agg(F.max("version")).first()[0]
    return spark.read.schema(schema).parquet(f"{path}/version={newest}")
