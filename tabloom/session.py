"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.scheduler.mode": "FAIR",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local folder only for local masters."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def is_scan(df: DataFrame) -> bool:
    """Whether the rows come from their source without a shuffle, a broadcast or a cache."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not ("Exchange" in plan or "InMemoryTableScan" in plan or "Adaptive" in plan)


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input that has fewer partitions than the cluster has cores (a few files with one row group
    each) over all cores, before work that costs more than the shuffle. Larger inputs pass unchanged.

    Plans that shuffle, broadcast or read a cache pass unchanged too: asking for their partitions would run them.
    """
    if not is_scan(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored_columns(df: DataFrame) -> DataFrame:
    """A Parquet table next to the checkpoints: cuts the lineage as `cut_lineage` does, for rows that many passes read by column."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/columns-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of an executor and keep their chunk."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
