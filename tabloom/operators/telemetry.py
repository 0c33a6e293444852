"""Questions about run events: an append-only table (run, kind, ts, value, unique event key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tabloom.operators.ordered import GROUP_ROWS, previous, running_max


def trial_log(df: DataFrame, model: str, trial: Column, score: str, ts: str) -> DataFrame:
    return df.select(F.col(model).alias("model"), trial.alias("trial"), F.col(score).alias("score"), F.col(ts).alias("ts"))


def running_best(df: DataFrame, keys: list[str], order: list[str], score: str, bound: int = GROUP_ROWS, chunks: int | None = None) -> DataFrame:
    return running_max(df, keys, order, score, "best_score", bound, chunks)


def latest_state(df: DataFrame, run: str, order: list[str], fields: list[str]) -> DataFrame:
    """Last event of each run: an aggregate, so a busy run is combined map-side."""
    last = F.max_by(F.struct(*fields), F.struct(*order)).alias("s")
    return df.groupBy(run).agg(last).select(run, "s.*")


def stage_durations(df: DataFrame, run: str, stage: str, ts: str) -> DataFrame:
    """Whole seconds between the first and last event of each stage of a run."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.groupBy(run, stage).agg(
        F.floor((F.max(micros) - F.min(micros)) / F.lit(1_000_000)).cast("bigint").alias("duration_seconds"),
        F.count("*").alias("events"),
    )


def completion_pct(df: DataFrame, run: str, done: Column, total: Column) -> DataFrame:
    """Share of finished work per run in percent, kept within 0 and 100."""
    counted = df.groupBy(run).agg(F.sum(F.when(done, 1).otherwise(0)).alias("done"), total.alias("total"))
    pct = F.coalesce(F.try_divide(F.col("done") * F.lit(100.0), F.col("total")), F.lit(0.0))
    return counted.select(run, "done", "total", F.least(F.greatest(pct, F.lit(0.0)), F.lit(100.0)).alias("pct"))


def list_runs(df: DataFrame, run: str, ts: str) -> DataFrame:
    """One summary row per run, newest first."""
    return df.groupBy(run).agg(
        F.min(ts).alias("started"), F.max(ts).alias("last_seen"), F.count("*").alias("events")
    ).orderBy(F.desc("last_seen"), F.asc(run))


def get_run(df: DataFrame, run: str, run_id: object) -> DataFrame:
    return df.where(F.col(run) == F.lit(run_id))


def suppress_unchanged(df: DataFrame, keys: list[str], order: list[str], value: str, bound: int = GROUP_ROWS, chunks: int | None = None) -> DataFrame:
    """Events whose value differs from the event before in the same run; the first one always counts."""
    tagged = previous(df.withColumn("__seen", F.struct(F.col(value).alias("v"))), keys, order, "__seen", "__last", bound, chunks)
    changed = F.col("__last").isNull() | ~F.col("__last.v").eqNullSafe(F.col(value))
    return tagged.where(changed).drop("__seen", "__last")


def tuning_summary(df: DataFrame, model: str, order: list[str], score: str, last: int = 5) -> DataFrame:
    """Per model: number of trials, best score and spread of the last trials."""
    newest = Window.partitionBy(model).orderBy(*[F.desc(c) for c in order])
    # a rank limit keeps at most ``last`` rows per model and task before the shuffle
    recent = df.select(model, score, *order).withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= last)
    spread = recent.groupBy(model).agg(F.stddev_pop(score).alias("recent_std"))
    overall = df.groupBy(model).agg(F.count("*").alias("trials"), F.max(score).alias("best_score"))
    return overall.join(spread, model)
