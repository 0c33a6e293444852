"""Fold and split columns from hashes of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.hashing import bucket, hash32
from tabloom.operators.quantiles import hash_cutoffs
from tabloom.session import cut_lineage

SMALL_ROWS = 10_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint only after counting that the table has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kfold(df: DataFrame, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    return df.withColumn(out, bucket(key, k).cast("int"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Folds with the class shares kept: the fold is the number of the class's hash cutoffs below the row's hash."""
    shares = [i / k for i in range(1, k)]
    # at most k - 1 values per class; written once, so that counting them does not compute them again
    cutoffs = cut_lineage(
        hash_cutoffs(df, F.col(label), hash32(key), shares)
        .groupBy("grp").agg(F.sort_array(F.collect_list("cutoff")).alias("__cuts"))
    )
    joined = df.withColumn("__h", hash32(key)).join(
        broadcast_if_small(cutoffs), F.col(label).eqNullSafe(F.col("grp")), "left"
    )
    fold = F.lit(0)
    for i in range(k - 1):
        fold = fold + F.when(F.get("__cuts", F.lit(i)) < F.col("__h"), 1).otherwise(0)
    return joined.withColumn(out, fold).drop("grp", "__cuts", "__h")


def below_cutoff(df: DataFrame, label: str, hashed: Column, share: float, out: str) -> DataFrame:
    """Flags the given share of each class, taking the rows with the smallest hashes."""
    cutoffs = cut_lineage(hash_cutoffs(df, F.col(label), hashed, [share]).select("grp", "cutoff"))
    joined = df.withColumn("__h", hashed).join(
        broadcast_if_small(cutoffs), F.col(label).eqNullSafe(F.col("grp")), "left"
    )
    return joined.withColumn(out, F.coalesce(F.col("__h") <= F.col("cutoff"), F.lit(False))).drop("grp", "cutoff", "__h")
