"""Ordered operations per key that hold when one key has most of the rows.

A plain window puts all rows of a key in one task. These functions first count rows per key (map-side
combined). If every key is below the bound the plain window is used. Otherwise rows are range-partitioned
by (keys, order) into chunks, the work is done per chunk, and what crosses a chunk border (a running
total, the last value before) is carried over through a table with one row per key and chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window

from tabloom.session import cut_lineage

GROUP_ROWS = 2_000_000
CHUNK = "__chunk"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    if not keys:
        return df.count()
    row = df.groupBy(*keys).agg(F.count("*").alias("cnt")).agg(F.max("cnt")).first()
    return row[0] or 0


def chunked(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Rows with a chunk number that rises with (keys, order). Checkpointed, so numbers never change."""
    n = chunks or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return cut_lineage(ranged)


def _window(keys: list[str], order: list[str]) -> Window:
    # with no keys there is one chunk column to partition by, or a bounded table
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)


def _carry(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    plain: Callable[[Window], Column],
    summary: Column,
    before: Callable[[Window], Column],
    merge: Callable[[Window, Column], Column],
    out: str,
    bound: int,
    chunks: int | None,
) -> DataFrame:
    if largest_group(df, keys) <= bound:
        return df.withColumn(out, plain(_window(keys, order)))
    parts = chunked(df, keys, order, chunks)
    per_chunk = parts.groupBy(*keys, CHUNK).agg(summary.alias("__s"))
    carried = per_chunk.select(*keys, CHUNK, before(_window(keys, [CHUNK])).alias("__before"))
    joined = parts.join(carried, [*keys, CHUNK], "left")
    result = joined.withColumn(out, merge(_window([*keys, CHUNK], order), F.col("__before")))
    return result.drop(CHUNK, "__before")


_UP_TO_LAST = (Window.unboundedPreceding, -1)


def running_max(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bound: int = GROUP_ROWS, chunks: int | None = None
) -> DataFrame:
    upto = (Window.unboundedPreceding, Window.currentRow)
    return _carry(
        df, keys, order,
        plain=lambda w: F.max(value).over(w.rowsBetween(*upto)),
        summary=F.max(value),
        before=lambda w: F.max("__s").over(w.rowsBetween(*_UP_TO_LAST)),
        merge=lambda w, b: F.greatest(F.max(value).over(w.rowsBetween(*upto)), b),
        out=out, bound=bound, chunks=chunks,
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bound: int = GROUP_ROWS, chunks: int | None = None
) -> DataFrame:
    upto = (Window.unboundedPreceding, Window.currentRow)
    return _carry(
        df, keys, order,
        plain=lambda w: F.sum(value).over(w.rowsBetween(*upto)),
        summary=F.sum(value),
        before=lambda w: F.sum("__s").over(w.rowsBetween(*_UP_TO_LAST)),
        merge=lambda w, b: F.sum(value).over(w.rowsBetween(*upto)) + F.coalesce(b, F.lit(0)),
        out=out, bound=bound, chunks=chunks,
    )


def row_number(
    df: DataFrame, keys: list[str], order: list[str], out: str, bound: int = GROUP_ROWS, chunks: int | None = None
) -> DataFrame:
    """1-based position of each row within its key."""
    return _carry(
        df, keys, order,
        plain=lambda w: F.row_number().over(w).cast("bigint"),
        summary=F.count(F.lit(1)),
        before=lambda w: F.sum("__s").over(w.rowsBetween(*_UP_TO_LAST)),
        merge=lambda w, b: F.row_number().over(w) + F.coalesce(b, F.lit(0)),
        out=out, bound=bound, chunks=chunks,
    )


def previous(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bound: int = GROUP_ROWS, chunks: int | None = None
) -> DataFrame:
    """Value of the row before, per key; null for the first row of a key."""
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    return _carry(
        df, keys, order,
        plain=lambda w: F.lag(value).over(w),
        summary=last,
        before=lambda w: F.lag("__s").over(w)["v"],
        merge=lambda w, b: F.when(F.row_number().over(w) == 1, b).otherwise(F.lag(value).over(w)),
        out=out, bound=bound, chunks=chunks,
    )
