"""Shared parts of the registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tabloom.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, each with the SQL that gives the same rows where SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
        if sql is not None:
            self.sql[name] = sql

    def update(self, other: Catalog) -> None:
        self.queries.update(other.queries)
        self.sql.update(other.sql)


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and decimals as double, so both engines give the same types."""
    casts = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            casts[f.name] = F.col(f"`{f.name}`").cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            casts[f.name] = F.col(f"`{f.name}`").cast("double")
    return df.withColumns(casts) if casts else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no nulls; these are put in by key, the same way in SQL (ORDERS_N)."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.withColumns(
        {
            "o_totalprice": F.when(key % 10 != 0, F.col("o_totalprice")),
            "o_orderpriority": F.when(key % 7 != 0, F.col("o_orderpriority")),
            "o_orderdate": F.when(key % 11 != 0, F.col("o_orderdate")),
        }
    )


ORDERS_N = """orders_n AS (SELECT o_orderkey, o_custkey, o_orderstatus,
 CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS o_orderdate,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


def sql_hash(key: str) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, so all executors can reach it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
