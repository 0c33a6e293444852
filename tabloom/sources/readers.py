"""Reading tables. Filters and column choice are left to Catalyst and the source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Source type names that are read through JDBC.
JDBC_TYPES = {"sql", "postgresql", "mysql", "sqlite"}
FILE_TYPES = {"csv", "parquet", "json", "orc", "text"}


@dataclass(frozen=True)
class SourceConfig:
    type: str
    path: str | None = None
    url: str | None = None
    table: str | None = None
    schema_name: str | None = None
    query: str | None = None
    where: str | None = None
    limit: int | None = None
    schema: StructType | None = None
    options: dict = field(default_factory=dict)
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    # without a schema Spark reads the files twice; give one for large inputs
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def load_pair(
    spark: SparkSession, train_path: str, test_path: str, fmt: str = "csv", schema: StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """Training and test table; the test schema is the training schema without the target."""
    if fmt != "csv":
        return spark.read.format(fmt).load(train_path), spark.read.format(fmt).load(test_path)
    train = read_csv(spark, train_path, schema)
    test = read_csv(spark, test_path)
    shared = {f.name: f for f in train.schema.fields}
    pinned = StructType([shared.get(f.name, f) for f in test.schema.fields])
    return train, read_csv(spark, test_path, pinned)


def jdbc_options(config: SourceConfig) -> dict[str, str]:
    if not config.query and not config.table:
        raise ValueError("a database source needs a query or a table")
    options = dict(config.options)
    options["url"] = config.url or ""
    table = f"{config.schema_name}.{config.table}" if config.schema_name else config.table
    # a partitioned read is only possible on dbtable, so a query goes in as a derived table
    options["dbtable"] = f"({config.query}) q" if config.query else table
    if config.partition_column:
        bounds = (config.lower_bound, config.upper_bound, config.num_partitions)
        if any(b is None for b in bounds):
            raise ValueError("a partitioned read needs lower_bound, upper_bound and num_partitions")
        options.update(
            partitionColumn=config.partition_column,
            lowerBound=str(config.lower_bound),
            upperBound=str(config.upper_bound),
            numPartitions=str(config.num_partitions),
        )
    return options


def scan_source(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """Read by source type. Any other type is taken as the name of a Spark data source on the class path."""
    kind = config.type.lower()
    if kind in JDBC_TYPES:
        df = spark.read.format("jdbc").options(**jdbc_options(config)).load()
    elif kind == "csv":
        df = read_csv(spark, config.path, config.schema)
    else:
        reader = spark.read.format(kind if kind in FILE_TYPES else config.type).options(**config.options)
        if config.schema is not None:
            reader = reader.schema(config.schema)
        df = reader.load(config.path) if config.path else reader.load()
    return source_filter(df, config.where, config.limit)


def source_filter(df: DataFrame, where: str | None = None, limit: int | None = None) -> DataFrame:
    if where:
        df = df.where(where)
    return df.limit(limit) if limit is not None else df


def preview(df: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """First rows by key, so the preview does not depend on the partitioning."""
    return df.orderBy(*key).limit(n)
