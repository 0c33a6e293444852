"""Declared cleaning, validation and train/test splits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import hash32
from tabloom.operators.folds import below_cutoff
from tabloom.operators.profile import clean, column_values, kind_of, nan_to_null, null_counts, profilable
from tabloom.operators.quantiles import exact_medians, exact_quantiles


def drop_dups(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on a tie; one row per column reaches the driver."""
    if not columns:
        return {}
    best = column_values(df, columns).groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("cnt")).alias("c"), F.col("value"))).alias("mode")
    )
    return {r["column"]: r["mode"] for r in best.collect()}


def auto_fill_values(df: DataFrame) -> dict[str, object]:
    """Median for numbers, mode for texts; only for columns that have nulls."""
    holes = {r["column"] for r in null_counts(df).where(F.col("nulls") > 0).collect()}
    fields = [f for f in profilable(df) if f.name in holes]
    numbers = {f.name: clean(f.name, f.dataType) for f in fields if kind_of(f.dataType) == "numeric"}
    fills: dict[str, object] = {k: v for k, v in exact_medians(df, numbers).items() if v is not None}
    texts = [f.name for f in fields if kind_of(f.dataType) == "string"]
    fills.update(modes(df, texts))
    return fills


def fill_missing(df: DataFrame, strategy: str = "auto") -> DataFrame:
    """``auto`` fills with median or mode, ``drop`` removes rows with nulls, ``none`` changes nothing."""
    if strategy == "none":
        return df
    df = nan_to_null(df)
    if strategy == "drop":
        return df.na.drop()
    if strategy != "auto":
        raise ValueError(f"unknown missing strategy '{strategy}'")
    return fill_values(df, auto_fill_values(df))


def fill_values(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Per-column fills. A fractional fill turns an integer column into a double one, as it must."""
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = {}
    for name, value in fills.items():
        whole = isinstance(types[name], (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        fits = not whole or float(value).is_integer()
        target = types[name] if fits else T.DoubleType()
        exprs[name] = F.coalesce(F.col(name).cast(target), F.lit(value).cast(target))
    return df.withColumns(exprs) if exprs else df


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


# Declared type names and the Spark type they stand for.
TYPE_NAMES = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "datetime": "timestamp"}


def check_types(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows): a row is rejected if a present value does not fit its declared type."""
    casts = {c: F.col(c).try_cast(TYPE_NAMES.get(t, t)) for c, t in types.items()}
    bad = F.lit(False)
    for name, cast in casts.items():
        bad = bad | (F.col(name).isNotNull() & cast.isNull())
    return df.where(~bad).withColumns(casts), df.where(bad)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def split_random(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` from a hash of the key: the same rows on any cluster and after any restart."""
    cut = round(test_size * 10_000)
    return df.withColumn("is_test", (hash32(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))) % 10_000) < cut)


def split_stratified(df: DataFrame, key: str, label: str, test_size: float = 0.2) -> DataFrame:
    """Adds ``is_test`` with the class shares kept exactly (up to one row per class)."""
    return below_cutoff(df, label, hash32(key), test_size, "is_test")


def split_time(df: DataFrame, time_column: str, test_size: float = 0.2) -> DataFrame:
    """The newest share by time is the test part; one cutoff value, no sort."""
    micros = F.unix_micros(F.col(time_column).cast("timestamp"))
    found = exact_quantiles(df, {"t": micros}, [1.0 - test_size])["t"]
    if found is None:
        return df.withColumn("is_test", F.lit(False))
    return df.withColumn("is_test", F.coalesce(micros > F.lit(found[0]), F.lit(False)))


def split_custom(df: DataFrame, is_test: Column) -> DataFrame:
    return df.withColumn("is_test", F.coalesce(is_test, F.lit(False)))


@dataclass(frozen=True)
class IngestConfig:
    drop_duplicates: bool = False
    missing_strategy: str = "none"
    fill_values: dict = field(default_factory=dict)
    required_columns: tuple[str, ...] = ()
    column_types: dict = field(default_factory=dict)
    drop_columns: tuple[str, ...] = ()
    rename_columns: dict = field(default_factory=dict)


def ingest(df: DataFrame, config: IngestConfig) -> tuple[DataFrame, DataFrame | None]:
    """All declared steps in order; also the rows that failed the type check, if types were declared."""
    require_columns(df, list(config.required_columns))
    rejects = None
    if config.column_types:
        df, rejects = check_types(df, config.column_types)
    if config.drop_duplicates:
        df = drop_dups(df)
    if config.fill_values:
        df = fill_values(df, config.fill_values)
    df = fill_missing(df, config.missing_strategy)
    if config.drop_columns:
        df = drop_columns(df, list(config.drop_columns))
    if config.rename_columns:
        df = rename_columns(df, config.rename_columns)
    return df, rejects
