"""Category vocabularies: counts, codes and their join onto rows.

A vocabulary is a table (column, value, cnt, code, kept). It is never collected. It is broadcast only
after its rows and bytes were measured; beyond the bound it joins by shuffle, and its own counts tell
which values are hot, so those few are matched by broadcast and never shuffled to one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from tabloom.operators.ordered import GROUP_ROWS, row_number
from tabloom.operators.profile import column_values
from tabloom.session import cut_lineage

BROADCAST_BYTES = 32 * 1024 * 1024
HOT_SHARE = 1000
OTHER = "OTHER"


@dataclass(frozen=True)
class CategoricalConfig:
    encoding_method: str = "label"  # "label", "onehot" or "target"
    enable_frequency: bool = True
    enable_rarity: bool = True
    min_frequency: int = 2
    max_categories: int = 50
    limit_codes: bool = False


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return column_values(df, columns)


def _top_and_rest(counts: DataFrame, max_categories: int) -> DataFrame:
    """The most frequent values of columns above the limit; the others are summed in a row whose value is null, so that
    the row can never meet a value of the data."""
    sizes = counts.groupBy("column").agg(F.count("*").alias("size"), F.sum("cnt").alias("total"))
    most = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("value"))
    # a rank limit lets each task drop all but its own best rows before the shuffle
    best = counts.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= max_categories)
    joined = best.join(F.broadcast(sizes), "column")
    kept = joined.where((F.col("size") <= max_categories) | (F.col("rank") < max_categories))
    rest = kept.groupBy("column").agg(F.max("size").alias("size"), (F.max("total") - F.sum("cnt")).alias("cnt"))
    other = rest.where(F.col("size") > max_categories).select("column", F.lit(None).cast("string").alias("value"), "cnt")
    return kept.select("column", "value", "cnt").unionByName(other)


def top_categories(counts: DataFrame, max_categories: int) -> DataFrame:
    """Columns above the limit keep their most frequent values; the rest is summed as OTHER, together with a real value of
    that name: one row per column and value."""
    named = _top_and_rest(counts, max_categories).withColumn("value", F.coalesce("value", F.lit(OTHER)))
    return named.groupBy("column", "value").agg(F.sum("cnt").alias("cnt"))


def label_codes(counts: DataFrame, bound: int = GROUP_ROWS, chunks: int | None = None) -> DataFrame:
    """Counts plus ``code``: position of the value in sorted order within its column, from 0."""
    numbered = row_number(counts, ["column"], ["value"], "code", bound, chunks)
    return numbered.withColumn("code", (F.col("code") - 1).cast("bigint"))


VOCAB_SCHEMA = "column string, value string, cnt bigint, code bigint, kept boolean"


def fit_vocabulary(df: DataFrame, columns: list[str], config: CategoricalConfig = CategoricalConfig()) -> DataFrame:
    """(column, value, cnt, code, kept) for the given columns, from one count of values.

    With ``limit_codes`` values outside the top share one row, whose value is null: the vocabulary is bounded by
    ``max_categories`` rows per column and becomes a local table. Without it every value has a code,
    ``kept`` marks the top ones, and the table stays distributed, written to the checkpoint folder.
    """
    if config.limit_codes:
        top = _top_and_rest(value_counts(df, columns), config.max_categories).collect()
        place: dict[str, int] = {}
        rows = []
        # the rest row has its code at the place of its name, after a real value of that name
        for column, value, cnt in sorted(((r["column"], r["value"], r["cnt"]) for r in top), key=lambda r: (r[0], r[1] or OTHER, r[1] is None)):
            rows.append((column, value, cnt, place.get(column, 0), True))
            place[column] = place.get(column, 0) + 1
        return df.sparkSession.createDataFrame(rows, VOCAB_SCHEMA)
    counts = cut_lineage(value_counts(df, columns))
    top = _top_and_rest(counts, config.max_categories).where("value IS NOT NULL").select("column", "value")
    coded = label_codes(counts).join(F.broadcast(top.withColumn("kept", F.lit(True))), ["column", "value"], "left")
    return cut_lineage(coded.withColumn("kept", F.coalesce("kept", F.lit(False))))


def vocabulary_size(vocab: DataFrame) -> dict[str, tuple[int, int]]:
    """Rows and approximate bytes per column, one small aggregate."""
    rows = vocab.groupBy("column").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + F.lit(40)).alias("bytes")
    ).collect()
    return {r["column"]: (r["rows"], r["bytes"]) for r in rows}


def join_vocabulary(
    df: DataFrame,
    vocab: DataFrame,
    column: str,
    source: Column,
    fields: list[str],
    prefix: str,
    vocab_bytes: int,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of one column's vocabulary; result columns are ``prefix + field``."""
    part = vocab.where(F.col("column") == column).select(
        F.col("value").alias(f"{prefix}value"), *[F.col(f).alias(f"{prefix}{f}") for f in fields]
    )
    key = f"{prefix}key"
    keyed = df.withColumn(key, source)
    if vocab_bytes <= broadcast_bytes:
        return keyed.join(F.broadcast(part), F.col(key) == F.col(f"{prefix}value"), "left").drop(key, f"{prefix}value")
    return _hot_split_join(keyed, vocab, column, part, key, fields, prefix)


def _hot_split_join(
    keyed: DataFrame, vocab: DataFrame, column: str, part: DataFrame, key: str, fields: list[str], prefix: str
) -> DataFrame:
    counts = vocab.where(F.col("column") == column)
    total = counts.agg(F.sum("cnt")).first()[0] or 0
    floor = max(1, total // HOT_SHARE)
    # at most HOT_SHARE values can each hold 1/HOT_SHARE of the rows, so this side is bounded
    hot = counts.where(F.col("cnt") > floor).select(
        F.col("value").alias("__hv"), F.lit(True).alias("__hot"), *[F.col(f).alias(f"__h_{f}") for f in fields]
    )
    first = keyed.join(F.broadcast(hot), F.col(key) == F.col("__hv"), "left").drop("__hv")
    settled = F.coalesce("__hot", F.lit(False)) | F.col(key).isNull()
    # settled rows find no partner; a row hash spreads them over all tasks instead of one null partition
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(f"`{c}`") for c in first.columns]).cast("string"))
    second = first.withColumn("__k", F.when(settled, spread).otherwise(F.col(key)))
    joined = second.join(part, F.col("__k") == F.col(f"{prefix}value"), "left")
    for f in fields:
        joined = joined.withColumn(f"{prefix}{f}", F.coalesce(F.col(f"__h_{f}"), F.col(f"{prefix}{f}")))
    return joined.drop("__k", "__hot", key, f"{prefix}value", *[f"__h_{f}" for f in fields])


def unseen_values(df: DataFrame, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cnt) of values the vocabulary does not know."""
    return value_counts(df, columns).join(vocab.select("column", "value"), ["column", "value"], "left_anti")


def one_hot(value: Column, categories: list[str], name: str) -> dict[str, Column]:
    """0/1 columns for a bounded list of categories; an unknown value has only zeros."""
    return {
        f"{name}_is_{i}": F.coalesce(value == F.lit(c), F.lit(False)).cast("int") for i, c in enumerate(categories)
    }


def fold_target_sums(df: DataFrame, column: str, target: str, fold: Column) -> DataFrame:
    """(value, fold, s, n): target sums per value and fold, map-side combined."""
    return df.groupBy(F.col(column).cast("string").alias("value"), fold.alias("fold")).agg(
        F.sum(F.col(target).cast("double")).alias("s"), F.count(target).alias("n")
    )


def target_encoding(df: DataFrame, column: str, target: str, fold: Column) -> DataFrame:
    """(value, fold, encoded): mean of the target over the value's rows outside the fold.

    A value seen in one fold only gets the overall mean outside that fold.
    """
    sums = fold_target_sums(df, column, target, fold)
    by_value = sums.groupBy("value").agg(F.sum("s").alias("vs"), F.sum("n").alias("vn"))
    # one row per fold; the few overall means become literals
    per_fold = {r["fold"]: (r["fs"] or 0.0, r["fn"]) for r in sums.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn")).collect()}
    all_s, all_n = sum(s for s, _ in per_fold.values()), sum(n for _, n in per_fold.values())
    fallback = F.lit(None).cast("double")
    for f, (s, n) in per_fold.items():
        if all_n > n:
            fallback = F.when(F.col("fold") == F.lit(f), F.lit((all_s - s) / (all_n - n))).otherwise(fallback)
    return sums.join(by_value, "value").select(
        "value", "fold",
        F.coalesce(F.try_divide(F.col("vs") - F.col("s"), F.col("vn") - F.col("n")), fallback).alias("encoded"),
    )
