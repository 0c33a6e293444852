"""What an adviser is told about a table: target statistics, a profile of the data set, and the context for new features.

Every result is one long table (kind, rank, name, other, value) over all rows. It holds a bounded number of entries per
kind, put together from aggregates with one value per column, class or pair of columns.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.numeric import to_numeric
from tabloom.operators.infer import target_moments, target_shares
from tabloom.operators.profile import clean, kind_of, missing
from tabloom.operators.selection import correlation_matrix

SCHEMA = "kind string, rank int, name string, other string, value double"
FEW_VALUES, MAX_CLASSES = 20, 10
Entry = tuple[str, int, str, str | None, float | None]


def _table(df: DataFrame, entries: list[Entry]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, r, n, o, None if v is None or np.isnan(v) else float(v)) for k, r, n, o, v in entries], SCHEMA)


def _numbers(df: DataFrame, target: str | None) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != target and kind_of(f.dataType) == "numeric"]


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """Shares of the values for texts and for at most FEW_VALUES distinct ones, else mean, std, min and max. All values of a
    text are listed, in order of their share; a target of names is then a table of its own, not a driver list."""
    textual = kind_of(df.schema[target].dataType) not in ("numeric", "boolean")
    few = textual or df.select(target).where(F.col(target).isNotNull()).distinct().limit(FEW_VALUES + 1).count() <= FEW_VALUES
    if few:
        shares = target_shares(df, target)
        return shares.select(F.lit("share").alias("kind"), F.lit(None).cast("int").alias("rank"), F.col("value").cast("string").alias("name"), F.lit(None).cast("string").alias("other"), F.col("share").alias("value"))
    m = target_moments(df, target).first()
    return _table(df, [("moment", i + 1, name, None, m[name]) for i, name in enumerate(("mean", "std", "min", "max"))])


def dataset_profile(df: DataFrame, target: str | None = None, problem: str | None = None, features: list[str] | None = None, top: int = 5) -> DataFrame:
    """Counts of rows, columns and kinds; the ``top`` shares of missing values above 0 and the ``top`` sample variances; for a
    classification the MAX_CLASSES largest classes. One aggregate, one more for the classes."""
    fields = df.schema.fields
    numbers = _numbers(df, None)
    values = {c: clean(c, df.schema[c].dataType).cast("double") for c in numbers}
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)], *[F.var_samp(values[c]).alias(f"v{i}") for i, c in enumerate(numbers)],
    ).first()
    n = row["n"]
    counts = [("rows", n), ("columns", len(fields)), ("numeric", len(numbers)), ("categorical", len(fields) - len(numbers))] + ([("features", len(features))] if features is not None else [])
    entries: list[Entry] = [("count", i + 1, name, None, k) for i, (name, k) in enumerate(counts)]
    gaps = sorted(((-row[f"m{i}"] / n, f.name) for i, f in enumerate(fields) if row[f"m{i}"]))[:top] if n else []
    entries += [("missing", i + 1, name, None, -share) for i, (share, name) in enumerate(gaps)]
    spread = sorted((-row[f"v{i}"], c) for i, c in enumerate(numbers) if row[f"v{i}"] is not None)[:top]
    entries += [("variance", i + 1, name, None, -v) for i, (v, name) in enumerate(spread)]
    if problem == "classification" and target in df.columns:
        classes = target_shares(df, target).orderBy(F.desc("share"), "value").limit(MAX_CLASSES).collect()
        entries += [("class", i + 1, str(r["value"]), None, r["share"]) for i, r in enumerate(classes)]
    return _table(df, entries)


def derived_context(df: DataFrame, target: str | None = None, importances: dict[str, float] | None = None, top: int = 5) -> DataFrame:
    """Material for new features: the top + 1 numeric columns by sample variance and the first pairs of these, the most
    correlated pairs, the columns most correlated with a numeric target or the column means per value of another, the most
    important features and the numeric columns that are not among them."""
    numbers = _numbers(df, target)
    entries: list[Entry] = []
    numeric_target = target in df.columns and kind_of(df.schema[target].dataType) == "numeric"
    if numbers:
        values = {c: to_numeric(F.col(f"`{c}`")) for c in numbers}
        row = df.agg(*[F.var_samp(values[c]).alias(f"v{i}") for i, c in enumerate(numbers)]).first()
        spread = sorted((-row[f"v{i}"], c) for i, c in enumerate(numbers) if row[f"v{i}"] is not None)[: top + 1]
        entries += [("variance", i + 1, c, None, -v) for i, (v, c) in enumerate(spread)]
        entries += [("pair", i + 1, a, b, None) for i, (a, b) in enumerate(list(combinations([c for _, c in spread], 2))[:top])]
        # one matrix gives the pairs and the correlations with the target
        columns = numbers + ([target] if numeric_target else [])
        matrix = np.abs(correlation_matrix(df, columns)) if len(columns) > 1 else np.ones((1, 1))
        k = len(numbers)
        pairs = sorted((-matrix[i, j], numbers[i], numbers[j]) for i, j in combinations(range(k), 2) if not np.isnan(matrix[i, j]))[:top]
        entries += [("correlation", i + 1, a, b, -r) for i, (r, a, b) in enumerate(pairs)]
        if numeric_target:
            best = sorted((-matrix[i, k], c) for i, c in enumerate(numbers) if not np.isnan(matrix[i, k]))[:top]
            entries += [("target_correlation", i + 1, c, None, -r) for i, (r, c) in enumerate(best)]
    ranked = sorted((importances or {}).items(), key=lambda e: (-e[1], e[0]))[:top]
    entries += [("importance", i + 1, c, None, v) for i, (c, v) in enumerate(ranked)]
    if importances:
        entries += [("unused", i + 1, c, None, None) for i, c in enumerate([c for c in numbers if c not in importances][:top])]
    out = _table(df, entries)
    if target in df.columns and not numeric_target and numbers:
        # one row per value of the target: it stays a table, since a target may have many
        shown = numbers[:top]
        means = df.groupBy(F.coalesce(F.col(f"`{target}`").cast("string"), F.lit("null")).alias("other")).agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"a{i}") for i, c in enumerate(shown)])
        cells = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(c).alias("name"), F.col(f"a{i}").alias("value")) for i, c in enumerate(shown)])).alias("e")
        out = out.unionByName(means.select("other", cells).select(F.lit("group_mean").alias("kind"), "e.rank", "e.name", "other", "e.value"))
    return out
