"""Column statistics: one scan and one wide aggregate for all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tabloom.session import spread

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
SIMPLE = (*NUMERIC, T.StringType, T.BooleanType, *TEMPORAL)
LONG_TEXT = 64
WIDE_BATCH = 100
DISTINCT_BATCH = 40

# What counts as an id-like text, and magnitudes of numeric epochs (low, high).
ID_TEXT = (
    r"^(?:[A-Za-z0-9]{8,}$"
    r"|[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{12}$"
    r"|[A-Z]{2,3}[0-9]{4,}$)"
)
EPOCH_RANGES = {"s": (1e8, 4.1e9), "ms": (1e11, 4.1e12), "us": (1e14, 4.1e15), "ns": (1e17, 4.1e18)}


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, TEMPORAL):
        return "temporal"
    if isinstance(dtype, T.StringType):
        return "string"
    return "nested"


def profilable(df: DataFrame) -> list[T.StructField]:
    """Columns of simple types; nested ones must be flattened first."""
    return [f for f in df.schema.fields if isinstance(f.dataType, SIMPLE)]


def missing(name: str, dtype: T.DataType) -> Column:
    """Null test that also takes NaN for missing."""
    col = F.col(f"`{name}`")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def clean(name: str, dtype: T.DataType) -> Column:
    """The column with NaN as null."""
    col = F.col(f"`{name}`")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    return col


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[clean(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def _long(agg_row: DataFrame, entries: list[Column]) -> DataFrame:
    return agg_row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, n, null_pct) from one pass."""
    fields = df.schema.fields
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(missing(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.col(f"c{i}").alias("nulls"),
            F.col("n"),
            F.coalesce(F.try_divide(F.col(f"c{i}"), F.col("n")), F.lit(0.0)).alias("null_pct"),
        )
        for i, f in enumerate(fields)
    ]
    return _long(wide, entries)


def missing_cells(df: DataFrame) -> DataFrame:
    cols = len(df.columns)
    return null_counts(df).agg(
        F.sum("nulls").alias("missing_cells"),
        F.coalesce(F.try_divide(F.sum("nulls") * F.lit(100.0), F.max("n") * F.lit(cols)), F.lit(0.0)).alias("missing_percentage"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row. Long texts are compared by their SHA-256, so the shuffle stays narrow."""
    keys = []
    for f in df.schema.fields:
        col = clean(f.name, f.dataType)
        if isinstance(f.dataType, T.StringType):
            col = F.when(F.char_length(col) > LONG_TEXT, F.sha2(col, 256)).otherwise(col)
        keys.append(col.alias(f.name))
    groups = df.select(*keys).groupBy(*[f"`{f.name}`" for f in df.schema.fields]).agg(F.count("*").alias("__cnt"))
    return groups.agg(F.coalesce(F.sum(F.col("__cnt") - 1), F.lit(0)).alias("duplicate_rows"))


def column_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, cnt): every non-null value as text with its count, for all columns in one scan.

    Counts are combined map-side, so a hot value costs one row per task in the shuffle.
    """
    fields = [f for f in profilable(df) if columns is None or f.name in columns]
    entries = []
    for f in fields:
        value = clean(f.name, f.dataType).cast("string")
        entries.append(F.struct(F.lit(f.name).alias("column"), value.alias("value")))
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.column", "e.value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("cnt"))
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct): non-null distinct values of each column.

    Each column is grouped in its own type by its own branch of one job: a branch reads only its column
    from a columnar source, and no value is turned into text.
    """
    branches = []
    for f in profilable(df):
        if f.name in columns:
            value = clean(f.name, f.dataType)
            if isinstance(f.dataType, T.StringType):
                value = F.when(F.char_length(value) > LONG_TEXT, F.sha2(value, 256)).otherwise(value)
            values = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
            branches.append(values.agg(F.count("*").alias("distinct")).select(F.lit(f.name).alias("column"), "distinct"))
    return reduce(lambda a, b: a.unionByName(b), branches)


def distinct_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, distinct, n, distinct_pct); nulls count in n only."""
    names = [f.name for f in profilable(df) if columns is None or f.name in columns]
    sizes = null_counts(df.select(*[f"`{c}`" for c in names])).select("column", "n")
    # one row per column on both sides
    return sizes.join(F.broadcast(distinct_counts(df, names)), "column", "left").select(
        "column",
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "n",
        F.coalesce(F.try_divide(F.coalesce("distinct", F.lit(0)), "n"), F.lit(0.0)).alias("distinct_pct"),
    )


DATE = "__date_"


def _column_aggregates(f: T.StructField, estimate: bool) -> dict[str, Column]:
    """The aggregates that make sense for the column's type; the others stay null in the profile."""
    kind = kind_of(f.dataType)
    col = clean(f.name, f.dataType)
    out = {"nulls": F.count_if(missing(f.name, f.dataType))}
    if estimate:
        # a sketch in one binary buffer, with an error of 1.6 %; approx_count_distinct would add hundreds of buffer columns
        out["estimate"] = F.hll_sketch_estimate(F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(col)), F.lit(12)))
    if kind in ("numeric", "boolean"):
        number = col.cast("double")
        out.update(min=F.min(number), max=F.max(number), mean=F.avg(number), var_pop=F.var_pop(number))
    if isinstance(f.dataType, INTEGRAL):
        out.update(min_long=F.min(col.cast("bigint")), max_long=F.max(col.cast("bigint")))
    if kind == "string":
        parsed = F.col(f"`{DATE}{f.name}`")  # made once, before the aggregate
        out.update(
            mean_len=F.avg(F.char_length(col)),
            mean_words=F.avg(F.regexp_count(col, F.lit(r"[^ \t\n\x0B\f\r]+"))),
            space_share=F.avg(col.contains(" ").cast("double")),
            separator_share=F.avg((col.contains("-") | col.contains("/") | col.contains(":")).cast("double")),
            digits_share=F.avg(col.rlike("^[0-9]{7,}$").cast("double")),
            id_text_share=F.avg(col.rlike(ID_TEXT).cast("double")),
            date_share=F.avg(F.when(col.isNotNull(), parsed.isNotNull().cast("double"))),
            year_share=F.avg(F.year(parsed).between(1900, 2100).cast("double")),
            iso_date=F.max(F.when(parsed.isNotNull(), col.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"))),
            us_date=F.max(F.when(parsed.isNotNull(), col.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}"))),
            time_part=F.max(F.when(parsed.isNotNull(), col.rlike("[0-9]{2}:[0-9]{2}"))),
        )
    if kind == "temporal":
        out["year_share"] = F.avg(F.year(col.cast("timestamp")).between(1900, 2100).cast("double"))
    return out


PROFILE_SCHEMA = (
    "column string, position int, dtype string, kind string, is_integral boolean, n bigint, nulls bigint, "
    "distinct bigint, present bigint, null_pct double, distinct_pct double, uniqueness double, "
    "min double, max double, mean double, var_samp double, var_pop double, min_long bigint, max_long bigint, "
    "epoch_s double, epoch_ms double, epoch_us double, epoch_ns double, mean_len double, mean_words double, "
    "space_share double, separator_share double, digits_share double, id_text_share double, date_share double, "
    "year_share double, iso_date boolean, us_date boolean, time_part boolean, sequential boolean"
)
# distinct counts and distinct shares the type rules compare with, widened by the error of the estimate
EXACT_BELOW = 60
NEAR_SHARES = [(0.044, 0.056), (0.17, 0.23), (0.7, 1.1)]


def _batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _needs_exact(distinct: int, present: int, n: int) -> bool:
    shares = [distinct / max(present, 1), distinct / max(n, 1)]
    return distinct <= EXACT_BELOW or any(low <= s <= high for s in shares for low, high in NEAR_SHARES)


def profile_rows(df: DataFrame, exact_distinct: bool | str = True) -> list[dict]:
    """One dictionary per column, from one scan with a wide aggregate plus one count of values.

    ``exact_distinct="auto"`` counts values exactly only for columns whose estimate lies near a threshold of
    the type rules, which spares the shuffle of the other columns' values; ``False`` keeps all estimates.
    """
    from tabloom.functions.temporal import parse_text

    plans = [(i, f, _column_aggregates(f, exact_distinct is not True)) for i, f in enumerate(profilable(df))]
    wide: dict = {}
    # very wide tables go in batches of columns: each reads its own columns, and no plan grows without bound
    for batch in _batches(plans, WIDE_BATCH):
        texts = [f.name for _, f, _ in batch if kind_of(f.dataType) == "string"]
        source = df.select(*[F.col(f"`{f.name}`") for _, f, _ in batch], *[parse_text(F.col(f"`{c}`")).alias(f"{DATE}{c}") for c in texts])
        aggregates = [e.alias(f"c{i}_{k}") for i, _, plan in batch for k, e in plan.items()]
        wide.update(spread(source).agg(F.count("*").alias("n"), *aggregates).first().asDict())
    n = wide.get("n", 0)
    rows = []
    for i, f, plan in plans:
        row = {"column": f.name, "position": i, "dtype": f.dataType.simpleString(), "kind": kind_of(f.dataType),
               "is_integral": isinstance(f.dataType, INTEGRAL), "n": n}
        row.update({k: wide[f"c{i}_{k}"] for k in plan})
        row["present"] = n - row["nulls"]
        row["distinct"] = min(row.pop("estimate", 0) or 0, row["present"])  # replaced below where it must be exact
        if row.get("var_pop") is not None and row["present"] > 1:
            row["var_samp"] = row["var_pop"] * row["present"] / (row["present"] - 1)
        rows.append(row)
    exact = [
        r["column"] for r in rows
        if exact_distinct is True or (exact_distinct == "auto" and _needs_exact(r["distinct"], r["present"], n))
    ]
    if exact:
        found = {
            r["column"]: r["distinct"] for batch in _batches(exact, DISTINCT_BATCH) for r in distinct_counts(df, batch).collect()
        }
        for r in rows:
            if r["column"] in exact:
                r["distinct"] = found.get(r["column"], 0)
    for r in rows:
        r["null_pct"] = r["nulls"] / n if n else 0.0
        r["distinct_pct"] = r["distinct"] / n if n else 0.0
        r["uniqueness"] = r["distinct"] / r["present"] if r["present"] else 0.0
    steps = _equal_step_columns(df, {
        r["column"]: (r["min_long"], r["max_long"], r["present"]) for r in rows if r["is_integral"] and r["distinct"] == r["present"]
    })
    for r in rows:
        r["sequential"] = r["column"] in steps
    _add_epoch_shares(df, rows)
    return rows


def _add_epoch_shares(df: DataFrame, rows: list[dict]) -> None:
    """Shares of values in the range of each epoch unit, only for columns that reach such magnitudes."""
    smallest = min(low for low, _ in EPOCH_RANGES.values())
    large = [r for r in rows if r["kind"] == "numeric" and r["present"] and max(abs(r["min"]), abs(r["max"])) >= smallest]
    if not large:
        return
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = df.agg(
        *[
            F.count_if(F.abs(clean(r["column"], types[r["column"]]).cast("double")).between(low, high)).alias(f"e{i}_{unit}")
            for i, r in enumerate(large) for unit, (low, high) in EPOCH_RANGES.items()
        ]
    ).first()
    for i, r in enumerate(large):
        r.update({f"epoch_{unit}": counts[f"e{i}_{unit}"] / r["present"] for unit in EPOCH_RANGES})


def column_profile(df: DataFrame, exact_distinct: bool | str = True) -> DataFrame:
    """The profile as a table with one row per column."""
    names = [part.split()[0] for part in PROFILE_SCHEMA.split(", ")]
    rows = [tuple(r.get(name) for name in names) for r in profile_rows(df, exact_distinct)]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def _equal_step_columns(df: DataFrame, ranges: dict[str, tuple[int, int, int]]) -> set[str]:
    """Which columns of unique whole numbers, given (min, max, count), have a constant step."""
    done, open_steps = set(), {}
    for name, (low, high, n) in ranges.items():
        if n < 2:
            continue
        if high - low == n - 1:
            done.add(name)
        elif (high - low) % (n - 1) == 0:
            open_steps[name] = (low, (high - low) // (n - 1))
    if open_steps:
        off = df.agg(
            *[F.count_if((F.col(c).cast("bigint") - F.lit(low)) % F.lit(step) != 0).alias(f"o{i}")
              for i, (c, (low, step)) in enumerate(open_steps.items())]
        ).first()
        done |= {c for i, c in enumerate(open_steps) if off[f"o{i}"] == 0}
    return done


def equal_steps(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, sequential): unique whole numbers with a constant step, found without a sort.

    n distinct values between min and max, all a multiple of (max-min)/(n-1) above min, are exactly an
    arithmetic progression.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL) and (columns is None or f.name in columns)]
    low_high = df.agg(
        *[e for i, c in enumerate(names) for e in (F.min(c).cast("bigint").alias(f"lo{i}"), F.max(c).cast("bigint").alias(f"hi{i}"), F.count(c).alias(f"n{i}"))]
    ).first()
    counted = {r["column"]: r["distinct"] for r in distinct_stats(df, names).collect()}
    unique = {
        c: (low_high[f"lo{i}"], low_high[f"hi{i}"], low_high[f"n{i}"]) for i, c in enumerate(names) if counted[c] == low_high[f"n{i}"]
    }
    steps = _equal_step_columns(df, unique)
    return df.sparkSession.createDataFrame([(c, c in steps) for c in names], "column string, sequential boolean")


def gap_stats(df: DataFrame, column: str, bound: int | None = None, chunks: int | None = None) -> DataFrame:
    """Mean and sample deviation of the gaps between neighbours in sorted order (equal values give gap 0).

    Works on distinct values with counts; neighbours are found per range chunk with the border carried over.
    """
    from tabloom.operators.ordered import GROUP_ROWS, previous

    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("cnt"))
    gaps = previous(values, [], ["v"], "v", "before", GROUP_ROWS if bound is None else bound, chunks)
    step = F.col("v") - F.col("before")
    totals = gaps.agg(
        F.count(step).alias("n"),
        F.avg(step).alias("m"),
        (F.var_pop(step) * F.count(step)).alias("m2"),
        F.count_if(step != 1).alias("not_unit"),
        F.sum(F.col("cnt") - 1).alias("repeats"),
    )
    n_all = F.col("n") + F.col("repeats")
    # equal values add gaps of 0; their part of the squared deviations is merged in
    m2_all = F.coalesce("m2", F.lit(0.0)) + F.coalesce(F.try_divide(F.col("m") * F.col("m") * F.col("n") * F.col("repeats"), n_all), F.lit(0.0))
    return totals.select(
        n_all.alias("gaps"),
        F.try_divide(F.col("m") * F.col("n"), n_all).alias("mean_gap"),
        F.sqrt(F.try_divide(m2_all, n_all - 1)).alias("std_gap"),
        ((F.col("not_unit") == 0) & (F.col("repeats") == 0)).alias("unit_step"),
    )
