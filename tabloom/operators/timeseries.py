"""Time-series features per key that hold when one key has most of the rows.

Lags and rolling statistics look back over rows or seconds. A hot key's line is cut into blocks, and each block also gets
the rows just beyond its border (the halo), so any block can be worked on alone; halo rows are dropped afterwards.
Blocks of rows come from row numbers that are carried over chunk borders (`ordered.row_number`); blocks of time need no
numbering. Exponentially weighted moments carry (weight, mean, sum of squares) from one block to the next.

Keys may be null (one group), also values and times. Rows with a null time come first in row windows and have no window
of seconds. Equal orders are as the caller's order columns leave them: name enough columns to make rows distinct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from tabloom.operators.folds import broadcast_if_small
from tabloom.operators.ordered import GROUP_ROWS, _carry, largest_group, previous, row_number
from tabloom.session import cut_lineage

BLOCK_ROWS = 100_000
_BLOCK, _HALO, _ROW, _KEYS = "__block", "__halo", "__row", "__keys"


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys as one value that is never null, so that rows with null keys meet too."""
    return df.withColumn(_KEYS, F.struct(*keys) if keys else F.struct(F.lit(0)))


def blocks_with_halo(df: DataFrame, index: Column, size: int, before: int, after: int = 0) -> DataFrame:
    """Every row in the block its index falls into, and once more in the next (previous) block if that block's first
    (last) rows look back (ahead) at it. Needs before and after of at most size."""
    if max(before, after) > size:
        raise ValueError("a halo must fit into a block")
    own = F.floor(index / size)
    at = index - own * size
    copies = F.array(
        F.struct(own.alias("b"), F.lit(False).alias("h")),
        *([F.struct(F.when(at >= size - before, own + 1).alias("b"), F.lit(True).alias("h"))] if before else []),
        *([F.struct(F.when(at < after, own - 1).alias("b"), F.lit(True).alias("h"))] if after else []),
    )
    return df.withColumn("__copy", F.explode(F.filter(copies, lambda c: c["b"].isNotNull() | ~c["h"]))).withColumns({_BLOCK: F.col("__copy.b"), _HALO: F.col("__copy.h")}).drop("__copy")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col(_HALO)).drop(_BLOCK, _HALO)


def _row_window(df: DataFrame, keys: list[str], order: list[str], reach: int, made: dict, bound: int, block: int) -> DataFrame:
    """Columns made over windows that look back at most ``reach`` rows. made: name -> (window -> column)."""
    if largest_group(df, keys) <= bound:
        plain = Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)
        return df.withColumns({name: make(plain) for name, make in made.items()})
    block = max(block, reach)
    numbered = row_number(_keyed(df, keys), [_KEYS], order, _ROW, bound)
    cut = blocks_with_halo(numbered, F.col(_ROW) - 1, block, reach)
    window = Window.partitionBy(_KEYS, _BLOCK).orderBy(_ROW)
    return own_rows(cut.withColumns({name: make(window) for name, make in made.items()})).drop(_ROW, _KEYS)


def lags(df: DataFrame, keys: list[str], order: list[str], value: str, steps: list[int], bound: int = GROUP_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """``<value>_lag_<k>``: the value k rows before in the same key, null where there is none."""
    if not steps or min(steps) < 1:
        raise ValueError("lags look back at least one row")
    made = {f"{value}_lag_{k}": (lambda w, k=k: F.lag(value, k).over(w)) for k in steps}
    return _row_window(df, keys, order, max(steps), made, bound, block)


def _moments(value: Column, frame: Window) -> tuple[Column, Column, Column]:
    return F.count(value).over(frame), F.avg(value).over(frame), F.stddev_samp(value).over(frame)


def rolling_rows(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, bound: int = GROUP_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """``<value>_roll_n``, ``_roll_mean``, ``_roll_std`` over the row and the rows before it, ``rows`` in all; nulls do not
    count, and the deviation (n - 1) is null below two values."""
    v = F.col(value).cast("double")
    made = {
        f"{value}_roll_{name}": (lambda w, i=i: _moments(v, w.rowsBetween(-(rows - 1), 0))[i]) for i, name in enumerate(("n", "mean", "std"))
    }
    return _row_window(df, keys, order, rows - 1, made, bound, block)


def rolling_seconds(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, spans: int = 8) -> DataFrame:
    """The same over the row's time and the ``seconds`` before it, both borders and rows of equal time included.

    Every key is cut into blocks as long as the window, and each block also gets the rows of the block before. A window
    is then the end of the block before and the beginning of its own: two running aggregates, one per direction, so a row
    costs the same however many rows a window holds. Nothing is subtracted, so no digits are lost. ``spans`` has no effect
    on the result.
    """
    if spans < 1:
        raise ValueError("a block spans one window at least")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    cut = blocks_with_halo(df.withColumn("__at", micros), F.col("__at"), width, width)
    # rows of the block before move up by one window: those at or after the row's place are in its window
    placed = cut.withColumn("__place", F.when(F.col(_HALO), F.col("__at") + width).otherwise(F.col("__at")))
    block, whole = Window.partitionBy(*keys, _BLOCK), (Window.unboundedPreceding, Window.currentRow)
    older, newer = block.orderBy(F.desc("__place")).rangeBetween(*whole), block.orderBy("__place").rangeBetween(*whole)
    v = F.col(value).cast("double")
    made = {}
    for side, rows, frame in (("o", F.when(F.col(_HALO), v), older), ("n", F.when(~F.col(_HALO), v), newer)):
        made |= {f"__{side}{name}": f(rows).over(frame) for name, f in (("n", F.count), ("s", F.sum), ("v", F.var_pop))}
    own = own_rows(placed.withColumns(made))
    n, total = F.col("__on") + F.col("__nn"), F.coalesce("__os", F.lit(0.0)) + F.coalesce("__ns", F.lit(0.0))
    gap = F.col("__os") / F.col("__on") - F.col("__ns") / F.col("__nn")  # null unless both sides have values
    squares = F.coalesce(F.col("__ov") * F.col("__on"), F.lit(0.0)) + F.coalesce(F.col("__nv") * F.col("__nn"), F.lit(0.0)) + F.coalesce(gap * gap * F.col("__on") * F.col("__nn") / n, F.lit(0.0))
    timed = F.col("__at").isNotNull()
    return own.select(
        *df.columns, F.when(timed, n).alias(f"{value}_roll_n"), F.when(timed & (n > 0), total / n).alias(f"{value}_roll_mean"),
        F.when(timed & (n > 1), F.sqrt(squares / (n - 1))).alias(f"{value}_roll_std"),
    )


def log_returns(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "log_return", bound: int = GROUP_ROWS) -> DataFrame:
    """Logarithm of the value over the row before's; null at a key's first row and where either is null or not above 0."""
    with_last = previous(_keyed(df, keys), [_KEYS], order, value, "__last", bound)
    fine = (F.col(value) > 0) & (F.col("__last") > 0)
    return with_last.withColumn(out, F.when(fine, F.log(F.col(value) / F.col("__last")))).drop("__last", _KEYS)


def volatility(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, bound: int = GROUP_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """``log_return`` and ``volatility``: the deviation of the last ``rows`` log returns."""
    rolled = rolling_rows(log_returns(df, keys, order, value, bound=bound), keys, order, "log_return", rows, bound, block)
    return rolled.withColumnRenamed("log_return_roll_std", "volatility").drop("log_return_roll_n", "log_return_roll_mean")


#: A weight falls by at most this within a block, so the scaled sums of a block keep their digits.
_FALL = 1e100


def weighted_moments(df: DataFrame, keys: list[str], order: list[str], value: str, decay: float, bound: int = GROUP_ROWS, block: int | None = None) -> DataFrame:
    """``<value>_ew_mean`` and ``<value>_ew_var``: mean and variance of all rows up to this one, a row k rows back weighing
    ``decay ** k``; nulls have no weight but count as a step; null before the first value.

    Keys are cut into blocks. Inside, running sums of the centred values are scaled by the weights; what a block hands on is
    its (weight, mean, sum of squares), and these compose associatively, each weight falling by the rows between. The
    composition over a key's blocks takes the log2 steps of a doubling scan, so no task holds a key; a weight below
    1e-100 of the newest is left out, which ends the scan early.
    """
    if not 0 < decay < 1:
        raise ValueError("decay lies between 0 and 1")
    limit = max(1, int(math.log(_FALL) / -math.log(decay)))
    size = min(block or BLOCK_ROWS, limit)
    v = F.col(value).cast("double")
    numbered = row_number(_keyed(df, keys), [_KEYS], order, _ROW, bound).withColumns({_BLOCK: F.floor((F.col(_ROW) - 1) / size), "__i": (F.col(_ROW) - 1) % size})
    whole = Window.partitionBy(_KEYS, _BLOCK)
    upto = whole.orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    up = F.pow(F.lit(decay), -F.col("__i"))
    weight = F.when(v.isNotNull(), up).otherwise(0.0)
    centre = F.coalesce(F.avg(v).over(whole), F.lit(0.0))
    y = F.coalesce(v, F.lit(0.0)) - F.col("__c")
    sums = numbered.withColumn("__c", centre).withColumns({"__w": F.sum(weight).over(upto), "__s": F.sum(weight * y).over(upto), "__q": F.sum(weight * y * y).over(upto)})
    some = F.col("__w") > 0
    inner = sums.withColumns({
        "__m": F.when(some, F.col("__c") + F.col("__s") / F.col("__w")).otherwise(0.0),
        "__m2": F.when(some, F.greatest(F.col("__q") - F.col("__s") * F.col("__s") / F.col("__w"), F.lit(0.0)) / up).otherwise(0.0),
        "__w": F.col("__w") / up,
    }).drop("__c", "__s", "__q")
    ends = inner.groupBy(_KEYS, _BLOCK).agg(F.max_by(F.struct("__w", "__m", "__m2"), _ROW).alias("state"))

    def shifted(reach: int) -> DataFrame:
        return ends.select(_KEYS, (F.col(_BLOCK) + reach).alias(_BLOCK), F.col("state").alias("older"))

    # after step j a block's state covers the 2**j blocks up to it; the weights of the older half fall by decay ** (size * 2**j)
    reach = 1
    while decay ** (size * reach) > 1 / _FALL:
        joined = ends.join(shifted(reach), [_KEYS, _BLOCK], "left")
        # one row per block; written out, since a plan that joins itself would double with every step
        ends = cut_lineage(joined.select(_KEYS, _BLOCK, _composed(F.col("older"), F.lit(decay ** (size * reach)), F.col("state")).alias("state")))
        reach *= 2
    full = _composed(F.col("older"), F.pow(F.lit(decay), F.col("__i") + 1), F.struct("__w", "__m", "__m2"))
    done = inner.join(shifted(1), [_KEYS, _BLOCK], "left").withColumn("__state", full)
    known = F.col("__state.__w") > 0
    return done.select(
        *df.columns, F.when(known, F.col("__state.__m")).alias(f"{value}_ew_mean"), F.when(known, F.col("__state.__m2") / F.col("__state.__w")).alias(f"{value}_ew_var"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _composed(older: Column, fall: Column, newer: Column) -> Column:
    """(weight, mean, sum of squares) of both parts, the older one's weights falling by ``fall``."""
    w0 = F.coalesce(older["__w"], F.lit(0.0)) * fall
    w1 = newer["__w"]
    total = w0 + w1
    gap = newer["__m"] - F.coalesce(older["__m"], F.lit(0.0))
    mean = F.when(w1 == 0, older["__m"]).when(w0 == 0, newer["__m"]).otherwise(newer["__m"] - gap * w0 / total)
    m2 = F.coalesce(older["__m2"], F.lit(0.0)) * fall + newer["__m2"] + F.when((w0 > 0) & (w1 > 0), gap * gap * w0 * w1 / total).otherwise(0.0)
    return F.struct(total.alias("__w"), F.coalesce(mean, F.lit(0.0)).alias("__m"), m2.alias("__m2"))


def daily_series(df: DataFrame, keys: list[str], ts: str, value: str, bound: int = GROUP_ROWS) -> DataFrame:
    """(keys, day, value, filled): the mean of each day, days without a value between two known ones filled in a straight
    line. ``day`` counts from 1970-01-01. Only neighbours meet, each gap is made from the two days around it."""
    days = df.select(*keys, F.unix_date(F.col(ts).cast("date")).alias("day"), F.col(value).cast("double").alias("value")).where("day IS NOT NULL AND value IS NOT NULL")
    known = days.groupBy(*keys, "day").agg(F.avg("value").alias("value")).withColumn("__here", F.struct("day", "value"))
    pairs = previous(_keyed(known, keys), [_KEYS], ["day"], "__here", "__prior", bound)
    missing = F.sequence(F.coalesce(F.col("__prior.day") + 1, F.col("day")), F.col("day"))
    grid = pairs.select(*keys, "day", "value", "__prior", F.explode(missing).alias("__day"))
    share = (F.col("__day") - F.col("__prior.day")) / (F.col("day") - F.col("__prior.day"))
    filled = F.when(F.col("__day") == F.col("day"), F.col("value")).otherwise(F.col("__prior.value") + (F.col("value") - F.col("__prior.value")) * share)
    return grid.select(*keys, F.col("__day").alias("day"), filled.alias("value"), (F.col("__day") != F.col("day")).alias("filled"))


def decompose(series: DataFrame, keys: list[str], period: int, value: str = "value", block: int = BLOCK_ROWS) -> DataFrame:
    """A daily series without gaps (keys, day, value) with ``trend``, ``seasonal`` and ``residual``.

    The trend is the centred moving average over one period (an even one's two outer days count half), null where the
    period does not fit. The seasonal part of a day of the period is the mean of value - trend there, less the mean of
    these means. Blocks of days with a halo on both sides take the place of one window per key.
    """
    if period < 2:
        raise ValueError("a period has at least two days")
    if not keys:
        return decompose(series.withColumn(_KEYS, F.lit(0)), [_KEYS], period, value, block).drop(_KEYS)
    half = period // 2
    v = F.col(value).cast("double")
    cut = blocks_with_halo(series, F.col("day"), max(block, half), half, half)
    window = Window.partitionBy(*keys, _BLOCK).orderBy("day")
    inner = half if period % 2 else half - 1
    whole = F.sum(v).over(window.rowsBetween(-inner, inner))
    total = whole if period % 2 else whole + (F.lag(v, half).over(window) + F.lead(v, half).over(window)) / 2
    fits = F.lag(v, half).over(window).isNotNull() & F.lead(v, half).over(window).isNotNull()
    smooth = own_rows(cut.withColumn("trend", F.when(fits, total / period))).withColumn("__at", F.pmod(F.col("day"), F.lit(period)))
    means = smooth.groupBy(*keys, "__at").agg(F.avg(v - F.col("trend")).alias("__mean"))
    # one row per key and day of the period
    level = means.groupBy(*keys).agg(F.avg("__mean").alias("__level"), F.map_from_entries(F.collect_list(F.struct("__at", "__mean"))).alias("__means"))
    table = broadcast_if_small(level)
    joined = smooth.alias("l").join(table.alias("r"), _all([F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]))
    seasonal = F.try_element_at(F.col("__means"), F.col("__at")) - F.col("__level")
    out = joined.select(*[F.col(f"l.{k}") for k in series.columns], "trend", seasonal.alias("seasonal"))
    return out.withColumn("residual", v - F.col("trend") - F.col("seasonal"))


def history(asked: DataFrame, facts: DataFrame, keys: list[str], ts: str, value: str, bound: int = GROUP_ROWS, chunks: int | None = None) -> DataFrame:
    """The rows asked for with what was known before: ``past_n``, ``past_mean`` and ``past_seconds`` (since the last fact)
    over the key's facts with a strictly earlier time. A fact of the same time is not known yet; a row without a time
    knows nothing, a fact without one is never known; null values count in past_n and past_seconds only.

    Both tables are put in one and ordered by key and time, asked rows first among equal times: a running sum instead
    of a join, also for a hot key.
    """
    lines = _line(asked, facts, keys, ts, [value])
    v = F.when(F.col("__fact"), F.col("__given")[value].cast("double"))
    made = lambda agg: F.struct(
        agg(F.sum, F.when(F.col("__fact"), 1).otherwise(0)).alias("n"), agg(F.count, v).alias("k"), agg(F.sum, v).alias("s"), agg(F.max, F.when(F.col("__fact"), F.col("__at"))).alias("t"),
    )
    upto, last = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    def merged(w: Window, before: Column) -> Column:
        own = made(lambda f, c: f(c).over(w.rowsBetween(*upto)))
        return F.struct(add(before["n"], own["n"]).alias("n"), add(before["k"], own["k"]).alias("k"), add(before["s"], own["s"]).alias("s"), F.greatest(before["t"], own["t"]).alias("t"))

    done = _carry(
        lines, [_KEYS], ["__at", "__fact"],
        plain=lambda w: made(lambda f, c: f(c).over(w.rowsBetween(*upto))),
        summary=made(lambda f, c: f(c)),
        before=lambda w: F.struct(*[f(F.col(f"__s.{c}")).over(w.rowsBetween(*last)).alias(c) for f, c in ((F.sum, "n"), (F.sum, "k"), (F.sum, "s"), (F.max, "t"))]),
        merge=merged, out="__past", bound=bound, chunks=chunks,
    )
    rows = done.where(~F.col("__fact"))
    timed = F.col("__at").isNotNull()
    return rows.select(
        "__row.*", F.when(timed, F.col("__past.n")).otherwise(0).cast("bigint").alias("past_n"), F.when(timed & (F.col("__past.k") > 0), F.col("__past.s") / F.col("__past.k")).alias("past_mean"),
        F.when(timed, (F.col("__at") - F.col("__past.t")) / 1_000_000).alias("past_seconds"),
    )


def _line(asked: DataFrame, facts: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Asked rows and facts in one table: key, time in microseconds, which it is, the row or the fact's columns."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    left = asked.select(key.alias(_KEYS), at.alias("__at"), F.lit(False).alias("__fact"), F.struct("*").alias("__row"))
    right = facts.select(key.alias(_KEYS), at.alias("__at"), F.lit(True).alias("__fact"), F.struct(*columns).alias("__given")).where("__at IS NOT NULL")
    return left.unionByName(right, allowMissingColumns=True)


def as_of(asked: DataFrame, facts: DataFrame, keys: list[str], ts: str, columns: list[str], tie: list[str], bound: int = GROUP_ROWS, chunks: int | None = None) -> DataFrame:
    """The rows asked for with ``columns`` of the key's last fact of a strictly earlier time (null if there is none); of
    facts with equal times the one with the greatest ``tie`` columns. No join: union, sort, last value."""
    lines = _line(asked, facts, keys, ts, [*dict.fromkeys([*columns, *tie])]).withColumn("__tie", F.struct(*[F.col("__given")[c].alias(c) for c in tie]))
    given = F.when(F.col("__fact"), F.struct(*[F.col("__given")[c].alias(c) for c in columns]))
    order = ["__at", "__fact", "__tie"]
    upto, last = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    done = _carry(
        lines, [_KEYS], order,
        plain=lambda w: F.last(given, ignorenulls=True).over(w.rowsBetween(*upto)),
        summary=F.max_by(given, F.when(F.col("__fact"), F.struct(*order))),
        before=lambda w: F.last("__s", ignorenulls=True).over(w.rowsBetween(*last)),
        merge=lambda w, b: F.coalesce(F.last(given, ignorenulls=True).over(w.rowsBetween(*upto)), b),
        out="__last", bound=bound, chunks=chunks,
    )
    timed = F.col("__at").isNotNull()
    return done.where(~F.col("__fact")).select("__row.*", *[F.when(timed, F.col("__last")[c]).alias(f"last_{c}") for c in columns])


def bucketize(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the interval [edge, next edge) that holds the value; below the first and from the last edge on too, so
    there is one more name than edges. Null stays null."""
    if len(names) != len(edges) + 1 or sorted(set(edges)) != list(edges):
        raise ValueError("ascending edges and one more name are needed")
    out = F.when(value.isNull(), F.lit(None))
    for edge, name in zip(edges, names):
        out = out.when(value < edge, F.lit(name))
    return out.otherwise(F.lit(names[-1]))
