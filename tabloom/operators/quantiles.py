"""Exact quantiles of many columns without gathering a column in one task, in a number of passes that does not depend on
the number of columns or quantiles.

A Spark ``percentile`` keeps every distinct value of the column in one aggregation buffer. That is fine for a bounded
number of rows only. Beyond the bound, one pass makes sketches of all columns, which bracket every wanted rank by two
values of the column; a second one counts what lies between and on these edges, in long form; a rank on an edge is
found then, and a third pass takes the others from the rows inside their brackets. Only a bracket that still holds more
rows than the bound is sketched and counted again, all such brackets together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, Window

from tabloom.functions.hashing import HASH_SPACE

DIRECT_ROWS = 1_000_000
ACCURACY = 10_000
#: Counts of one aggregate at most; more edges are counted in long form.
WIDE_COUNTS = 64


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float] | dict[str, list[float]], direct_rows: int = DIRECT_ROWS, sizes: dict[str, int] | None = None
) -> dict[str, list[float] | None]:
    """Interpolated quantiles of each named expression (nulls left out); None for an all-null one. ``probs`` holds for all
    columns or names each one's own.

    ``sizes`` are the non-null counts, where the caller knows them already.
    """
    names = list(columns)
    if not names:
        return {}
    wanted = [probs[n] if isinstance(probs, dict) else probs for n in names]
    data = df.select(*[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    if sizes is None:
        counts = data.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first()
        sizes = {n: counts[f"n{i}"] for i, n in enumerate(names)}
    result: dict[str, list[float] | None] = {n: None for n in names}
    small = [i for i, n in enumerate(names) if 0 < sizes[n] <= direct_rows]
    for batch in _bounded(small, [sizes[n] for n in names], 4 * direct_rows):
        row = data.agg(
            *[F.percentile(f"v{i}", F.array(*[F.lit(float(p)) for p in wanted[i]])).alias(f"q{i}") for i in batch]
        ).first()
        for i in batch:
            result[names[i]] = list(row[f"q{i}"])
    large = {i: [p * (sizes[n] - 1) for p in wanted[i]] for i, n in enumerate(names) if sizes[n] > direct_rows}
    ranks = {i: sorted({r for p in at for r in (math.floor(p), math.ceil(p))}) for i, at in large.items()}
    values = _order_statistics(data, {i: sizes[names[i]] for i in large}, ranks, direct_rows)
    for i, positions in large.items():
        low = [values[i, math.floor(p)] for p in positions]
        high = [values[i, math.ceil(p)] for p in positions]
        result[names[i]] = [a + (p - math.floor(p)) * (b - a) if b > a else a for p, a, b in zip(positions, low, high, strict=True)]
    return result


def _bounded(columns: list[int], sizes: list[int], rows: int) -> list[list[int]]:
    """Columns in groups whose rows together stay within the bound, since one task merges a whole group."""
    groups: list[list[int]] = []
    total = 0
    for i in columns:
        if not groups or total + sizes[i] > rows:
            groups.append([])
            total = 0
        groups[-1].append(i)
        total += sizes[i]
    return groups


@dataclass
class _Bracket:
    """Ranks (from 0) of a column that lie among its ``count`` values strictly between low and high; ``base`` are below."""

    column: int
    low: float | None
    high: float | None
    base: int
    count: int
    ranks: list[int]

    def inside(self) -> Column:
        v = F.col(f"v{self.column}")
        cond = v.isNotNull()
        if self.low is not None:
            cond = cond & (v > F.lit(self.low))
        if self.high is not None:
            cond = cond & (v < F.lit(self.high))
        return cond


def _order_statistics(data: DataFrame, sizes: dict[int, int], ranks: dict[int, list[int]], direct_rows: int) -> dict[tuple[int, int], float]:
    """(column, rank) -> value."""
    found: dict[tuple[int, int], float] = {}
    brackets = [_Bracket(i, None, None, 0, n, ranks[i]) for i, n in sizes.items() if ranks[i]]
    while brackets:
        small = [b for b in brackets if b.count <= direct_rows]
        if small:
            _from_inside(data, small, found)
        large = [b for b in brackets if b.count > direct_rows]
        brackets = _narrowed(data, large, found) if large else []
    return found


def _narrowed(data: DataFrame, brackets: list[_Bracket], found: dict[tuple[int, int], float]) -> list[_Bracket]:
    """Sketch and count all brackets; ranks on an edge are found, the others come in narrower brackets."""
    margin = 2.0 / ACCURACY
    sketches = []
    for k, b in enumerate(brackets):
        shares = sorted({min(1.0, max(0.0, (r - b.base) / b.count + m)) for r in b.ranks for m in (-margin, margin)})
        sketches.append(F.percentile_approx(F.when(b.inside(), F.col(f"v{b.column}")), F.array(*[F.lit(x) for x in shares]), F.lit(ACCURACY)).alias(f"e{k}"))
    row = data.agg(*sketches).first()
    edges = [sorted(set(row[f"e{k}"])) for k in range(len(brackets))]
    counts = _counts_wide(data, brackets, edges) if 2 * sum(map(len, edges)) <= WIDE_COUNTS else _counts_long(data, brackets, edges)
    out = []
    for k, b in enumerate(brackets):
        base = b.base
        for place in range(2 * len(edges[k]) + 1):
            n = counts.get((k, place), 0)
            here = [r for r in b.ranks if base <= r < base + n]
            j = place // 2
            if here and place % 2:
                found.update({(b.column, r): edges[k][j] for r in here})
            elif here:
                out.append(_Bracket(b.column, edges[k][j - 1] if j else b.low, edges[k][j] if j < len(edges[k]) else b.high, base, n, here))
            base += n
    return out


def _counts_wide(data: DataFrame, brackets: list[_Bracket], edges: list[list[float]]) -> dict[tuple[int, int], int]:
    """(bracket, place) -> rows; place 2 j + 1 is on edge j, 2 j just below it. One aggregate without a key: no row is copied per column."""
    asked = []
    for k, b in enumerate(brackets):
        v = F.col(f"v{b.column}")
        inside = b.inside()
        for j, e in enumerate(edges[k]):
            asked += [F.count_if(inside & (v < F.lit(e))).alias(f"below{k}_{j}"), F.count_if(inside & (v <= F.lit(e))).alias(f"upto{k}_{j}")]
    row = data.agg(*asked).first()
    counts = {}
    for k, b in enumerate(brackets):
        upto = [0, *[row[f"{side}{k}_{j}"] for j in range(len(edges[k])) for side in ("below", "upto")], b.count]
        counts |= {(k, place): z - a for place, (a, z) in enumerate(zip(upto, upto[1:]))}
    return counts


def _counts_long(data: DataFrame, brackets: list[_Bracket], edges: list[list[float]]) -> dict[tuple[int, int], int]:
    """The same for any number of edges, in long form."""
    cells = []
    for k, b in enumerate(brackets):
        v = F.col(f"v{b.column}")
        place = F.lit(0)
        for e in edges[k]:
            place = place + (v >= F.lit(e)).cast("int") + (v > F.lit(e)).cast("int")
        cells.append(F.when(b.inside(), F.struct(F.lit(k).alias("k"), place.alias("place"))))
    counted = data.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.k", "c.place").agg(F.count("*").alias("n")).collect()
    return {(r["k"], r["place"]): r["n"] for r in counted}


def _from_inside(data: DataFrame, brackets: list[_Bracket], found: dict[tuple[int, int], float]) -> None:
    """Ranks of brackets that are small enough to be ordered, each in a task of its own."""
    cells = [F.when(b.inside(), F.struct(F.lit(k).alias("k"), F.col(f"v{b.column}").alias("v"))) for k, b in enumerate(brackets)]
    few = data.where(reduce(or_, [b.inside() for b in brackets]))
    counts = few.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.k", "c.v").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("v")))  # at most direct_rows rows each
    asked = F.create_map(*[x for k, b in enumerate(brackets) for x in (F.lit(k), F.array(*[F.lit(r - b.base) for r in b.ranks]))])
    hit = upto.withColumn("ranks", F.filter(F.element_at(asked, F.col("k")), lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).where(F.size("ranks") > 0)
    for row in hit.collect():
        b = brackets[row["k"]]
        found.update({(b.column, b.base + r): row["v"] for r in row["ranks"]})


def exact_medians(
    df: DataFrame, columns: dict[str, Column], direct_rows: int = DIRECT_ROWS, sizes: dict[str, int] | None = None
) -> dict[str, float | None]:
    found = exact_quantiles(df, columns, [0.5], direct_rows, sizes)
    return {n: (q[0] if q else None) for n, q in found.items()}


COARSE = 4096
FINE = HASH_SPACE // COARSE


def hash_cutoffs(df: DataFrame, group: Column, hashed: Column, shares: list[float]) -> DataFrame:
    """Per group and share: the smallest hash with at least that share of the group's rows at or below it.

    Two rounds of counting by hash range replace a sort of each group, so a group that holds most of the
    table costs no more than any other: only 4096 counts per group, then the counts inside one range.
    """
    base = df.select(group.alias("grp"), hashed.alias("h"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    coarse = (
        base.groupBy("grp", F.floor(F.col("h") / FINE).cast("int").alias("range")).agg(F.count("*").alias("cnt"))
    )
    by_range = Window.partitionBy("grp").orderBy("range")
    upto = coarse.select(
        "grp",
        "range",
        F.sum("cnt").over(by_range).alias("upto"),
        F.sum("cnt").over(Window.partitionBy("grp")).alias("total"),
        "cnt",
    ).select("*", wanted)
    target = F.ceil(F.round(F.col("share") * F.col("total"), 6))
    hit = upto.where((F.col("upto") >= target) & (F.col("upto") - F.col("cnt") < target)).select(
        "grp", "range", "share", target.alias("rank"), (F.col("upto") - F.col("cnt")).alias("before")
    )
    fine = (
        base.withColumn("range", F.floor(F.col("h") / FINE).cast("int"))
        .join(hit.select("grp", "range").distinct(), ["grp", "range"], "left_semi")
        .groupBy("grp", "range", "h")
        .agg(F.count("*").alias("cnt"))
    )
    within = fine.withColumn("upto", F.sum("cnt").over(Window.partitionBy("grp", "range").orderBy("h")))
    return (
        within.join(hit, ["grp", "range"])
        .where(F.col("before") + F.col("upto") >= F.col("rank"))
        .groupBy("grp", "share")
        .agg(F.min("h").alias("cutoff"))
    )
