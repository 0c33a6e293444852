"""Numeric features. Every fitted value arrives as a literal, so a transform is one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class NumericConfig:
    enable_scaling: bool = True
    enable_binning: bool = True
    enable_polynomial: bool = False
    enable_log_transform: bool = True
    n_bins: int = 5
    polynomial_degree: int = 2
    clamp_bins: bool = True


@dataclass(frozen=True)
class NumericParams:
    column: str
    median: float | None
    mean: float | None
    std_pop: float | None
    min: float | None
    max: float | None
    all_positive: bool
    has_null: bool
    bin_edges: tuple[float, ...] = ()


def to_numeric(col: Column) -> Column:
    """Number or null: text that is no number, NaN and infinities become null."""
    value = col.try_cast("double")
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(~F.isnan(value) & ~infinite, value)


def impute(col: Column, fill: float | None) -> Column:
    return F.coalesce(col, F.lit(float(fill if fill is not None else 0.0)))


def scale_standard(col: Column, mean: float | None, std_pop: float | None) -> Column:
    """Population standard score; a constant column is only centred."""
    return (col - F.lit(float(mean or 0.0))) / F.lit(float(std_pop) if std_pop else 1.0)


def equal_width_edges(low: float, high: float, distinct: int, n_bins: int) -> list[float]:
    """Edges of right-closed bins over [low, high]; the lowest edge is moved down by 0.1 % of the range."""
    k = min(n_bins, max(2, distinct))
    if low == high:
        pad = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - pad, high + pad
        step = (high - low) / k
        return [low + i * step for i in range(k)] + [high]
    step = (high - low) / k
    edges = [low + i * step for i in range(k)] + [high]
    edges[0] -= 0.001 * (high - low)
    return edges


def quantile_edges(quantiles: list[float]) -> list[float]:
    return sorted(set(quantiles))


def usable_edges(edges: list[float]) -> tuple[float, ...]:
    """Binning needs at least two bins, so three distinct edges."""
    distinct = sorted(set(edges))
    return tuple(distinct) if len(distinct) > 2 else ()


def bin_index(col: Column, edges: tuple[float, ...], clamp: bool = True) -> Column:
    """Index of the right-closed bin. Past the edges: the end bin, or 0 when ``clamp`` is off."""
    index = F.lit(0)
    for edge in edges[1:-1]:
        index = index + F.when(col > F.lit(float(edge)), 1).otherwise(0)
    if not clamp:
        index = F.when((col < F.lit(float(edges[0]))) | (col > F.lit(float(edges[-1]))), 0).otherwise(index)
    return index.cast("int")


def filled_value(params: NumericParams, source: Column | None = None) -> Column:
    """The column as a number with gaps filled; compute it once, all features build on it."""
    return impute(to_numeric(source if source is not None else F.col(params.column)), params.median)


def numeric_features(
    params: NumericParams, config: NumericConfig, value: Column | None = None, source: Column | None = None
) -> dict[str, Column]:
    """All outputs for one numeric column, by name, in order. ``value`` is the filled value if it is at hand."""
    name = params.column
    given = source if source is not None else F.col(name)
    value = value if value is not None else filled_value(params, given)
    out: dict[str, Column] = {}
    if config.enable_scaling:
        out[f"{name}_scaled"] = scale_standard(value, params.mean, params.std_pop)
    else:
        out[f"{name}_original"] = value
    if config.enable_binning and params.bin_edges:
        out[f"{name}_bin"] = bin_index(value, params.bin_edges, config.clamp_bins)
    if config.enable_log_transform and params.all_positive:
        # a later batch may leave the fitted range; log1p is undefined at and below -1
        out[f"{name}_log"] = F.when(value > -1, F.log1p(value))
    if config.enable_polynomial:
        out[f"{name}_squared"] = value * value
        if config.polynomial_degree >= 3:
            out[f"{name}_cubed"] = value * value * value
    out[f"{name}_above_median"] = (value > F.lit(float(params.median or 0.0))).cast("int")
    if params.has_null:
        absent = given.isNull() | F.coalesce(F.isnan(given.try_cast("double")), F.lit(False))
        out[f"{name}_was_missing"] = absent.cast("int")
    return out
