"""Outlier removal: percentile bounds, percentile caps, quartile fences, above-average."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.operators.attach import attach, known_keys, scalar_row
from factsieve.operators.order_statistics import column_quantiles, quantiles


@dataclass(frozen=True)
class Limit:
    """Strict bounds of a column as percentiles; NULLs pass only with ``keep_null``."""

    column: str
    low: float | None = None
    high: float | None = None
    keep_null: bool = True


def trim_bounds(df: DataFrame, limits: list[Limit], sketches: DataFrame | None = None) -> DataFrame:
    """One row with ``<column>_low`` and ``<column>_high``, taken from the untrimmed table.

    With the table's stored ``sketches`` (see ``order_statistics.part_sketches``) its rows are read once.
    """
    wanted: dict[str, tuple[str, float]] = {}
    for limit in limits:
        if limit.low is not None:
            wanted[f"{limit.column}_low"] = (limit.column, limit.low)
        if limit.high is not None:
            wanted[f"{limit.column}_high"] = (limit.column, limit.high)
    return column_quantiles(df, wanted, kind="discrete", sketches=sketches)


def within(limits: list[Limit]) -> Column:
    """Condition that a row lies strictly between the bounds beside it."""
    keep = F.lit(True)
    for limit in limits:
        value = F.col(limit.column)
        inside = F.lit(True)
        if limit.low is not None:
            inside = inside & (value > F.col(f"{limit.column}_low"))
        if limit.high is not None:
            inside = inside & (value < F.col(f"{limit.column}_high"))
        keep = keep & (inside | value.isNull() if limit.keep_null else inside)
    return keep


def _keep_where(df: DataFrame, one_row: DataFrame, condition: Column) -> DataFrame:
    """Filter rows by a condition that names columns of a one-row table.

    The row comes from a global aggregate, so it is broadcast whatever the input size. As a
    join condition the test stays above the shuffles of ``df``. As a filter it would sink
    below them, and the pass that finds the bounds could no longer share them.
    """
    return df.join(F.broadcast(one_row), condition).select(*[df[c] for c in df.columns])


def percentile_trim(df: DataFrame, limits: list[Limit], bounds: DataFrame | None = None) -> DataFrame:
    """Rows strictly inside the percentile bounds of every limited column.

    ``bounds`` is the row of ``trim_bounds`` if it is known already. It then comes as a scalar, so
    the rows are read once and the filter sinks towards their scan.
    """
    if bounds is None:
        return _keep_where(df, trim_bounds(df, limits), within(limits))
    names = [c for c in bounds.columns if c not in df.columns]
    held = df.withColumn("_bounds", scalar_row(bounds.select(*names)))
    held = held.withColumns({n: F.col("_bounds").getField(n) for n in names})
    return held.filter(within(limits)).select(*df.columns)


def percentile_cap(df: DataFrame, caps: dict[str, float], positive: list[str]) -> DataFrame:
    """Rows at or below the interpolated percentile of each capped column.

    Columns in ``positive`` must also be above zero. The caps come from all rows given.
    """
    keep = F.lit(True)
    for column in positive:
        keep = keep & (F.col(column) > 0)
    for column in caps:
        keep = keep & (F.col(column) <= F.col(f"{column}_cap"))
    return _keep_where(df, cap_values(df, caps), keep)


def cap_values(df: DataFrame, caps: dict[str, float], sketches: DataFrame | None = None) -> DataFrame:
    """One row with ``<column>_cap`` for every capped column."""
    wanted = {f"{c}_cap": (c, p) for c, p in caps.items()}
    return column_quantiles(df, wanted, kind="interpolated", sketches=sketches)


def iqr_fences(df: DataFrame, value: str, by: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, median, and the fences ``k`` quartile ranges outside the box, per group."""
    by = list(by or [])
    q = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    spread = F.col("q3") - F.col("q1")
    return q.withColumns({"fence_low": F.col("q1") - k * spread, "fence_high": F.col("q3") + k * spread})


def iqr_filter(df: DataFrame, value: str, by: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Rows inside the fences of their group, borders included."""
    by = list(by or [])
    fences = iqr_fences(df, value, by, k).select(*by, "fence_low", "fence_high")
    fenced = attach(known_keys(df, by), fences, by)
    return fenced.filter(F.col(value).between(F.col("fence_low"), F.col("fence_high"))).select(*df.columns)


def above_average(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value exceeds the column's mean over all rows."""
    return df.filter(F.col(column) > df.agg(F.avg(column)).scalar())
