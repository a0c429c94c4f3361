"""Grouped summaries: pivots, shares, histograms, box-plot numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.rounding import exact_mean, half_even, percent, ratio
from factsieve.operators.attach import attach, known_keys, scalar_row
from factsieve.operators.order_statistics import measured
from factsieve.operators.trimming import iqr_fences


def pivot_count(df: DataFrame, row: str, column: str, values: dict[str, str], counted: str) -> DataFrame:
    """Counts by row key and column value; an empty cell is NULL.

    ``values`` maps each column value to its output name; listing them spares the pass
    that would look them up.
    """
    return pivot(df, row, column, values, F.count(counted))


def pivot(df: DataFrame, row: str, column: str, values: dict[str, str], cell: Column) -> DataFrame:
    """Any aggregate by row key and column value."""
    pivoted = known_keys(df, [row]).groupBy(row).pivot(column, list(values)).agg(cell)
    return pivoted.select(row, *[F.col(f"`{v}`").alias(name) for v, name in values.items()])


def pivot_mean(df: DataFrame, row: str, column: str, values: dict[str, str], averaged: str) -> DataFrame:
    """Means of an amount by row key and column value."""
    return pivot(df, row, column, values, exact_mean(F.col(averaged)))


# The next three take grouped results of any length. Totals, extremes and means over all
# categories are one aggregate row, brought in as a scalar subquery; it reads the shuffle of
# the grouping that the rows themselves come from.


def _over_all(table: DataFrame, *wanted: Column) -> Column:
    return scalar_row(table.agg(*wanted))


def column_shares(table: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Every cell as a percentage of its column total, ``<column>_pct``."""
    totals = _over_all(table, *[F.sum(c).alias(c) for c in columns])
    held = table.withColumn("_all", totals)
    shares = {f"{c}_pct": half_even(percent(F.col(c), F.col("_all").getField(c)), digits) for c in columns}
    return held.withColumns(shares).drop("_all")


def add_share(table: DataFrame, columns: list[str], shaded: list[str] | None = None) -> DataFrame:
    """Unrounded percentage of the column total beside each column.

    ``shaded`` columns also get ``<column>_heat``: where the share lies between the lowest
    and the highest one, 0 to 1 (cell shading).
    """
    kinds = {"sum": F.sum, "low": F.min, "high": F.max}
    wanted = [(c, kind) for c in columns for kind in (kinds if c in (shaded or []) else ["sum"])]
    held = table.withColumn("_all", _over_all(table, *[kinds[kind](c).alias(f"{c}_{kind}") for c, kind in wanted]))
    whole = lambda name: F.col("_all").getField(name)
    added = {f"{c}_pct": percent(F.col(c), whole(f"{c}_sum")) for c in columns}
    for c in shaded or []:
        added[f"{c}_heat"] = ratio(F.col(c) - whole(f"{c}_low"), whole(f"{c}_high") - whole(f"{c}_low"))
    return held.withColumns(added).drop("_all")


def add_mean(table: DataFrame, column: str, name: str) -> DataFrame:
    """The column's mean over all rows, as a reference line."""
    return table.withColumn(name, _over_all(table, F.avg(column).alias("mean")).getField("mean"))


def distinct_count(key: str, approximate: float | None = None) -> Column:
    """Distinct values of a key; ``approximate`` is the allowed relative error, if any."""
    return F.approx_count_distinct(key, approximate) if approximate else F.count_distinct(F.col(key))


def activity(df: DataFrame, by: str, counted: str, distinct: str, name: str, *extra: Column) -> DataFrame:
    """Orders, distinct keys and further aggregates by group, in one aggregate.

    One distinct count only: it plans as nested grouped counts, with no row expansion.
    """
    grouped = known_keys(df, [by]).groupBy(by)
    return grouped.agg(F.count(counted).alias("orders"), F.count_distinct(F.col(distinct)).alias(name), *extra)


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal-width bins between the extremes, the last bin closed, empty bins kept.

    A value is first placed by arithmetic and then moved by one bin where rounding put it
    on the wrong side of an edge, as array libraries do. Equal extremes give bins half a
    unit to either side.
    """
    by = list(by or [])
    rows = measured(df, value, by)
    extremes = rows.groupBy(*by).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    flat = F.col("_min") == F.col("_max")
    frames = extremes.filter(F.col("_min").isNotNull()).select(
        *by,
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_low"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_high"),
    )

    def edge(i: Column) -> Column:
        step = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
        return F.when(i == bins, F.col("_high")).otherwise(i * step + F.col("_low"))

    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    placed = attach(rows, frames, by).withColumn(
        "_bin", F.least(F.floor(share * F.lit(float(bins))), F.lit(bins - 1))
    )
    bin_ = F.col("_bin")
    moved = (
        F.when(F.col("_v") < edge(bin_), bin_ - 1)
        .when((F.col("_v") >= edge(bin_ + 1)) & (bin_ != bins - 1), bin_ + 1)
        .otherwise(bin_)
    )
    counts = placed.groupBy(*by, moved.cast("int").alias("bin")).agg(F.count("*").alias("_n"))
    every = frames.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = every.join(counts, [*by, "bin"], "left")
    return filled.select(
        *by,
        "bin",
        edge(F.col("bin")).alias("bin_low"),
        edge(F.col("bin") + 1).alias("bin_high"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def box_stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Numbers of a box plot: quartiles, median, whiskers, and the count outside them.

    A whisker ends at the last value inside the fence, and never inside the box.
    """
    by = list(by or [])
    fences = iqr_fences(df, value, by)
    rows = measured(df, value, by)
    x = F.col("_v")
    inside = x.between(F.col("fence_low"), F.col("fence_high"))
    spans = (
        attach(rows, fences, by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("_low"),
            F.max(F.when(inside, x)).alias("_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return spans.select(
        *by,
        "q1",
        "median",
        "q3",
        F.least("_low", "q1").alias("whisker_low"),
        F.greatest("_high", "q3").alias("whisker_high"),
        "outliers",
    )
