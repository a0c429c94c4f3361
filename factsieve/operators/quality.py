"""Profiling, data-quality counts and cleaning."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.rounding import percent
from factsieve.operators.attach import attach, known_keys
from factsieve.operators.order_statistics import quantiles


def head(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """First n rows in a stated order (rows have no order of their own)."""
    return df.orderBy(*order).limit(n)


top_k = head


def null_profile(df: DataFrame) -> DataFrame:
    """Type, filled and missing count of every column, from one aggregate over the table."""
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count(F.col(c)).alias(f"filled_{i}") for i, c in enumerate(df.columns)]
    )
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.col(f"filled_{i}").alias("filled"),
            (F.col("rows") - F.col(f"filled_{i}")).alias("missing"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*entries)))


def null_count(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return known_keys(df, list(by or [])).groupBy(*(by or [])).agg(F.count_if(F.col(column).isNull()).alias("missing"))


def retained_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after cleaning and the percentage kept."""
    kept = after.agg(F.count("*").alias("rows_after"))
    total = before.agg(F.count("*")).scalar()
    both = kept.select(total.alias("rows_before"), "rows_after")
    return both.withColumn("kept_pct", percent(F.col("rows_after"), F.col("rows_before")))


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, per group."""
    by = list(by or [])
    x = F.col(value).cast("double")
    moments = known_keys(df, by).groupBy(*by).agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    quartiles = quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    return attach(moments, quartiles, by).select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def distinct_values(df: DataFrame, column: str, dropna: bool = False, sort: bool = False) -> DataFrame:
    values = df.select(column)
    if dropna:
        values = values.filter(F.col(column).isNotNull())
    values = values.distinct()
    return values.orderBy(column) if sort else values


def duplicate_count(df: DataFrame, keys: list[str], keep: str = "first") -> DataFrame:
    """Rows that repeat a key: those after the first, or with ``keep='none'`` every member."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    extra = F.when(F.col("_n") > 1, F.col("_n")).otherwise(0) if keep == "none" else F.col("_n") - 1
    return groups.agg(F.coalesce(F.sum(extra), F.lit(0)).alias("duplicates"))


def other_columns(df: DataFrame, excluded: list[str]) -> list[str]:
    return [c for c in df.columns if c not in excluded]


def dedup(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of every key in the given order: one row per key, whatever ties there are.

    NULL comes last in the order, and a key may be NULL. Of rows that tie, the one with the least
    hash of its columns stays, so a run on the same rows keeps the same row; fully equal rows are
    one. The least place and hash of a key are hashed minima, reduced in each task before the
    shuffle, and semi-joins keep the rows that hold them. Where the order is a number, a date or a
    moment, place and hash are one number and one step finds both; otherwise the second step
    sees only the rows that are first or tie.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    if not rest and order not in keys:
        return df.groupBy(*keys).agg(F.min(order).alias(order)).select(*df.columns)
    whole = F.xxhash64(*df.columns)
    place = _whole_number(df, order)
    if place is not None:
        return _holding_least(df, keys, place * F.lit(Decimal(_HASHES)) + F.pmod(whole, F.lit(_HASHES)).cast("decimal(19,0)")).distinct()
    firsts = _holding_least(df, keys, F.col(order)).distinct()
    return _holding_least(firsts, keys, whole)


#: Hashes that stand behind a place in one decimal number, which must hold 63 bits and these.
_HASHES = 1 << 60


def _whole_number(df: DataFrame, column: str) -> Column | None:
    """The column's place as a decimal of up to 19 digits, NULL behind all others; None for other types."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        x = F.unix_date(x)
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(x)
    elif not isinstance(kind, T.IntegralType):
        return None
    return F.coalesce(x.cast("decimal(19,0)"), F.lit(Decimal(1 << 63)).cast("decimal(19,0)"))


def _holding_least(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Rows that hold the least value of their key; all rows of a key that has none."""
    least = df.groupBy(*keys).agg(F.min(value).alias("_least"))
    least = least.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_least")
    same = value.eqNullSafe(F.col("_least"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return df.join(least, same, "left_semi")


def drop_hidden_duplicates(df: DataFrame, id_column: str) -> DataFrame:
    """Keep the lowest id of rows that are equal in everything else."""
    return dedup(df, other_columns(df, [id_column]), id_column)


def signed_totals(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return df.agg(F.sum(F.when(x < 0, x)).alias("negative_total"), F.sum(F.when(x > 0, x)).alias("positive_total"))


def narrow_integers(df: DataFrame, columns: list[str], kind: str = "tinyint") -> DataFrame:
    """Cast integer columns to a shorter type; a value that does not fit is an error."""

    def checked(c: str) -> Column:
        short = F.col(c).try_cast(kind)
        lost = F.col(c).isNotNull() & short.isNull()
        return F.when(lost, F.raise_error(F.lit(f"{c} does not fit {kind}")).cast(kind)).otherwise(short)

    return df.withColumns({c: checked(c) for c in columns})


def narrowing_failures(df: DataFrame, columns: list[str], kind: str = "tinyint") -> DataFrame:
    """Per column, how many filled values the shorter type cannot hold."""
    counts = df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(c) for c in columns]
    )
    return counts.unpivot([], columns, "column", "failures")


def replace_labels(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Merge labels that mean the same."""
    return df.replace(mapping, subset=[column])
