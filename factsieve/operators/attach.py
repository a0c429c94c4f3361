"""Bring computed values (bounds, totals, thresholds) to the rows they apply to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_row(values: DataFrame) -> Column:
    """The only row of ``values`` as a struct: one scalar subquery, run once per query.

    Its fields act as literals when the outer query runs, so comparisons with them can
    still be pushed down to the file scan.
    """
    return values.select(F.struct(*values.columns).alias("row")).scalar()


#: A group's rows are dealt to so many tasks where group values are joined by a shuffle.
SALTS = 32


def attach(df: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Add the columns of ``values`` to each row: by group key, or its single row to all.

    ``values`` has one row per group. It is repeated for every salt and joined on key and salt,
    so that a group of any size is spread over tasks where the side is too large for
    the session's broadcast threshold.
    """
    if by:
        own = F.xxhash64(*[c for c in df.columns if c not in by] or by)
        salted = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = df.withColumn("_salt", F.pmod(own, F.lit(SALTS)).cast("int"))
        return rows.join(salted, [*by, "_salt"]).drop("_salt")
    names = [c for c in values.columns]
    held = df.withColumn("_row", scalar_row(values))
    return held.select(*df.columns, *[F.col("_row").getField(n).alias(n) for n in names])


def read_once(df: DataFrame) -> DataFrame:
    """The same rows, marked for use by several steps of one query.

    Spark runs a shuffle once for all its readers if they plan it alike. Readers that need
    different columns, or filter the rows, do not: the optimizer moves both below the
    shuffle. The condition here is always true, names every column and counts as not
    deterministic, so neither columns nor filters move past it, and the shuffle is shared.
    """
    return df.filter(F.spark_partition_id() >= F.least(F.lit(0), F.hash(*df.columns)))


def session_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, to be stated where rows are dealt to tasks.

    A stated number is kept: rows that pack into few bytes are not put together in few tasks,
    which would hold them all in memory.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def known_keys(df: DataFrame, by: list[str]) -> DataFrame:
    """Drop rows whose group key is NULL, as grouping in the original analyses does.

    Keys that the schema says are never NULL need no filter; none is added for them, so
    the plan stays equal to that of other consumers of the same rows.
    """
    doubtful = [c for c in by if df.schema[c].nullable]
    return df.na.drop(subset=doubtful) if doubtful else df
