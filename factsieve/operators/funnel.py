"""Registration dates, user lifetime and conversion within a number of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.functions.calendar import lifetime_days
from factsieve.functions.rounding import half_even, percent
from factsieve.operators.attach import session_parts


def start_moments(events: DataFrame, key: str, event: str, name: str, moment: str, start: str, which: str) -> DataFrame:
    """One row per key: its first or last event of the given name."""
    pick = {"first": F.min, "last": F.max}[which]
    return events.filter(F.col(event) == name).groupBy(key).agg(pick(moment).alias(start))


def with_lifetime(
    events: DataFrame, key: str, event: str, name: str, moment: str, start: str, which: str = "first"
) -> DataFrame:
    """Events with the key's start moment and the full days since then; NULL without one.

    With several starts per key, ``first`` is the registration proper. ``last`` gives the
    shortest lifetime, which decides whether any start lies within a window of days.
    """
    starts = start_moments(events, key, event, name, moment, start, which)
    joined = events.join(starts, key, "left")
    return joined.withColumn("lifetime_days", lifetime_days(F.col(start), F.col(moment)).cast("int"))


def fanout(events: DataFrame, key: str, group: str, event: str, name: str) -> DataFrame:
    """Rows a join of every event to every start of its key would give, by group and event.

    The product is taken between counts per key, so no pair is ever built.
    """
    per_key = events.groupBy(key, group, event).agg(F.count("*").alias("_n"))
    starts = events.filter(F.col(event) == name).groupBy(key).agg(F.count("*").alias("_starts"))
    joined = per_key.join(starts, key, "left")
    pairs = F.col("_n") * F.coalesce("_starts", F.lit(1))
    return joined.groupBy(group, event).agg(F.sum("_n").alias("rows"), F.sum(pairs).alias("joined_rows"))


def windowed_fanout(
    events: DataFrame, key: str, group: str, event: str, name: str, moment: str, days: int
) -> DataFrame:
    """Rows that joining every event to every start of its key leaves within the window, by group and event.

    An event keeps a start that lies less than ``days + 1`` full days before it, or later. Every event
    is set back by that time, and the starts that come too early for it are counted on two levels:
    those of earlier days from running totals over a key's days, those of the same day among the
    moments of that day. Rows become sums by key, day, group and event before the totals over
    days, so one step puts moments in order, and no pair is built.
    """
    known = events.na.drop(subset=[key, moment])  # others match nothing
    back = F.expr(f"`{moment}` - INTERVAL {days + 1} DAYS")
    names = [group, event]
    asked = F.struct(back.alias("_at"), *names, F.lit(1).cast("long").alias("_n"), F.lit(0).cast("long").alias("_starts"))
    blank = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in names]
    start = F.struct(
        F.col(moment).alias("_at"), *blank, F.lit(0).cast("long").alias("_n"), F.lit(1).cast("long").alias("_starts")
    )
    both = F.when(F.col(event) == name, F.array(asked, start)).otherwise(F.array(asked))
    marks = known.select(key, F.inline(both)).withColumn("_day", F.unix_date(F.to_date("_at")))
    marks = marks.repartition(session_parts(events), key, "_day")
    counted = marks.groupBy(key, "_day", "_at", *names).agg(F.sum("_n").alias("_n"), F.sum("_starts").alias("_starts"))
    sofar = Window.partitionBy(key, "_day").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_early", F.sum("_starts").over(sofar))
    daily = placed.groupBy(key, "_day", *names).agg(
        F.sum("_n").alias("_n"), F.sum("_starts").alias("_starts"), F.sum(F.col("_n") * F.col("_early")).alias("_early")
    )
    earlier = Window.partitionBy(key).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_starts").over(earlier), F.lit(0))
    total = F.sum("_starts").over(Window.partitionBy(key))
    kept = daily.select(*names, (F.col("_n") * (total - before) - F.col("_early")).alias("_kept"))
    return kept.groupBy(*names).agg(F.sum("_kept").alias("joined_rows")).filter("joined_rows > 0")


def within_days(lived: DataFrame, days: int, min_days: int | None = None) -> DataFrame:
    """Events up to ``days`` after the start; earlier than the start too, unless bounded."""
    window = F.col("lifetime_days") <= days
    if min_days is not None:
        window = window & (F.col("lifetime_days") >= min_days)
    return lived.filter(window)


def conversion(participants: DataFrame, goals: DataFrame, group: str, key: str) -> DataFrame:
    """Users, buyers and the percentage of buyers by group.

    All participants count, with events or without, so the total needs no join.
    """
    totals = participants.groupBy(group).agg(F.count_distinct(F.col(key)).alias("total_users"))
    buyers = goals.groupBy(group).agg(F.count_distinct(F.col(key)).alias("buyers"))
    both = totals.join(buyers, group, "full")
    return both.withColumn("conversion", half_even(percent(F.col("buyers"), F.col("total_users")), 2))
