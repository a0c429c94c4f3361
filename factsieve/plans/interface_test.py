"""Conversion test: buyers within a week of registration, by interface variant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.operators import funnel
from factsieve.operators.hypothesis import group_counts, proportions_ztest, sample_size_check
from factsieve.operators.joins import left_join_facts

REGISTRATION, PURCHASE = "registration", "purchase"
DAYS = 7
A, B = "A", "B"


@dataclass(frozen=True)
class Experiment:
    participants: Callable[[], DataFrame]
    events: Callable[[], DataFrame]
    name: str


def members(test: Experiment) -> DataFrame:
    return test.participants().filter(F.col("ab_test") == test.name)


def goal_events(test: Experiment) -> DataFrame:
    return test.events().filter(F.col("event_name").isin(REGISTRATION, PURCHASE))


def merged(test: Experiment) -> DataFrame:
    """Members with their goal events; members without any stay."""
    return left_join_facts(members(test), goal_events(test), "user_id")


def member_events(test: Experiment) -> DataFrame:
    return goal_events(test).join(members(test).select("user_id", "group"), "user_id")


def users_by_group(test: Experiment) -> DataFrame:
    return members(test).groupBy("group").agg(F.count_distinct(F.col("user_id")).alias("users"))


def lived_events(test: Experiment, which: str = "first") -> DataFrame:
    return funnel.with_lifetime(
        member_events(test), "user_id", "event_name", REGISTRATION, "event_dt", "registration_dt", which
    )


def early_events(test: Experiment, min_days: int | None = None) -> DataFrame:
    """Events up to a week after registration, earlier ones included unless bounded."""
    return funnel.within_days(lived_events(test), DAYS, min_days)


def early_purchases(test: Experiment, min_days: int | None = None) -> DataFrame:
    return early_events(test, min_days).filter(F.col("event_name") == PURCHASE)


def conversion(test: Experiment, min_days: int | None = None) -> DataFrame:
    return funnel.conversion(members(test), early_purchases(test, min_days), "group", "user_id")


def registration_fanout(test: Experiment) -> DataFrame:
    return funnel.fanout(member_events(test), "user_id", "group", "event_name", REGISTRATION)


def ztest_rows(test: Experiment) -> DataFrame:
    """The test as published: event rows are counted, so one user weighs many times."""
    sizes = early_events(test).groupBy("group").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_name") == PURCHASE).alias("m")
    )
    return proportions_ztest(group_counts(sizes, "group", A, B, F.col("n"), F.col("m")))


def ztest_rows_fanout(test: Experiment) -> DataFrame:
    """As ``ztest_rows``, but every event counts once for each registration of its user within the window."""
    events = funnel.windowed_fanout(
        member_events(test), "user_id", "group", "event_name", REGISTRATION, "event_dt", DAYS
    )
    sizes = events.groupBy("group").agg(
        F.sum("joined_rows").alias("n"), F.sum(F.when(F.col("event_name") == PURCHASE, F.col("joined_rows"))).alias("m")
    )
    return proportions_ztest(group_counts(sizes, "group", A, B, F.col("n"), F.col("m")))


def ztest_users(test: Experiment) -> DataFrame:
    """The sound form: users and buyers are counted."""
    table = conversion(test)
    buyers = F.coalesce("buyers", F.lit(0))
    return proportions_ztest(group_counts(table, "group", A, B, F.col("total_users"), buyers))


def enough_users(test: Experiment, p1: float = 0.3, p2: float = 0.33) -> DataFrame:
    return sample_size_check(users_by_group(test), "users", p1, p2, alpha=0.05, power=0.8)
