"""Business labels and derived money columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions import labels
from factsieve.functions.rounding import cents, half_even, ratio


def region_label(city_id: Column, main_city) -> Column:
    return F.when(city_id == F.lit(main_city), labels.REGION_MAIN).otherwise(labels.REGION_OTHER)


def days_label(days: Column) -> Column:
    """Time on market as five ranges of whole days.

    The ranges have gaps between whole numbers: 30.5 days, like NULL, matches none of them
    and falls to the last label.
    """
    return (
        F.when(days <= 30, labels.DAYS_UP_TO_MONTH)
        .when(days.between(31, 90), labels.DAYS_1_3_MONTHS)
        .when(days.between(91, 180), labels.DAYS_3_6_MONTHS)
        .when(days.between(181, 365), labels.DAYS_6_12_MONTHS)
        .otherwise(labels.DAYS_OVER_YEAR)
    )


def in_home_currency(amount: Column, currency: Column, rate_currency: Column, nominal: Column, rate: Column) -> Column:
    """Amount converted where the day's rate is for its currency; otherwise left as it is."""
    return F.when(currency == rate_currency, cents(ratio(amount, nominal) * rate)).otherwise(amount)


def unit_price(amount: Column, units: Column) -> Column:
    return half_even(ratio(amount, units), 2)


def change_class(change: Column) -> Column:
    """Direction of a relative change as text."""
    return (
        F.when(change.isNull(), "missing").when(change > 0, "up").when(change < 0, "down").otherwise("zero")
    )
