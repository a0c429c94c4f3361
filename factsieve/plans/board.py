"""Board tables: daily figures and daily user sketches, written once and read by every board query.

``daily`` holds revenue and orders by day, device, currency, event type, region and city; it takes
the place of the orders in the board functions of ``tickets`` (totals, periods, segments, leaders),
with any of their filters, and gives the same figures, since it keeps sums as decimals. ``daily_users``
holds a sketch of the users by day, device and region. Sketches merge, so users of a month or a
weekday, who cannot be added up from days, need no second look at the orders either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.calendar import iso_weekday
from factsieve.plans.tickets import Sales, clean_orders, with_events

#: What the daily figures are grouped by, after the event is known.
KEYS = ["created_dt_msk", "device_type_canonical", "currency_code", "event_type_main", "region_name", "city_name"]
USER_KEYS = ["created_dt_msk", "device_type_canonical", "region_name"]

#: Two to this power registers in a sketch; at most 4 KB, fewer for few users.
REGISTERS = 12
#: A count stays within this share of the truth in about 99.7 % of cases: three times 1.04 / sqrt(registers).
ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2)


def daily(sales: Sales) -> DataFrame:
    """Revenue and orders by day and segment; the orders are read once, and grouped before events are joined."""
    by_event = clean_orders(sales).groupBy("created_dt_msk", "device_type_canonical", "currency_code", "event_id").agg(
        F.sum(F.col("revenue_rub").cast("decimal(24,6)")).alias("revenue_sum"), F.count("order_id").alias("orders")
    )
    figures = with_events(by_event, sales).groupBy(*KEYS)
    return figures.agg(F.sum("revenue_sum").alias("revenue_sum"), F.sum("orders").alias("orders"))


def daily_users(sales: Sales) -> DataFrame:
    """Sketches of the users by day, device and region."""
    orders = with_events(clean_orders(sales), sales)
    return orders.groupBy(*USER_KEYS).agg(F.hll_sketch_agg("user_id", REGISTERS).alias("users"))


def _grain(name: str) -> Column:
    day = F.col("created_dt_msk")
    return {
        "day": day,
        "weekday": iso_weekday(day),
        "month": F.date_format(day, "yyyy-MM"),
        "device": F.col("device_type_canonical"),
        "region": F.col("region_name"),
    }[name]


def users_by(sketches: DataFrame, grain: str) -> DataFrame:
    """Users by day, weekday, month, device or region: merged sketches, within ``ERROR`` of the exact count."""
    merged = sketches.groupBy(_grain(grain).alias(grain)).agg(F.hll_union_agg("users").alias("users"))
    return merged.filter(F.col(grain).isNotNull()).select(grain, F.hll_sketch_estimate("users").alias("users"))


def exact_users_by(orders: DataFrame, grain: str) -> DataFrame:
    """The exact count from orders with their events."""
    counted = orders.groupBy(_grain(grain).alias(grain)).agg(F.count_distinct(F.col("user_id")).alias("users"))
    return counted.filter(F.col(grain).isNotNull())
