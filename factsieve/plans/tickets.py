"""Ticket sales: preparation, seasons, activity, regions and partners, board figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsieve.functions import labels
from factsieve.functions.calendar import is_weekend, iso_weekday, season
from factsieve.functions.categories import change_class, in_home_currency, unit_price
from factsieve.functions.rounding import exact_mean, exact_sum, half_even, percent, ratio
from factsieve.operators import summary
from factsieve.operators.attach import read_once, scalar_row, session_parts
from factsieve.operators.hypothesis import mann_whitney
from factsieve.operators.quality import drop_hidden_duplicates, replace_labels, top_k
from factsieve.operators.trimming import cap_values, percentile_cap

CAPS = {"revenue_rub": 0.99, "tickets_count": 0.99}
MOBILE, DESKTOP = "mobile", "desktop"


@dataclass(frozen=True)
class Sales:
    """Ticket orders, events (one row per ``event_id``) and rates (one row per date).

    Tables are given as functions, so a query opens only the ones it reads. ``cleaned``, if given,
    opens the rows of ``clean_orders`` from orders stored for the present orders and rates; without
    it every analysis prepares them again.
    """

    orders: Callable[[], DataFrame]
    events: Callable[[], DataFrame]
    rates: Callable[[], DataFrame]
    label_merge: dict[str, str] = field(default_factory=lambda: dict(labels.EVENT_LABEL_MERGE))
    cleaned: Callable[[], DataFrame] | None = None


def with_events(orders: DataFrame, sales: Sales) -> DataFrame:
    """Orders with their event; orders of unknown events stay."""
    return orders.join(replace_labels(sales.events(), "event_type_description", sales.label_merge), "event_id", "left")


def one_per_day(rates: DataFrame) -> DataFrame:
    """The rates, checked to have one row per day: a second one would repeat that day's orders.

    The check is part of the plan and runs where the rates are read, a second rate is an error.
    """
    rows = F.count("*").over(Window.partitionBy("data"))
    day = F.when(
        F.col("_rows") > 1, F.raise_error(F.concat(F.lit("more than one rate on "), F.col("data"))).cast("date")
    ).otherwise(F.col("data"))
    return rates.withColumn("_rows", rows).withColumn("data", day).drop("_rows")


def with_rates(orders: DataFrame, sales: Sales) -> DataFrame:
    """Orders with the currency rate of their day, if there is one.

    Rates have one row per calendar day, so they are sent to the orders, which stay where they are.
    """
    rates = F.broadcast(one_per_day(sales.rates()))
    return orders.join(rates, orders["created_dt_msk"] == rates["data"], "left")


def derived(orders: DataFrame) -> DataFrame:
    """Revenue in home currency, revenue per ticket, month and season."""
    day = F.col("created_dt_msk")
    return (
        orders.withColumn(
            "revenue_rub",
            in_home_currency(
                F.col("revenue"), F.col("currency_code"), F.col("cdx"), F.col("nominal"), F.col("curs")
            ),
        )
        .withColumn("one_ticket_revenue_rub", unit_price(F.col("revenue_rub"), F.col("tickets_count")))
        .withColumn("month", F.month(day))
        .withColumn("season", season(F.month(day)))
    )


def priced(sales: Sales) -> DataFrame:
    """All order rows with rates and derived columns, duplicates included."""
    return derived(with_rates(sales.orders(), sales))


def deduplicated(sales: Sales, dealt_by: list[str] | None = None) -> DataFrame:
    """Orders without hidden duplicates, priced.

    Everything joined or derived depends on an order's own columns only, so rows that agree
    in those agree in all. Duplicates are dropped first, on the narrow order rows, and the
    joins see each order once. The caps need all these orders, so whatever part of them a
    query goes on with, both read one shuffle. ``dealt_by``, columns other than the id, has that
    shuffle deal the orders by ranges of them; equal rows stay together, so no second one is needed.
    """
    orders = sales.orders()
    if dealt_by:
        orders = orders.repartitionByRange(session_parts(orders), *dealt_by)
    orders = read_once(drop_hidden_duplicates(orders, "order_id"))
    return derived(with_rates(orders, sales))


def clean_orders(sales: Sales) -> DataFrame:
    """Orders of positive revenue up to the 99th percentile, and of usual size.

    Events are not joined here: they have one row per id, so they change no row count and
    no percentile, and the queries that use no event column are spared the join.
    """
    if sales.cleaned:
        return sales.cleaned()
    return percentile_cap(deduplicated(sales), CAPS, positive=["revenue_rub"])


def usual(orders: DataFrame, caps_known: DataFrame) -> DataFrame:
    """Orders of positive revenue within the caps, which come as one row and act as a scalar."""
    held = orders.withColumn("_caps", scalar_row(caps_known))
    keep = F.col("revenue_rub") > 0
    for column in CAPS:
        keep = keep & (F.col(column) <= F.col("_caps").getField(f"{column}_cap"))
    return held.filter(keep).drop("_caps")


#: Stored orders are split by season, which most analyses filter by.
CLEANED_BY = ["season"]


def order_layout(sales: Sales) -> DataFrame:
    """The rows of ``deduplicated`` as they are best stored: dealt by day, in order of season and day.

    A filter by season then reads that season's files only, and one by days few blocks of them. The
    orders are dealt so where duplicates are dropped, and are not shuffled again for it; a day with a
    large part of them is spread by user and event. The caps are found from the stored columns, and
    ``usual`` leaves the rows of ``clean_orders``.
    """
    orders = deduplicated(sales, ["created_dt_msk", "user_id", "event_id"])
    return orders.sortWithinPartitions(*CLEANED_BY, "created_dt_msk")


def cap_row(sales: Sales) -> DataFrame:
    """The caps as one row, to be stored or passed to ``clean_between``."""
    return order_caps(deduplicated(sales))


def order_caps(orders: DataFrame) -> DataFrame:
    """The caps of prepared orders, such as the stored ones."""
    return cap_values(orders, CAPS)


def clean_between(sales: Sales, stored_caps: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of ``clean_orders`` in a span of days, given the caps of all orders.

    The caps come as a scalar and the days are filtered before duplicates are dropped (rows that
    are equal but for the id have one day), so the filter reaches the scan of the orders.
    """
    orders = drop_hidden_duplicates(selected(sales.orders(), start, end), "order_id")
    return usual(derived(with_rates(orders, sales)), stored_caps)


def clean_tickets(sales: Sales) -> DataFrame:
    return with_events(clean_orders(sales), sales)


def autumn(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("season") == labels.AUTUMN)


def caps(sales: Sales, sketches: DataFrame | None = None) -> DataFrame:
    found = cap_values(deduplicated(sales), CAPS, sketches)
    return found.select(F.col("revenue_rub_cap").alias("revenue_q99"), F.col("tickets_count_cap").alias("tickets_q99"))


# Seasons ------------------------------------------------------------------------------

SEASON_COLUMNS = {
    labels.SPRING: "spring", labels.SUMMER: "summer", labels.AUTUMN: "autumn", labels.WINTER: "winter",
}


def orders_per_month(sales: Sales) -> DataFrame:
    return clean_orders(sales).groupBy("month").agg(F.count("order_id").alias("orders")).orderBy("month")


def season_mix(rows: DataFrame, key: str) -> DataFrame:
    """Orders by a category and season, and each season's shares in percent."""
    return season_shares(summary.pivot_count(rows, key, "season", SEASON_COLUMNS, "order_id"))


def event_seasons(sales: Sales) -> DataFrame:
    """Orders, and the parts of the mean ticket revenue, by event and season, with the event.

    Grouped before events are joined, so that the join sees one row per event and season.
    """
    price = F.col("one_ticket_revenue_rub")
    grouped = clean_orders(sales).groupBy("event_id", "season").agg(
        F.count("order_id").alias("orders"),
        F.sum(price.cast("decimal(24,6)")).alias("price_sum"),
        F.count(price).alias("priced_orders"),
    )
    return with_events(grouped, sales)


def season_shares(counts: DataFrame) -> DataFrame:
    shares = summary.column_shares(counts, list(SEASON_COLUMNS.values()))
    return shares.orderBy(F.col("summer_pct").desc_nulls_last())


def event_season_mix(sales: Sales) -> DataFrame:
    orders = F.sum("orders")
    return season_shares(summary.pivot(event_seasons(sales), "event_type_main", "season", SEASON_COLUMNS, orders))


def device_season_mix(sales: Sales) -> DataFrame:
    return season_mix(clean_orders(sales), "device_type_canonical")


def age_season_mix(sales: Sales) -> DataFrame:
    return season_mix(clean_orders(sales), "age_limit")


def ticket_price_change(sales: Sales) -> DataFrame:
    """Mean revenue per ticket by event type and season, and autumn against summer."""
    mean = ratio(F.sum("price_sum").cast("double"), F.sum("priced_orders"))
    means = summary.pivot(event_seasons(sales), "event_type_main", "season", SEASON_COLUMNS, mean)
    changed = means.withColumn("change_pct", percent(F.col("autumn") - F.col("summer"), F.col("summer")))
    return changed.withColumn("change_class", change_class(F.col("change_pct"))).orderBy(
        F.col("summer").desc_nulls_last()
    )


# Activity in autumn -------------------------------------------------------------------


def daily_activity(sales: Sales) -> DataFrame:
    days = summary.activity(
        autumn(clean_orders(sales)), "created_dt_msk", "order_id", "user_id", "unique_users",
        half_even(exact_mean(F.col("one_ticket_revenue_rub")), 2).alias("avg_one_ticket_revenue"),
    )
    per_user = half_even(ratio(F.col("orders"), F.col("unique_users")), 2)
    return days.withColumn("orders_per_user", per_user).orderBy("created_dt_msk")


def _by_weekday(sales: Sales, counted: Column, name: str) -> DataFrame:
    rows = autumn(clean_orders(sales)).withColumn("weekday", iso_weekday(F.col("created_dt_msk")))
    days = rows.groupBy("weekday").agg(counted.alias(name))
    days = days.withColumn("is_weekend", is_weekend(F.col("weekday")))
    return summary.add_mean(days, name, f"mean_{name}").orderBy("weekday")


def orders_per_weekday(sales: Sales) -> DataFrame:
    return _by_weekday(sales, F.count("order_id"), "orders")


def users_per_weekday(sales: Sales, approximate: float | None = None) -> DataFrame:
    return _by_weekday(sales, summary.distinct_count("user_id", approximate), "users")


def region_summary(sales: Sales) -> DataFrame:
    by_event = autumn(clean_orders(sales)).groupBy("event_id").agg(F.count("order_id").alias("orders"))
    located = with_events(by_event, sales).filter(F.col("region_name").isNotNull())
    regions = located.groupBy("region_name").agg(F.sum("orders").alias("orders"), F.count("event_id").alias("events"))
    columns = ["events", "orders"]
    return summary.add_share(regions, columns, shaded=columns).orderBy(F.desc("events"))


def partner_summary(sales: Sales) -> DataFrame:
    partners = summary.activity(
        autumn(clean_orders(sales)), "service_name", "order_id", "event_id", "events",
        exact_sum(F.col("revenue_rub")).alias("total_revenue"),
    )
    columns = ["events", "orders", "total_revenue"]
    return summary.add_share(partners, columns, shaded=columns).orderBy(F.desc("events"))


def top_share(table: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Part of all events and orders that the k largest groups hold."""
    best = top_k(table, k, [F.desc("events"), F.asc(key)])
    return best.agg(
        F.lit(key).alias("dimension"),
        F.sum("events_pct").alias("events_pct"),
        F.sum("orders_pct").alias("orders_pct"),
    )


def leaders_share(sales: Sales) -> DataFrame:
    regions = top_share(region_summary(sales), "region_name")
    return regions.unionByName(top_share(partner_summary(sales), "service_name"))


# Mobile against desktop ---------------------------------------------------------------


def user_metrics(sales: Sales) -> DataFrame:
    """Orders and mean gap of every user who orders from one kind of device only.

    The device check and both metrics come from one grouped pass, in place of two sets,
    their intersection and two exclusions.
    """
    rows = autumn(clean_orders(sales)).filter(F.col("device_type_canonical").isin(MOBILE, DESKTOP))
    users = rows.groupBy("user_id").agg(
        F.count_if(F.col("device_type_canonical") == MOBILE).alias("_mobile"),
        F.count_if(F.col("device_type_canonical") == DESKTOP).alias("_desktop"),
        F.count("order_id").alias("orders"),
        F.avg("days_since_prev").alias("mean_gap"),
    )
    one_kind = users.filter((F.col("_mobile") == 0) | (F.col("_desktop") == 0))
    device = F.when(F.col("_mobile") > 0, MOBILE).otherwise(DESKTOP)
    return one_kind.select("user_id", device.alias("device"), "orders", "mean_gap")


def orders_per_user(sales: Sales) -> DataFrame:
    return user_metrics(sales).select("user_id", "device", "orders")


def mean_gap_per_user(sales: Sales) -> DataFrame:
    """Users without any known gap drop out, as rows without one did before the grouping."""
    return user_metrics(sales).select("user_id", "device", "mean_gap").filter(F.col("mean_gap").isNotNull())


def orders_test(sales: Sales) -> DataFrame:
    return mann_whitney(orders_per_user(sales), "orders", "device", MOBILE, DESKTOP, "greater")


def gap_test(sales: Sales) -> DataFrame:
    return mann_whitney(mean_gap_per_user(sales), "mean_gap", "device", MOBILE, DESKTOP, "greater")


# Board figures ------------------------------------------------------------------------


def selected(
    rows: DataFrame,
    start: str | None = None,
    end: str | None = None,
    currency: str | None = None,
    region: str | None = None,
    event_type: str | None = None,
) -> DataFrame:
    """Rows that meet every filter given; dates are inclusive."""
    if start:
        rows = rows.filter(F.col("created_dt_msk") >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col("created_dt_msk") <= F.lit(end).cast("date"))
    for column, value in (("currency_code", currency), ("region_name", region), ("event_type_main", event_type)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows


def _figures(rows: DataFrame) -> list[Column]:
    """Revenue and orders, of orders or of the daily figures of ``board``."""
    if "revenue_sum" in rows.columns:
        orders = F.coalesce(F.sum("orders"), F.lit(0))
        return [F.sum("revenue_sum").cast("double").alias("revenue"), orders.alias("orders")]
    return [exact_sum(F.col("revenue_rub")).alias("revenue"), F.count("order_id").alias("orders")]


def _with_mean_order(table: DataFrame) -> DataFrame:
    return table.withColumn("avg_order", ratio(F.col("revenue"), F.col("orders")))


def kpi(rows: DataFrame) -> DataFrame:
    return _with_mean_order(rows.agg(*_figures(rows)))


def revenue_by_period(rows: DataFrame, grain: str = "month") -> DataFrame:
    period = F.date_trunc(grain, F.col("created_dt_msk").cast("timestamp_ntz")).cast("date")
    return _with_mean_order(rows.groupBy(period.alias("period")).agg(*_figures(rows))).orderBy("period")


def revenue_by_segment(rows: DataFrame, key: str) -> DataFrame:
    segments = _with_mean_order(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*_figures(rows)))
    return summary.add_share(segments, ["revenue"]).orderBy(F.desc("revenue"))


def top_segments(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    segments = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*_figures(rows))
    return top_k(_with_mean_order(segments), k, [F.desc("orders"), F.asc(key)])
