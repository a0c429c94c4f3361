"""Named queries over the benchmark tables; each takes a session and a table folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions import labels
from factsieve.functions.categories import days_label
from factsieve.functions.rounding import half_even
from factsieve.operators import joins, quality, summary
from factsieve.operators.hypothesis import mann_whitney
from factsieve.operators.order_statistics import part_sketches, quantiles
from factsieve.operators.trimming import iqr_fences, iqr_filter
from factsieve.plans import board, city_usage, interface_test, property, tickets
from factsieve.session import scratch_path
from factsieve.sources import files, layout, schemas, standins
from factsieve.sources.readers import load, read_csv
from factsieve.sources.stored import stored, table_version

Query = Callable[[SparkSession, str], DataFrame]

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
CITY_A, CITY_B = "BUILDING", "FURNITURE"
LABEL_MERGE = {"small ring": "red widget"}


def _version(spark: SparkSession, folder: str, *tables: str) -> str:
    return table_version(spark, *[f"{folder.rstrip('/')}/{name}.parquet" for name in tables])


def plain_market(spark: SparkSession, folder: str) -> property.Market:
    return property.Market(
        flats=lambda: standins.flats(spark, folder),
        advertisement=lambda: standins.advertisement(spark, folder),
        city=lambda: standins.city(spark, folder),
        settlement_type=lambda: standins.settlement_type(spark, folder),
        main_city_id=0,
        main_city="NATION_0",
        target_type="BUILDING",
        first_year=1996,
        last_year=1999,
    )


def market(spark: SparkSession, folder: str) -> property.Market:
    """The market with bounds that are found once for each version of its tables."""
    given = plain_market(spark, folder)
    return replace(
        given,
        stored_bounds=lambda: stored(
            spark, "trim-bounds", _version(spark, folder, "lineitem", "orders", "customer"), lambda: property.bound_row(given)
        ),
    )


def sales(spark: SparkSession, folder: str) -> tickets.Sales:
    """Ticket sales whose orders are prepared, and their caps found, once for each version of their tables."""
    given = plain_sales(spark, folder)

    def cleaned() -> DataFrame:
        version = _version(spark, folder, "orders", "lineitem")
        orders = stored(spark, "orders", version, lambda: tickets.order_layout(given), tickets.CLEANED_BY)
        names = [f"{column}_cap" for column in tickets.CAPS]
        found = lambda: tickets.order_caps(orders).select(F.struct(*names).alias("caps"))
        caps = stored(spark, "cap-row", version, found)
        return tickets.usual(orders, caps.select(*[F.col("caps").getField(n).alias(n) for n in names]))

    return replace(given, cleaned=cleaned)


def bucketed_market(spark: SparkSession, folder: str) -> property.Market:
    """The market over tables stored in buckets by id and by year."""
    version = _version(spark, folder, "lineitem", "orders", "customer")
    return layout.bucketed_market(spark, market(spark, folder), version)


def daily_board(spark: SparkSession, folder: str) -> DataFrame:
    """The daily figures of the board, made once for each version of the tables behind them."""
    version = _version(spark, folder, "orders", "lineitem", "part", "nation", "region")
    return stored(spark, "daily-board", version, lambda: board.daily(sales(spark, folder)))


def user_sketches(spark: SparkSession, folder: str) -> DataFrame:
    version = _version(spark, folder, "orders", "lineitem", "part", "nation", "region")
    return stored(spark, "daily-users", version, lambda: board.daily_users(sales(spark, folder)))


def flat_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of the limited columns by town, as a load by town would append them."""
    columns = [limit.column for limit in property.LIMITS]
    version = _version(spark, folder, "lineitem", "orders", "customer")
    return stored(spark, "flat-sketches", version, lambda: part_sketches(standins.flats(spark, folder), columns, ["city_id"]))


def order_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of the capped columns by month."""
    given = plain_sales(spark, folder)
    return stored(
        spark, "order-sketches", _version(spark, folder, "orders", "lineitem"),
        lambda: part_sketches(tickets.deduplicated(given), list(tickets.CAPS), ["month"]),
    )


def price_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of line prices by flag and year of shipping."""
    parts = lambda: part_sketches(
        load(spark, folder, "lineitem").withColumn("year", F.year("l_shipdate")), ["l_extendedprice"], ["l_returnflag", "year"]
    )
    return stored(spark, "price-sketches", _version(spark, folder, "lineitem"), parts)


def plain_sales(spark: SparkSession, folder: str) -> tickets.Sales:
    return tickets.Sales(
        orders=lambda: standins.ticket_orders_with_copies(spark, folder),
        events=lambda: standins.ticket_events(spark, folder),
        rates=lambda: standins.rates(spark, folder),
        label_merge={**LABEL_MERGE, **labels.EVENT_LABEL_MERGE},
    )


def experiment(spark: SparkSession, folder: str, single_registration: bool = True) -> interface_test.Experiment:
    return interface_test.Experiment(
        participants=lambda: standins.ab_participants(spark, folder),
        events=lambda: standins.ab_events(spark, folder, single_registration),
        name="interface_eu_test",
    )


def as_files(spark: SparkSession, tables: dict[str, tuple[DataFrame, T.StructType]]) -> str:
    """Write the stand-ins as CSV with the columns of the original files; the shared folder's path."""
    path = scratch_path(spark, "files")
    for name, (table, schema) in tables.items():
        full = table.withColumns({f.name: F.lit("?").cast(f.dataType) for f in schema.fields if f.name not in table.columns})
        moments = {f.name: F.date_format(f.name, files.MOMENT.replace("[", "").replace("]", "")) for f in schema.fields
                   if isinstance(f.dataType, T.TimestampNTZType)}
        full.withColumns(moments).select(*schema.fieldNames()).write.option("header", True).csv(f"{path}/{name}")
    return path


def cities_count_from_files(spark: SparkSession, folder: str) -> DataFrame:
    tables = {
        "flats": (standins.flats(spark, folder), schemas.FLATS),
        "advertisement": (standins.advertisement(spark, folder), schemas.ADVERTISEMENT),
        "city": (standins.city(spark, folder), schemas.CITY),
        "type": (standins.settlement_type(spark, folder), schemas.SETTLEMENT_TYPE),
    }
    given = market(spark, folder)
    return property.cities_count(
        files.market_from_files(
            spark, as_files(spark, tables), main_city_id=str(given.main_city_id), main_city=given.main_city,
            target_type=given.target_type, first_year=given.first_year, last_year=given.last_year,
        )
    )


def kpi_from_files(spark: SparkSession, folder: str) -> DataFrame:
    orders = standins.ticket_orders_with_copies(spark, folder)
    moment = F.col("created_dt_msk").cast("timestamp_ntz")
    orders = orders.withColumns({"created_ts_msk": moment, "total": F.col("revenue")})
    tables = {
        "orders": (orders, schemas.TICKET_ORDERS),
        "events": (standins.ticket_events(spark, folder), schemas.TICKET_EVENTS),
        "rates": (standins.rates(spark, folder), schemas.CURRENCY_RATES),
    }
    return kpi(files.sales_from_files(spark, as_files(spark, tables)))


def ab_lifetime_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamps are written as text and parsed again."""
    given = experiment(spark, folder)
    tables = {
        "participants": (given.participants(), schemas.AB_PARTICIPANTS),
        "events": (given.events(), schemas.AB_EVENTS),
    }
    found = ab_lifetime(files.experiment_from_files(spark, as_files(spark, tables), given.name))
    return found.withColumn("user_id", F.col("user_id").cast("long"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums of doubles depend on the order of addition; cut that noise off."""
    scale = float(10**digits)
    return df.withColumns({c: F.round(F.col(c) * scale, 0) / scale for c in columns})


def tested(df: DataFrame) -> DataFrame:
    """Test result with p also as a logarithm, which keeps the digits of a far tail."""
    logged = df.withColumn("log10_p", F.log10("p_value"))
    return rounded(rounded(logged, 12, "p_value"), 6, "z", "log10_p")


# Sources and quality ------------------------------------------------------------------


def scan_tables(spark: SparkSession, folder: str) -> DataFrame:
    counts = [
        load(spark, folder, name).agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name in BASE_TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    """City usage written as CSV files to the shared folder and read back by schema."""
    usage = standins.city_usage(spark, folder)
    path = scratch_path(spark, "city_usage_csv")
    usage.write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path, usage.schema)


def retained_share(spark: SparkSession, folder: str) -> DataFrame:
    s = sales(spark, folder)
    kept = quality.retained_share(tickets.priced(s), tickets.clean_orders(s))
    return kept.withColumn("kept_pct", half_even(F.col("kept_pct"), 2))


def describe_value(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.describe(tickets.deduplicated(sales(spark, folder)), "revenue_rub")
    return rounded(found, 4, "mean", "std", "q25", "q50", "q75")


def describe_by_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = city_usage.two_cities(standins.city_usage(spark, folder), "row_no", CITY_A, CITY_B)
    return rounded(quality.describe(rows, "hours", ["city"]), 4, "mean", "std", "q25", "q50", "q75")


def distinct_sorted(spark: SparkSession, folder: str) -> DataFrame:
    s = sales(spark, folder)
    return quality.distinct_values(tickets.with_events(s.orders(), s), "event_type_description", dropna=True, sort=True)


def hidden_dup_count(spark: SparkSession, folder: str) -> DataFrame:
    orders = standins.ticket_orders_with_copies(spark, folder)
    return quality.duplicate_count(orders, quality.other_columns(orders, ["order_id"]), keep="none")


def dup_row_count(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.ab_events(spark, folder)
    return quality.duplicate_count(rows, rows.columns)


def dup_row_count_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Whole ticket rows, and the rows that share all but the id, which some do."""
    orders = standins.ticket_orders_with_copies(spark, folder)
    whole = quality.duplicate_count(orders, orders.columns).withColumnRenamed("duplicates", "whole_rows")
    narrow = quality.duplicate_count(orders, quality.other_columns(orders, ["order_id"])).scalar()
    return whole.select("whole_rows", narrow.alias("but_for_id"))


def signed_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = quality.signed_totals(tickets.priced(sales(spark, folder)), "revenue_rub")
    return rounded(totals, 2, "negative_total", "positive_total")


def filter_eq(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.ticket_orders(spark, folder)
    kept = rows.filter((F.col("device_type_canonical") == "mobile") & (F.col("currency_code") != "rub"))
    return kept.select("order_id", "device_type_canonical", "currency_code")


def filter_isin(spark: SparkSession, folder: str) -> DataFrame:
    return interface_test.goal_events(experiment(spark, folder)).select("user_id", "event_dt", "event_name")


def filter_between(spark: SparkSession, folder: str) -> DataFrame:
    ads = standins.advertisement(spark, folder)
    return ads.filter(F.col("days_exposition").between(31, 90)).select("id", "days_exposition")


def drop_nulls(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.ticket_orders(spark, folder).select("order_id", "user_id", "days_since_prev")
    return rows.na.drop(subset=["days_since_prev"])


def gaps_by_device(spark: SparkSession, folder: str) -> DataFrame:
    return standins.ticket_orders(spark, folder).select("order_id", "device_type_canonical", "days_since_prev")


def iqr_rows(spark: SparkSession, folder: str) -> DataFrame:
    return iqr_filter(gaps_by_device(spark, folder), "days_since_prev", ["device_type_canonical"])


def iqr_bounds(spark: SparkSession, folder: str) -> DataFrame:
    found = iqr_fences(gaps_by_device(spark, folder), "days_since_prev", ["device_type_canonical"])
    return rounded(found.drop("median"), 6, "q1", "q3", "fence_low", "fence_high")


def price_quantiles(spark: SparkSession, folder: str, sketches: DataFrame | None = None) -> DataFrame:
    levels = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}
    rows = load(spark, folder, "lineitem")
    found = quantiles(rows, "l_extendedprice", levels, ["l_returnflag"], sketches=sketches)
    return rounded(found, 6, *levels)


def downcast_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.ticket_orders(spark, folder).select("user_id", "age_limit", "tickets_count")
    rates = quality.narrowing_failures(standins.rates(spark, folder), ["nominal"])
    return quality.narrowing_failures(rows, rows.columns).unionByName(rates)


def replace_labels(spark: SparkSession, folder: str) -> DataFrame:
    events = quality.replace_labels(standins.ticket_events(spark, folder), "event_type_description", LABEL_MERGE)
    return events.groupBy("event_type_description").agg(F.count("*").alias("events"))


# Property -----------------------------------------------------------------------------


def _market(analysis: Callable[[property.Market], DataFrame]) -> Query:
    return lambda spark, folder: analysis(market(spark, folder))


def trim_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return property.usual_advertisements(market(spark, folder)).select("id", "days_exposition", "last_price")


def join_left_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return property.listed_with_flat(market(spark, folder)).select("id", "last_price", "total_area", "type_id")


def bucket_days(spark: SparkSession, folder: str) -> DataFrame:
    label = days_label(F.col("days_exposition")).alias("category_days_exp")
    return standins.advertisement(spark, folder).select("id", "days_exposition", label)


# Tickets ------------------------------------------------------------------------------


def _sales(analysis: Callable[[tickets.Sales], DataFrame]) -> Query:
    return lambda spark, folder: analysis(sales(spark, folder))


def _unprepared(analysis: Callable[[tickets.Sales], DataFrame]) -> Query:
    """From the orders themselves, with nothing stored."""
    return lambda spark, folder: analysis(plain_sales(spark, folder))


def _priced(*columns: str) -> Query:
    return lambda spark, folder: tickets.priced(sales(spark, folder)).select("order_id", *columns)


def tickets_clean(s: tickets.Sales) -> DataFrame:
    return tickets.clean_tickets(s).select(
        "order_id", "user_id", "created_dt_msk", "event_id", "age_limit", "currency_code", "device_type_canonical",
        "revenue", "tickets_count", "service_name", "days_since_prev", "event_type_main", "event_type_description",
        "region_name", "city_name", "nominal", "curs", "cdx", "revenue_rub", "one_ticket_revenue_rub", "month", "season",
    )


def enrich_events(s: tickets.Sales) -> DataFrame:
    return tickets.with_events(s.orders(), s).select(
        "order_id", "event_id", "event_type_main", "event_type_description", "region_name", "city_name"
    )


def enrich_rates(s: tickets.Sales) -> DataFrame:
    return tickets.with_rates(s.orders(), s).select("order_id", "created_dt_msk", "nominal", "curs", "cdx")


def dedup_hidden(s: tickets.Sales) -> DataFrame:
    return quality.drop_hidden_duplicates(s.orders(), "order_id").select("order_id", "user_id", "revenue", "days_since_prev")


def cap_q99(s: tickets.Sales, sketches: DataFrame | None = None) -> DataFrame:
    return rounded(tickets.caps(s, sketches), 6, "revenue_q99", "tickets_q99")


def box_revenue(s: tickets.Sales) -> DataFrame:
    return rounded(summary.box_stats(tickets.deduplicated(s), "revenue_rub"), 6, "q1", "median", "q3")


def box_tickets(s: tickets.Sales) -> DataFrame:
    return rounded(summary.box_stats(tickets.clean_orders(s), "tickets_count"), 6, "q1", "median", "q3")


def ticket_price_change(s: tickets.Sales) -> DataFrame:
    return rounded(tickets.ticket_price_change(s), 4, "spring", "summer", "autumn", "winter", "change_pct")


def region_summary(s: tickets.Sales) -> DataFrame:
    return rounded(tickets.region_summary(s), 6, "events_pct", "orders_pct", "events_heat", "orders_heat")


def partner_summary(s: tickets.Sales) -> DataFrame:
    columns = ["events", "orders", "total_revenue"]
    table = rounded(tickets.partner_summary(s), 6, *[f"{c}_{f}" for c in columns for f in ("pct", "heat")])
    return rounded(table, 2, "total_revenue")


def orders_per_weekday(s: tickets.Sales) -> DataFrame:
    return rounded(tickets.orders_per_weekday(s), 6, "mean_orders")


def users_per_weekday(s: tickets.Sales) -> DataFrame:
    return rounded(tickets.users_per_weekday(s), 6, "mean_users")


def leaders_share(s: tickets.Sales) -> DataFrame:
    return rounded(tickets.leaders_share(s), 6, "events_pct", "orders_pct")


def mean_gap_per_user(s: tickets.Sales) -> DataFrame:
    return rounded(tickets.mean_gap_per_user(s), 6, "mean_gap")


def device_overlap(s: tickets.Sales) -> DataFrame:
    rows = tickets.autumn(tickets.clean_orders(s))
    return joins.overlap_count(rows, "user_id", "device_type_canonical", tickets.MOBILE, tickets.DESKTOP)


def overlap_after(s: tickets.Sales) -> DataFrame:
    """The overlap that excluding shared users leaves (none), and the users of each group then."""
    rows = tickets.autumn(tickets.clean_orders(s)).select("user_id", "device_type_canonical")
    left = joins.independent_samples(rows, "user_id", "device_type_canonical", tickets.MOBILE, tickets.DESKTOP)
    return joins.overlap_count(left, "user_id", "device_type_canonical", tickets.MOBILE, tickets.DESKTOP)


def describe_tickets(s: tickets.Sales) -> DataFrame:
    found = quality.describe(tickets.deduplicated(s), "tickets_count")
    return rounded(found, 4, "mean", "std", "q25", "q50", "q75")


def box_tickets_all(s: tickets.Sales) -> DataFrame:
    return rounded(summary.box_stats(tickets.deduplicated(s), "tickets_count"), 6, "q1", "median", "q3")


def box_revenue_clean(s: tickets.Sales) -> DataFrame:
    return rounded(summary.box_stats(tickets.clean_orders(s), "revenue_rub"), 6, "q1", "median", "q3")


def exclude_overlap(s: tickets.Sales) -> DataFrame:
    rows = tickets.autumn(tickets.clean_orders(s)).select("order_id", "user_id", "device_type_canonical")
    return joins.independent_samples(rows, "user_id", "device_type_canonical", tickets.MOBILE, tickets.DESKTOP)


def missing_gaps(s: tickets.Sales) -> DataFrame:
    rows = tickets.autumn(tickets.clean_orders(s))
    return quality.null_count(rows, "days_since_prev", ["device_type_canonical"])


def hist_orders_per_user(s: tickets.Sales) -> DataFrame:
    bins = summary.histogram(tickets.orders_per_user(s), "orders", 10, ["device"])
    return rounded(bins, 6, "bin_low", "bin_high")


def hist_gap(s: tickets.Sales) -> DataFrame:
    bins = summary.histogram(tickets.mean_gap_per_user(s), "mean_gap", 30, ["device"])
    return rounded(bins, 6, "bin_low", "bin_high")


def kpi(s: tickets.Sales) -> DataFrame:
    return rounded(tickets.kpi(tickets.clean_orders(s)), 2, "revenue", "avg_order")


def kpi_filtered(s: tickets.Sales) -> DataFrame:
    rows = tickets.clean_between(s, tickets.cap_row(s), "1996-01-01", "1999-12-31")
    rows = tickets.selected(tickets.with_events(rows, s), currency="rub", region="NATION_7", event_type="ECONOMY")
    return rounded(tickets.kpi(rows), 2, "revenue", "avg_order")


def revenue_by_period(s: tickets.Sales) -> DataFrame:
    return rounded(tickets.revenue_by_period(tickets.clean_orders(s), "month"), 2, "revenue", "avg_order")


def revenue_by_segment(s: tickets.Sales) -> DataFrame:
    table = tickets.revenue_by_segment(tickets.clean_tickets(s), "event_type_main")
    return rounded(rounded(table, 2, "revenue", "avg_order"), 6, "revenue_pct")


def revenue_by_device(s: tickets.Sales) -> DataFrame:
    table = tickets.revenue_by_segment(tickets.clean_orders(s), "device_type_canonical")
    return rounded(rounded(table, 2, "revenue", "avg_order"), 6, "revenue_pct")


def revenue_by_region(s: tickets.Sales) -> DataFrame:
    table = tickets.revenue_by_segment(tickets.clean_tickets(s), "region_name")
    return rounded(rounded(table, 2, "revenue", "avg_order"), 6, "revenue_pct")


def _top(key: str, k: int) -> Callable[[tickets.Sales], DataFrame]:
    return lambda s: rounded(tickets.top_segments(tickets.clean_tickets(s), key, k), 2, "revenue", "avg_order")


# The same figures from the stored daily table


def _board(analysis: Callable[[DataFrame], DataFrame], *percents: str) -> Query:
    return lambda s, d: rounded(rounded(analysis(daily_board(s, d)), 2, "revenue", "avg_order"), 6, *percents)


def kpi_filtered_from_board(rows: DataFrame) -> DataFrame:
    part = tickets.selected(
        rows, "1996-01-01", "1999-12-31", currency="rub", region="NATION_7", event_type="ECONOMY"
    )
    return tickets.kpi(part)


def active_users(spark: SparkSession, folder: str) -> DataFrame:
    """Users by weekday, month, device and region: the exact count, and whether merged sketches come near it."""
    orders = tickets.clean_tickets(sales(spark, folder))
    sketches = user_sketches(spark, folder)

    def both(grain: str) -> DataFrame:
        exact = board.exact_users_by(orders, grain)
        near = board.users_by(sketches, grain).withColumnRenamed("users", "_near")
        close = F.abs(F.col("_near") - F.col("users")) <= F.ceil(F.col("users") * board.ERROR)
        key = F.col(grain).cast("string").alias("key")
        return exact.join(near, grain, "left").select(F.lit(grain).alias("grain"), key, "users", F.coalesce(close, F.lit(False)).alias("near"))

    return reduce(DataFrame.unionByName, [both(g) for g in ("weekday", "month", "device", "region")])


# City usage and conversion test -------------------------------------------------------


def dedup_key(spark: SparkSession, folder: str) -> DataFrame:
    return city_usage.people(standins.city_usage(spark, folder), "row_no")


def city_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap before the rows are reduced to one per person (after it, none is possible)."""
    return joins.overlap_count(standins.city_usage(spark, folder), "puid", "city", "AUTOMOBILE", CITY_A)


def hist_city_hours(spark: SparkSession, folder: str) -> DataFrame:
    rows = city_usage.two_cities(standins.city_usage(spark, folder), "row_no", CITY_A, CITY_B)
    return rounded(summary.histogram(rows, "hours", 20, ["city"]), 6, "bin_low", "bin_high")


def hist_city_hours_fenced(spark: SparkSession, folder: str) -> DataFrame:
    rows = city_usage.two_cities(standins.city_usage(spark, folder), "row_no", CITY_A, CITY_B)
    return rounded(summary.histogram(iqr_filter(rows, "hours", ["city"]), "hours", 20, ["city"]), 6, "bin_low", "bin_high")


def hist_value(spark: SparkSession, folder: str) -> DataFrame:
    bins = summary.histogram(load(spark, folder, "events"), "value", 20)
    return rounded(bins, 6, "bin_low", "bin_high")


def mw_value(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "events")
    return tested(mann_whitney(rows, "value", "event_type", "purchase", "click"))


def mw_city_hours(spark: SparkSession, folder: str) -> DataFrame:
    return tested(city_usage.city_test(standins.city_usage(spark, folder), "row_no", CITY_A, CITY_B))


def mw_city_hours_fenced(spark: SparkSession, folder: str) -> DataFrame:
    return tested(city_usage.city_test(standins.city_usage(spark, folder), "row_no", CITY_A, CITY_B, fenced=True))


def _test(analysis: Callable[[interface_test.Experiment], DataFrame]) -> Query:
    return lambda spark, folder: analysis(experiment(spark, folder))


def ab_merge(t: interface_test.Experiment) -> DataFrame:
    return interface_test.merged(t).select("user_id", "group", "event_name", "event_dt")


def ab_lifetime(t: interface_test.Experiment) -> DataFrame:
    return interface_test.lived_events(t).select(
        "user_id", "group", "event_name", "event_dt", "registration_dt", "lifetime_days"
    )


def ab_overlap(t: interface_test.Experiment) -> DataFrame:
    return joins.overlap_count(interface_test.members(t), "user_id", "group", interface_test.A, interface_test.B)


def hist_lifetime(t: interface_test.Experiment) -> DataFrame:
    bins = summary.histogram(interface_test.early_purchases(t), "lifetime_days", 20)
    return rounded(bins, 6, "bin_low", "bin_high")


def ztest(analysis: Callable[[interface_test.Experiment], DataFrame]) -> Query:
    return lambda spark, folder: rounded(tested(analysis(experiment(spark, folder))), 10, "p_a", "p_b")


def queries() -> dict[str, Query]:
    return {
        # scans and quality
        "scan_tables": scan_tables,
        "scan_csv": scan_csv,
        "head_rows": lambda s, d: quality.head(standins.ticket_orders(s, d), 5, ["order_id"]),
        "null_profile": lambda s, d: quality.null_profile(standins.ticket_orders(s, d)),
        "retained_share": retained_share,
        "describe_value": describe_value,
        "describe_by_group": describe_by_group,
        "distinct_values": lambda s, d: quality.distinct_values(standins.ab_events(s, d), "event_name"),
        "distinct_sorted": distinct_sorted,
        "dup_key_count": lambda s, d: quality.duplicate_count(standins.city_usage(s, d), ["puid"]),
        "dup_row_count": dup_row_count,
        "hidden_dup_count": hidden_dup_count,
        "signed_totals": signed_totals,
        "null_count": _sales(missing_gaps),
        "downcast_check": downcast_check,
        "dup_row_count_tickets": dup_row_count_tickets,
        "replace_labels": replace_labels,
        # filters
        "filter_eq": filter_eq,
        "filter_isin": filter_isin,
        "filter_between": filter_between,
        "drop_nulls": drop_nulls,
        "iqr_filter": iqr_rows,
        "iqr_fences": iqr_bounds,
        "quantiles": price_quantiles,
        # property
        "segment_profile": _market(property.segment_profile),
        "rooms_profile": _market(property.rooms_profile),
        "rooms_profile_slow": _market(
            lambda m: property.rooms_profile(m, labels.REGION_OTHER, labels.DAYS_OVER_YEAR)
        ),
        "season_rank": _market(property.season_rank),
        "season_prices": _market(property.season_prices),
        "cities_count": _market(property.cities_count),
        "closed_share_by_city": _market(property.closed_share_by_city),
        "cities_above_avg": _market(property.cities_above_avg),
        "price_by_city": _market(property.price_by_city),
        "price_by_type": _market(property.price_by_type),
        "days_by_city": _market(property.days_by_city),
        "days_by_type": _market(property.days_by_type),
        "trim_bounds": lambda s, d: property.bounds(plain_market(s, d)),
        "trim_ids": lambda s, d: property.usual_ids(plain_market(s, d)),
        "trim_semi_join": trim_semi_join,
        "join_left_filtered": join_left_filtered,
        "bucket_days": bucket_days,
        # tickets
        "enrich_events": _sales(enrich_events),
        "enrich_rates": _sales(enrich_rates),
        "revenue_rub": _priced("revenue_rub"),
        "one_ticket_revenue": _priced("one_ticket_revenue_rub"),
        "season_label": _priced("month", "season"),
        "dedup_hidden": _sales(dedup_hidden),
        "cap_q99": _unprepared(cap_q99),
        "tickets_clean": _unprepared(tickets_clean),
        "box_stats": _sales(box_revenue),
        "box_tickets": _sales(box_tickets),
        "box_tickets_all": _sales(box_tickets_all),
        "box_revenue_clean": _sales(box_revenue_clean),
        "describe_tickets": _sales(describe_tickets),
        "orders_per_month": _sales(tickets.orders_per_month),
        "pivot_event_season": _sales(tickets.event_season_mix),
        "pivot_device_season": _sales(tickets.device_season_mix),
        "pivot_age_season": _sales(tickets.age_season_mix),
        "ticket_price_change": _sales(ticket_price_change),
        "daily_activity": _sales(tickets.daily_activity),
        "orders_per_weekday": _sales(orders_per_weekday),
        "users_per_weekday": _sales(users_per_weekday),
        "region_summary": _sales(region_summary),
        "partner_summary": _sales(partner_summary),
        "top5_share": _sales(leaders_share),
        "group_overlap": _sales(device_overlap),
        "exclude_overlap": _sales(exclude_overlap),
        "overlap_after": _sales(overlap_after),
        "orders_per_user": _sales(tickets.orders_per_user),
        "mean_gap_per_user": _sales(mean_gap_per_user),
        "hist_orders_per_user": _sales(hist_orders_per_user),
        "hist_gap": _sales(hist_gap),
        "mw_orders_per_user": lambda s, d: tested(tickets.orders_test(sales(s, d))),
        "mw_gap": lambda s, d: tested(tickets.gap_test(sales(s, d))),
        "kpi": _sales(kpi),
        "kpi_filtered": _unprepared(kpi_filtered),
        "revenue_by_period": _sales(revenue_by_period),
        "revenue_by_segment": _sales(revenue_by_segment),
        "revenue_by_device": _sales(revenue_by_device),
        "revenue_by_region": _sales(revenue_by_region),
        "top_regions": _sales(_top("region_name", 5)),
        "top_cities": _sales(_top("city_name", 3)),
        "top_events": _sales(_top("event_id", 10)),
        # the same from stored daily figures, user sketches, value sketches and bucketed tables
        "kpi_from_board": _board(tickets.kpi),
        "kpi_filtered_from_board": _board(kpi_filtered_from_board),
        "revenue_by_period_from_board": _board(lambda b: tickets.revenue_by_period(b, "month")),
        "revenue_by_segment_from_board": _board(lambda b: tickets.revenue_by_segment(b, "event_type_main"), "revenue_pct"),
        "revenue_by_device_from_board": _board(lambda b: tickets.revenue_by_segment(b, "device_type_canonical"), "revenue_pct"),
        "revenue_by_region_from_board": _board(lambda b: tickets.revenue_by_segment(b, "region_name"), "revenue_pct"),
        "top_regions_from_board": _board(lambda b: tickets.top_segments(b, "region_name", 5)),
        "top_cities_from_board": _board(lambda b: tickets.top_segments(b, "city_name", 3)),
        "active_users": active_users,
        "trim_bounds_from_sketches": lambda s, d: property.bounds(plain_market(s, d), flat_sketches(s, d)),
        "cap_q99_from_sketches": lambda s, d: cap_q99(plain_sales(s, d), order_sketches(s, d)),
        "quantiles_from_sketches": lambda s, d: price_quantiles(s, d, price_sketches(s, d)),
        "segment_profile_from_buckets": lambda s, d: property.segment_profile(bucketed_market(s, d)),
        "season_rank_from_buckets": lambda s, d: property.season_rank(bucketed_market(s, d)),
        "season_prices_from_buckets": lambda s, d: property.season_prices(bucketed_market(s, d)),
        "price_by_city_from_buckets": lambda s, d: property.price_by_city(bucketed_market(s, d)),
        # city usage
        "dedup_key": dedup_key,
        "city_overlap": city_overlap,
        "hist_city_hours": hist_city_hours,
        "hist_city_hours_fenced": hist_city_hours_fenced,
        "hist_value": hist_value,
        "mw_value": mw_value,
        "mw_city_hours": mw_city_hours,
        "mw_city_hours_fenced": mw_city_hours_fenced,
        # conversion test
        "ab_merge": _test(ab_merge),
        "ab_lifetime_from_files": ab_lifetime_from_files,
        "cities_count_from_files": cities_count_from_files,
        "kpi_from_files": kpi_from_files,
        "ab_lifetime": _test(ab_lifetime),
        "ab_lifetime_fanout": lambda s, d: interface_test.registration_fanout(experiment(s, d, single_registration=False)),
        "ab_overlap": _test(ab_overlap),
        "users_by_group": _test(interface_test.users_by_group),
        "ab_conversion": _test(interface_test.conversion),
        "ab_conversion_from_start": _test(lambda t: interface_test.conversion(t, min_days=0)),
        "hist_lifetime": _test(hist_lifetime),
        "sample_size_check": _test(interface_test.enough_users),
        "ztest_rows": ztest(interface_test.ztest_rows),
        "ztest_rows_fanout": lambda s, d: rounded(
            tested(interface_test.ztest_rows_fanout(experiment(s, d, single_registration=False))), 10, "p_a", "p_b"
        ),
        "ztest_users": ztest(interface_test.ztest_users),
    }
