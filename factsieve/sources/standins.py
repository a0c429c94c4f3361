"""The input tables of every query, derived from the benchmark tables (see FIXTURES.md).

The original inputs are not public, so each is built from the driver's parquet tables by
fixed expressions; NULLs and unmatched keys are injected by modulus on the key.

Joins between tables that both grow with the data are marked as sort-merge joins. Without
the mark a small run may broadcast either side, depending on which stage ends first, and
two uses of one input in a query then differ in plan and run twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.sources.readers import load


def flats(spark: SparkSession, folder: str) -> DataFrame:
    lines = (
        load(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.expr("sum(l_quantity) AS q"),
            F.expr("count(*) AS n"),
            F.expr("min(l_linenumber) AS lo"),
            F.expr("max(l_linenumber) AS hi"),
            F.expr("sum(CAST(round(l_discount * 100) AS INT)) AS d"),
        )
    )
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = lines.join(orders.hint("merge"), F.expr("o_orderkey = l_orderkey")).join(
        customers, F.expr("c_custkey = o_custkey")
    )
    return joined.selectExpr(
        "l_orderkey AS id",
        "CAST(q AS DOUBLE) AS total_area",
        "CAST(CASE WHEN l_orderkey % 11 <> 0 THEN n END AS INT) AS rooms",
        "CAST(CASE WHEN l_orderkey % 7 <> 0 THEN hi % 4 END AS INT) AS balcony",
        "CASE WHEN l_orderkey % 5 <> 0 THEN CAST(240 + d % 160 AS DOUBLE) / 100D END AS ceiling_height",
        "CAST(lo AS INT) AS floor",
        "CAST(hi + 5 AS INT) AS floors_total",
        "CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS is_apartment",
        "c_nationkey AS city_id",
        "c_mktsegment AS type_id",
    )


def advertisement(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").selectExpr(
        "o_orderkey AS id",
        "CAST(o_orderdate AS DATE) AS first_day_exposition",
        "CASE WHEN o_orderkey % 6 <> 0 THEN CAST((o_orderkey * 37) % 500 AS DOUBLE) END AS days_exposition",
        "o_totalprice AS last_price",
    )


def city(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "nation").selectExpr("n_nationkey AS city_id", "n_name AS city")


def settlement_type(spark: SparkSession, folder: str) -> DataFrame:
    segments = load(spark, folder, "customer").select("c_mktsegment").filter("c_mktsegment <> 'MACHINERY'")
    return segments.distinct().selectExpr("c_mktsegment AS type_id", "lower(c_mktsegment) AS type")


def ticket_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the days since the same user's previous order.

    The previous order is found among the user's distinct order days, not among all rows:
    a second order of one day has a gap of zero, the first one looks one day entry back.
    So a user with a large part of all orders still gives one row per calendar day. A day's row is
    brought to its first order by that order's key, which the lines are joined by as well, so
    the orders are shuffled once. User and day are compared as ranges, as equalities they would become
    keys of the shuffle; they tell apart orders that share a key.
    """
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    orders = orders.filter("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL")
    gap = "datediff(o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))"
    days = (
        orders.groupBy("o_custkey", "o_orderdate")
        .agg(F.expr("min(o_orderkey) AS day_first"))
        .selectExpr("o_custkey AS day_user", "o_orderdate AS day", "day_first", f"{gap} AS gap")
    )
    first = F.expr("o_orderkey = day_first AND o_custkey BETWEEN day_user AND day_user AND o_orderdate BETWEEN day AND day")
    lines = (
        load(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.expr("count(*) AS n"), F.expr("min(l_partkey) AS pk"), F.expr("min(l_suppkey) AS sk"))
    )
    rows = orders.join(days.hint("merge"), first, "left").join(lines.hint("merge"), F.expr("l_orderkey = o_orderkey"))
    return rows.selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS user_id",
        "CAST(o_orderdate AS DATE) AS created_dt_msk",
        "pk AS event_id",
        """CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 12 WHEN 3 THEN 16 ELSE 18 END
           AS INT) AS age_limit""",
        "CASE WHEN o_orderkey % 20 = 0 THEN 'kzt' ELSE 'rub' END AS currency_code",
        """CASE WHEN o_custkey % 5 = 0 THEN 'desktop' WHEN o_custkey % 5 IN (1, 2) THEN 'mobile'
                WHEN o_orderkey % 3 = 0 THEN 'desktop' ELSE 'mobile' END AS device_type_canonical""",
        "CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice ELSE o_totalprice END AS revenue",
        "CAST(CASE WHEN o_orderkey % 1000 = 7 THEN n * 100 ELSE n END AS INT) AS tickets_count",
        "concat('service-', CAST(sk % 36 AS STRING)) AS service_name",
        "CASE WHEN day_first IS NULL THEN 0D ELSE CAST(gap AS DOUBLE) END AS days_since_prev",
    )


def ticket_orders_with_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Ticket orders plus hidden duplicates: equal rows under another order id."""
    orders = ticket_orders(spark, folder)
    copies = "explode(CASE WHEN order_id % 500 = 0 THEN array(0L, 1000000000L) ELSE array(0L) END) AS shift"
    return orders.selectExpr("*", copies).selectExpr(
        "order_id + shift AS order_id", *[c for c in orders.columns if c != "order_id"]
    )


def ticket_events(spark: SparkSession, folder: str) -> DataFrame:
    parts = load(spark, folder, "part").select("p_partkey", "p_type", "p_name").filter("p_partkey % 50 <> 0")
    nations = load(spark, folder, "nation")
    regions = load(spark, folder, "region")
    joined = parts.join(nations, F.expr("n_nationkey = p_partkey % 25")).join(
        regions, F.expr("r_regionkey = n_regionkey")
    )
    return joined.selectExpr(
        "p_partkey AS event_id",
        "p_type AS event_type_main",
        "p_name AS event_type_description",
        "n_name AS region_name",
        "r_name AS city_name",
    )


def rates(spark: SparkSession, folder: str) -> DataFrame:
    dates = load(spark, folder, "orders").selectExpr("CAST(o_orderdate AS DATE) AS data").distinct()
    return dates.selectExpr(
        "data",
        "CAST(CASE WHEN day(data) = 31 THEN 1000 ELSE 100 END AS INT) AS nominal",
        "18D + CAST(day(data) % 8 AS DOUBLE) / 8D AS curs",
        "'kzt' AS cdx",
    )


def ab_participants(spark: SparkSession, folder: str) -> DataFrame:
    users = load(spark, folder, "events").select("user_id").distinct()
    return users.selectExpr(
        "user_id",
        "CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS `group`",
        "CASE WHEN user_id % 5 = 0 THEN 'other_test' ELSE 'interface_eu_test' END AS ab_test",
    )


def ab_events(spark: SparkSession, folder: str, single_registration: bool = True) -> DataFrame:
    """User events; the first signup of a user is the registration, later ones are logins.

    The first signup comes from grouped minima, of the moment and then of the event id, and is
    matched by event id, so no user's events are gathered in one place. Without ``single_registration`` every signup counts.
    """
    events = load(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    name = "CASE WHEN event_type = 'signup' THEN 'registration' ELSE event_type END"
    if single_registration:
        signups = events.filter("event_type = 'signup'").select("user_id", "ts", "event_id")
        moments = signups.groupBy("user_id").agg(F.min("ts").alias("ts"))
        first = (
            signups.join(moments, ["user_id", "ts"])
            .groupBy("user_id")
            .agg(F.min("event_id").alias("event_id"))
            .selectExpr("event_id", "user_id", "true AS is_first")
        )
        events = events.join(first, ["event_id", "user_id"], "left")
        name = """CASE WHEN event_type = 'signup' AND is_first THEN 'registration'
                       WHEN event_type = 'signup' THEN 'login' ELSE event_type END"""
    return events.selectExpr(
        "user_id",
        "ts AS event_dt",
        f"{name} AS event_name",
        "CASE WHEN event_type = 'purchase' THEN value END AS details",
    )


def city_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Hours of use by person and city; every tenth person has a second row elsewhere."""
    people = load(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    copies = "explode(CASE WHEN c_custkey % 10 = 0 THEN array(0L, 1L) ELSE array(0L) END) AS copy"
    return people.selectExpr("*", copies).selectExpr(
        "c_custkey + copy * 1000000000L AS row_no",
        "c_custkey AS puid",
        "CASE WHEN copy = 1 THEN 'AUTOMOBILE' ELSE c_mktsegment END AS city",
        "abs(c_acctbal + copy) AS hours",
    )
