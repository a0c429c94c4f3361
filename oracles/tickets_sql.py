"""Checks of the ticket queries."""

from __future__ import annotations

from oracles.inputs import even, exact_sum, interpolated, query
from oracles.tests_sql import RANK_RESULT, box_steps, histogram_steps, rank_steps

ORDERS, EVENTS, RATES = "fx_ticket_orders", "fx_ticket_events", "fx_rates"

ALL_ORDERS = (
    "all_orders",
    """SELECT * FROM fx_ticket_orders
       UNION ALL
       SELECT * REPLACE (order_id + 1000000000 AS order_id) FROM fx_ticket_orders WHERE order_id % 500 = 0""",
)
# Two-digit rounding of the exact binary value: "slip" is what the product by 100 lost.
CONVERTED = """
    SELECT *, x * 100 AS product,
           (h * 100 - x * 100) + (x - h) * 100 AS slip
    FROM (SELECT *, x * 134217729 - (x * 134217729 - x) AS h
          FROM (SELECT o.*, r.*, CAST(o.revenue AS DOUBLE) / r.nominal * r.curs AS x
                FROM all_orders o LEFT JOIN fx_rates r ON r.data = o.created_dt_msk))"""
PRICED = (
    "priced",
    f"""SELECT *, {even('revenue_rub / nullif(tickets_count, 0)', 2)} AS one_ticket_revenue_rub,
              CAST(month(created_dt_msk) AS INT) AS month,
              CASE month(created_dt_msk) // 3 WHEN 1 THEN 'весна' WHEN 2 THEN 'лето' WHEN 3 THEN 'осень'
                   ELSE 'зима' END AS season
       FROM (SELECT *, CASE WHEN currency_code = cdx THEN
                 (CASE WHEN product - floor(product) <> 0.5 THEN round_even(product, 0)
                       WHEN slip > 0 THEN floor(product) + 1
                       WHEN slip < 0 THEN floor(product)
                       ELSE round_even(product, 0) END) / 100
               ELSE revenue END AS revenue_rub
             FROM ({CONVERTED}))""",
)
UNIQUE = (
    "deduped",
    """SELECT * FROM priced
       QUALIFY row_number() OVER (
         PARTITION BY user_id, created_dt_msk, event_id, age_limit, currency_code, device_type_canonical, revenue,
                      tickets_count, service_name, days_since_prev
         ORDER BY order_id) = 1""",
)
CAPS = [
    ("cap_revenue", interpolated("deduped", "revenue_rub", {"revenue_q99": 0.99})),
    ("cap_tickets", interpolated("deduped", "tickets_count", {"tickets_q99": 0.99})),
]
CLEAN = (
    "clean",
    """SELECT deduped.* FROM deduped, cap_revenue, cap_tickets
       WHERE revenue_rub > 0 AND revenue_rub <= revenue_q99 AND tickets_count <= tickets_q99""",
)
FULL = (
    "tickets",
    """SELECT c.*, e.* EXCLUDE (event_id, event_type_description),
              CASE e.event_type_description WHEN 'спорт' THEN 'спортивное мероприятие'
                   WHEN 'small ring' THEN 'red widget' ELSE e.event_type_description END AS event_type_description
       FROM clean c LEFT JOIN fx_ticket_events e ON e.event_id = c.event_id""",
)
AUTUMN = ("autumn", "SELECT * FROM clean WHERE season = 'осень'")
USERS = (
    "users",
    """SELECT user_id, min(device_type_canonical) AS device, count(order_id) AS orders, avg(days_since_prev) AS mean_gap
       FROM autumn
       WHERE user_id NOT IN (
         SELECT user_id FROM autumn WHERE device_type_canonical = 'mobile'
         INTERSECT SELECT user_id FROM autumn WHERE device_type_canonical = 'desktop')
       GROUP BY user_id""",
)
TO_PRICED = [ALL_ORDERS, PRICED]
TO_CLEAN = [*TO_PRICED, UNIQUE, *CAPS, CLEAN]
TO_FULL = [*TO_CLEAN, FULL]
TO_AUTUMN = [*TO_CLEAN, AUTUMN]
TO_USERS = [*TO_AUTUMN, USERS]
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
SEASONS = {"spring": "весна", "summer": "лето", "autumn": "осень", "winter": "зима"}


def _orders(steps, body):
    return query([ORDERS, RATES], steps, body)


def _full(steps, body):
    return query([ORDERS, RATES, EVENTS], steps, body)


def _mix(key: str) -> tuple[list[tuple[str, str]], str]:
    cells = ", ".join(
        f"nullif(count(*) FILTER (WHERE season = '{label}'), 0) AS {name}" for name, label in SEASONS.items()
    )
    shares = ", ".join(
        f"{even(f'CAST({n} AS DOUBLE) / sum({n}) OVER () * 100', 2)} AS {n}_pct" for n in SEASONS
    )
    step = ("mix", f"SELECT {key}, {cells} FROM tickets WHERE {key} IS NOT NULL GROUP BY {key}")
    return [step], f"SELECT *, {shares} FROM mix"


def _share(column: str) -> str:
    return f"CAST({column} AS DOUBLE) / sum({column}) OVER () * 100 AS {column}_pct"


def _heat(column: str) -> str:
    span = f"(max({column}) OVER () - min({column}) OVER ())"
    return f"round(({column} - min({column}) OVER ()) / nullif({span}, 0), 6) AS {column.removesuffix('_pct')}_heat"


REVENUE = exact_sum("revenue_rub")
FIGURES = f"""round({REVENUE}, 2) AS revenue, count(order_id) AS orders,
              round({REVENUE} / count(order_id), 2) AS avg_order"""

REGIONS = (
    "regions",
    """SELECT region_name, count(order_id) AS orders, count(DISTINCT event_id) AS events
       FROM tickets WHERE season = 'осень' AND region_name IS NOT NULL GROUP BY region_name""",
)
REGION_SHARES = ("region_shares", f"SELECT *, {_share('events')}, {_share('orders')} FROM regions")
PARTNERS = (
    "partners",
    f"""SELECT service_name, count(order_id) AS orders, count(DISTINCT event_id) AS events,
              {REVENUE} AS total_revenue FROM tickets WHERE season = 'осень' GROUP BY service_name""",
)
PARTNER_SHARES = (
    "partner_shares", f"SELECT *, {_share('events')}, {_share('orders')}, {_share('total_revenue')} FROM partners"
)


def _weekday(counted: str, name: str) -> str:
    return _orders(
        [*TO_AUTUMN, ("days", f"SELECT CAST(isodow(created_dt_msk) AS INT) AS weekday, {counted} AS {name} FROM autumn GROUP BY 1")],
        f"SELECT weekday, {name}, weekday >= 6 AS is_weekend, round(avg({name}) OVER (), 6) AS mean_{name} FROM days",
    )


def _segments(key: str) -> str:
    return f"""SELECT {key}, {FIGURES}, round({REVENUE} / sum({REVENUE}) OVER () * 100, 6) AS revenue_pct
               FROM tickets WHERE {key} IS NOT NULL GROUP BY {key}"""


def _top(key: str, k: int) -> str:
    return f"""SELECT {key}, {FIGURES} FROM tickets WHERE {key} IS NOT NULL
               GROUP BY {key} ORDER BY count(order_id) DESC, {key} LIMIT {k}"""


def _tested(value: str) -> str:
    return _orders([*TO_USERS, *rank_steps("users", value, "device", "mobile", "desktop", "greater")], RANK_RESULT)


def statements() -> dict[str, str]:
    event_mix, event_body = _mix("event_type_main")
    device_mix, device_body = _mix("device_type_canonical")
    age_mix, age_body = _mix("age_limit")
    def season_mean(label: str) -> str:
        inside = f"(CASE WHEN season = '{label}' THEN one_ticket_revenue_rub END)"
        return f"{exact_sum(inside)} / nullif(count({inside}), 0)"

    prices = ", ".join(f"{season_mean(label)} AS {n}" for n, label in SEASONS.items())
    filled = ["order_id", "user_id", "created_dt_msk", "event_id", "age_limit", "currency_code",
              "device_type_canonical", "revenue", "tickets_count", "service_name", "days_since_prev"]
    kinds = ["bigint", "bigint", "date", "bigint", "int", "string", "string", "double", "int", "string", "double"]
    profile = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", '{k}' AS type, count({c}) AS filled, count(*) - count({c}) AS missing FROM fx_ticket_orders"""
        for c, k in zip(filled, kinds)
    )
    failures = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} NOT BETWEEN -128 AND 127) AS failures FROM fx_ticket_orders"""
        for c in ("user_id", "age_limit", "tickets_count")
    ) + """
UNION ALL
SELECT 'nominal', count(*) FILTER (WHERE nominal NOT BETWEEN -128 AND 127) FROM fx_rates"""
    all_columns = """order_id, user_id, created_dt_msk, event_id, age_limit, currency_code, device_type_canonical,
        revenue, tickets_count, service_name, days_since_prev, event_type_main, event_type_description, region_name,
        city_name, nominal, curs, cdx, revenue_rub, one_ticket_revenue_rub, month, season"""
    return {
        "null_profile": query([ORDERS], [], profile),
        "downcast_check": query([ORDERS, RATES], [], failures),
        "head_rows": query([ORDERS], [], "SELECT * FROM fx_ticket_orders ORDER BY order_id LIMIT 5"),
        "filter_eq": query([ORDERS], [], """SELECT order_id, device_type_canonical, currency_code FROM fx_ticket_orders
            WHERE device_type_canonical = 'mobile' AND currency_code <> 'rub'"""),
        "drop_nulls": query([ORDERS], [], """SELECT order_id, user_id, days_since_prev FROM fx_ticket_orders
            WHERE days_since_prev IS NOT NULL"""),
        "replace_labels": query([EVENTS], [], """SELECT replace(event_type_description, 'small ring', 'red widget')
            AS event_type_description, count(*) AS events FROM fx_ticket_events GROUP BY 1"""),
        "hidden_dup_count": query([ORDERS], [ALL_ORDERS], f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicates FROM (
            SELECT count(*) AS n FROM all_orders GROUP BY {', '.join(filled[1:])} HAVING count(*) > 1)"""),
        "distinct_sorted": query([ORDERS, EVENTS], [ALL_ORDERS], """
            SELECT DISTINCT CASE event_type_description WHEN 'спорт' THEN 'спортивное мероприятие'
                   WHEN 'small ring' THEN 'red widget' ELSE event_type_description END AS event_type_description
            FROM all_orders o LEFT JOIN fx_ticket_events e ON e.event_id = o.event_id
            WHERE event_type_description IS NOT NULL"""),
        "enrich_events": query([ORDERS, EVENTS], [ALL_ORDERS], """
            SELECT order_id, o.event_id, event_type_main,
                   CASE event_type_description WHEN 'small ring' THEN 'red widget' ELSE event_type_description END
                     AS event_type_description, region_name, city_name
            FROM all_orders o LEFT JOIN fx_ticket_events e ON e.event_id = o.event_id"""),
        "enrich_rates": _orders([ALL_ORDERS], """SELECT order_id, created_dt_msk, nominal, curs, cdx
            FROM all_orders LEFT JOIN fx_rates ON data = created_dt_msk"""),
        "iqr_fences": query([ORDERS], [("q", interpolated("fx_ticket_orders", "days_since_prev", {"q1": 0.25, "q3": 0.75}, "device_type_canonical"))],
            """SELECT device_type_canonical, round(q1, 6) AS q1, round(q3, 6) AS q3,
                      round(q1 - 1.5 * (q3 - q1), 6) AS fence_low, round(q3 + 1.5 * (q3 - q1), 6) AS fence_high FROM q"""),
        "iqr_filter": query([ORDERS], [("q", interpolated("fx_ticket_orders", "days_since_prev", {"q1": 0.25, "q3": 0.75}, "device_type_canonical"))],
            """SELECT order_id, o.device_type_canonical, days_since_prev
               FROM fx_ticket_orders o JOIN q ON q.device_type_canonical = o.device_type_canonical
               WHERE days_since_prev >= q1 - 1.5 * (q3 - q1) AND days_since_prev <= q3 + 1.5 * (q3 - q1)"""),
        "revenue_rub": _orders(TO_PRICED, "SELECT order_id, revenue_rub FROM priced"),
        "one_ticket_revenue": _orders(TO_PRICED, "SELECT order_id, one_ticket_revenue_rub FROM priced"),
        "season_label": _orders(TO_PRICED, "SELECT order_id, month, season FROM priced"),
        "signed_totals": _orders(TO_PRICED, """
            SELECT round(sum(revenue_rub) FILTER (WHERE revenue_rub < 0), 2) AS negative_total,
                   round(sum(revenue_rub) FILTER (WHERE revenue_rub > 0), 2) AS positive_total FROM priced"""),
        "dedup_hidden": _orders([*TO_PRICED, UNIQUE], "SELECT order_id, user_id, revenue, days_since_prev FROM deduped"),
        "cap_q99": _orders([*TO_PRICED, UNIQUE, *CAPS],
            "SELECT round(revenue_q99, 6) AS revenue_q99, round(tickets_q99, 6) AS tickets_q99 FROM cap_revenue, cap_tickets"),
        "describe_value": _orders(
            [*TO_PRICED, UNIQUE, ("q", interpolated("deduped", "revenue_rub", {"q25": 0.25, "q50": 0.5, "q75": 0.75}))],
            """SELECT count(revenue_rub) AS count, round(avg(revenue_rub), 4) AS mean, round(stddev_samp(revenue_rub), 4) AS std,
                      min(revenue_rub) AS min, round(any_value(q25), 4) AS q25, round(any_value(q50), 4) AS q50,
                      round(any_value(q75), 4) AS q75, max(revenue_rub) AS max FROM deduped, q"""),
        "retained_share": _orders(TO_CLEAN, f"""
            SELECT *, {even('CAST(rows_after AS DOUBLE) / rows_before * 100', 2)} AS kept_pct FROM (
            SELECT (SELECT count(*) FROM priced) AS rows_before, (SELECT count(*) FROM clean) AS rows_after)"""),
        "tickets_clean": _full(TO_FULL, f"SELECT {all_columns} FROM tickets"),
        "box_stats": _orders([*TO_PRICED, UNIQUE, *box_steps("deduped", "revenue_rub", interpolated("deduped", "revenue_rub", QUARTILES))], "SELECT * FROM box"),
        "dup_row_count_tickets": query([ORDERS], [ALL_ORDERS], """
            SELECT (SELECT count(*) FROM all_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM all_orders)) AS whole_rows,
                   (SELECT count(*) FROM all_orders)
                   - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (order_id) FROM all_orders)) AS but_for_id"""),
        "describe_tickets": _orders(
            [*TO_PRICED, UNIQUE, ("q", interpolated("deduped", "tickets_count", {"q25": 0.25, "q50": 0.5, "q75": 0.75}))],
            """SELECT count(tickets_count) AS count, round(avg(tickets_count), 4) AS mean, round(stddev_samp(tickets_count), 4) AS std,
                      CAST(min(tickets_count) AS DOUBLE) AS min, round(any_value(q25), 4) AS q25, round(any_value(q50), 4) AS q50,
                      round(any_value(q75), 4) AS q75, CAST(max(tickets_count) AS DOUBLE) AS max FROM deduped, q"""),
        "box_tickets_all": _orders([*TO_PRICED, UNIQUE, *box_steps("deduped", "tickets_count", interpolated("deduped", "tickets_count", QUARTILES))], "SELECT * FROM box"),
        "box_revenue_clean": _orders([*TO_CLEAN, *box_steps("clean", "revenue_rub", interpolated("clean", "revenue_rub", QUARTILES))], "SELECT * FROM box"),
        "overlap_after": _orders(TO_USERS, """
            SELECT count(*) FILTER (WHERE device = 'mobile') AS in_a, count(*) FILTER (WHERE device = 'desktop') AS in_b,
                   CAST(0 AS BIGINT) AS in_both FROM users"""),
        "box_tickets": _orders([*TO_CLEAN, *box_steps("clean", "tickets_count", interpolated("clean", "tickets_count", QUARTILES))], "SELECT * FROM box"),
        "orders_per_month": _orders(TO_CLEAN, "SELECT month, count(order_id) AS orders FROM clean GROUP BY month"),
        "pivot_event_season": _full([*TO_FULL, *event_mix], event_body),
        "pivot_device_season": _full([*TO_FULL, *device_mix], device_body),
        "pivot_age_season": _full([*TO_FULL, *age_mix], age_body),
        "ticket_price_change": _full(
            [*TO_FULL, ("means", f"SELECT event_type_main, {prices} FROM tickets WHERE event_type_main IS NOT NULL GROUP BY 1"),
             ("changes", "SELECT *, (autumn - summer) / nullif(summer, 0) * 100 AS change FROM means")],
            f"""SELECT event_type_main, {', '.join(f'round({n}, 4) AS {n}' for n in SEASONS)}, round(change, 4) AS change_pct,
                      CASE WHEN change IS NULL THEN 'missing' WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down'
                           ELSE 'zero' END AS change_class FROM changes"""),
        "daily_activity": _orders(TO_AUTUMN, f"""
            SELECT created_dt_msk, count(order_id) AS orders, count(DISTINCT user_id) AS unique_users,
                   {even(f"{exact_sum('one_ticket_revenue_rub')} / count(one_ticket_revenue_rub)", 2)} AS avg_one_ticket_revenue,
                   {even('CAST(count(order_id) AS DOUBLE) / count(DISTINCT user_id)', 2)} AS orders_per_user
            FROM autumn GROUP BY created_dt_msk"""),
        "orders_per_weekday": _weekday("count(order_id)", "orders"),
        "users_per_weekday": _weekday("count(DISTINCT user_id)", "users"),
        "region_summary": _full([*TO_FULL, REGIONS, REGION_SHARES], f"""
            SELECT region_name, orders, events, round(events_pct, 6) AS events_pct, round(orders_pct, 6) AS orders_pct,
                   {_heat('events_pct')}, {_heat('orders_pct')} FROM region_shares"""),
        "partner_summary": _full([*TO_FULL, PARTNERS, PARTNER_SHARES], f"""
            SELECT service_name, orders, events, round(total_revenue, 2) AS total_revenue,
                   round(events_pct, 6) AS events_pct, round(orders_pct, 6) AS orders_pct,
                   round(total_revenue_pct, 6) AS total_revenue_pct,
                   {_heat('events_pct')}, {_heat('orders_pct')}, {_heat('total_revenue_pct')} FROM partner_shares"""),
        "top5_share": _full([*TO_FULL, REGIONS, REGION_SHARES, PARTNERS, PARTNER_SHARES], """
            SELECT 'region_name' AS dimension, round(sum(events_pct), 6) AS events_pct, round(sum(orders_pct), 6) AS orders_pct
            FROM (SELECT * FROM region_shares ORDER BY events DESC, region_name LIMIT 5)
            UNION ALL
            SELECT 'service_name', round(sum(events_pct), 6), round(sum(orders_pct), 6)
            FROM (SELECT * FROM partner_shares ORDER BY events DESC, service_name LIMIT 5)"""),
        "group_overlap": _orders(TO_AUTUMN, """
            SELECT (SELECT count(DISTINCT user_id) FROM autumn WHERE device_type_canonical = 'mobile') AS in_a,
                   (SELECT count(DISTINCT user_id) FROM autumn WHERE device_type_canonical = 'desktop') AS in_b,
                   (SELECT count(*) FROM (SELECT user_id FROM autumn WHERE device_type_canonical = 'mobile'
                      INTERSECT SELECT user_id FROM autumn WHERE device_type_canonical = 'desktop')) AS in_both"""),
        "exclude_overlap": _orders(TO_USERS, """
            SELECT order_id, user_id, device_type_canonical FROM autumn WHERE user_id IN (SELECT user_id FROM users)"""),
        "null_count": _orders(TO_AUTUMN, """
            SELECT device_type_canonical, count(*) FILTER (WHERE days_since_prev IS NULL) AS missing
            FROM autumn GROUP BY device_type_canonical"""),
        "orders_per_user": _orders(TO_USERS, "SELECT user_id, device, orders FROM users"),
        "mean_gap_per_user": _orders(TO_USERS, """
            SELECT user_id, device, round(mean_gap, 6) AS mean_gap FROM users WHERE mean_gap IS NOT NULL"""),
        "hist_orders_per_user": _orders([*TO_USERS, *histogram_steps("users", "orders", 10, "device")], "SELECT * FROM hist"),
        "hist_gap": _orders([*TO_USERS, *histogram_steps("users", "mean_gap", 30, "device")], "SELECT * FROM hist"),
        "mw_orders_per_user": _tested("orders"),
        "mw_gap": _tested("mean_gap"),
        "kpi": _orders(TO_CLEAN, f"SELECT {FIGURES} FROM clean"),
        "kpi_filtered": _full(TO_FULL, f"""SELECT {FIGURES} FROM tickets
            WHERE created_dt_msk BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND currency_code = 'rub'
              AND region_name = 'NATION_7' AND event_type_main = 'ECONOMY'"""),
        "revenue_by_period": _orders(TO_CLEAN, f"""
            SELECT CAST(date_trunc('month', created_dt_msk) AS DATE) AS period, {FIGURES} FROM clean GROUP BY 1"""),
        "revenue_by_segment": _full(TO_FULL, _segments("event_type_main")),
        "revenue_by_device": _full(TO_FULL, _segments("device_type_canonical")),
        "revenue_by_region": _full(TO_FULL, _segments("region_name")),
        "top_cities": _full(TO_FULL, _top("city_name", 3)),
        "top_regions": _full(TO_FULL, _top("region_name", 5)),
        "top_events": _full(TO_FULL, _top("event_id", 10)),
        "active_users": _full(TO_FULL, " UNION ALL ".join(
            f"""SELECT '{grain}' AS grain, CAST({key} AS VARCHAR) AS key, count(DISTINCT user_id) AS users, true AS near
                FROM tickets WHERE {key} IS NOT NULL GROUP BY {key}"""
            for grain, key in {
                "weekday": "isodow(created_dt_msk)", "month": "strftime(created_dt_msk, '%Y-%m')",
                "device": "device_type_canonical", "region": "region_name",
            }.items()
        )),
    }
