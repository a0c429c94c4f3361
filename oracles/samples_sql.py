"""Checks of the city-usage and conversion queries and of the plain scans."""

from __future__ import annotations

from oracles.inputs import even, interpolated, query
from oracles.tests_sql import RANK_RESULT, SHARE_RESULT, histogram_steps, rank_steps, share_steps

USAGE, PARTICIPANTS, EVENTS = "fx_city_usage", "fx_ab_participants", "fx_ab_events"

PEOPLE = ("people", "SELECT * FROM fx_city_usage QUALIFY row_number() OVER (PARTITION BY puid ORDER BY row_no) = 1")
CITIES = ("cities", "SELECT * FROM people WHERE city IN ('BUILDING', 'FURNITURE')")
FENCED = [
    ("q", interpolated("cities", "hours", {"q1": 0.25, "q3": 0.75}, "city")),
    (
        "fenced",
        """SELECT c.* FROM cities c JOIN q ON q.city = c.city
           WHERE hours BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    ),
]

MEMBERS = ("members", "SELECT * FROM fx_ab_participants WHERE ab_test = 'interface_eu_test'")
MERGED = (
    "merged",
    """SELECT m.user_id, m."group", e.event_name, e.event_dt FROM members m
       LEFT JOIN (SELECT * FROM fx_ab_events WHERE event_name IN ('registration', 'purchase')) e
         ON e.user_id = m.user_id""",
)
LIVED = (
    "lived",
    """SELECT m.*, r.registration_dt,
              CAST(floor((epoch_us(m.event_dt) - epoch_us(r.registration_dt)) / CAST(86400000000 AS DOUBLE)) AS INT) AS lifetime_days
       FROM merged m LEFT JOIN (SELECT user_id, event_dt AS registration_dt FROM merged
                                WHERE event_name = 'registration') r ON r.user_id = m.user_id""",
)
EARLY = ("early", "SELECT * FROM lived WHERE lifetime_days <= 7")
BOUGHT = ("bought", "SELECT * FROM early WHERE event_name = 'purchase'")
TO_BOUGHT = [MEMBERS, MERGED, LIVED, EARLY, BOUGHT]
CONVERSION = (
    "conversion",
    """SELECT t."group", total_users, buyers FROM
         (SELECT "group", count(DISTINCT user_id) AS total_users FROM merged GROUP BY 1) t
         FULL JOIN (SELECT "group", count(DISTINCT user_id) AS buyers FROM bought GROUP BY 1) b ON b."group" = t."group" """,
)


FROM_START = ("from_start", "SELECT * FROM bought WHERE lifetime_days >= 0")


def _counts(n: str, m: str) -> tuple[str, str]:
    def one(side: str, relation: str, what: str) -> str:
        return f"""(SELECT {what} FROM {relation} WHERE "group" = '{side}')"""

    return (
        "counts",
        f"""SELECT {one('A', n, 'count(*)')} AS n_a, {one('A', m, 'count(*)')} AS m_a,
                   {one('B', n, 'count(*)')} AS n_b, {one('B', m, 'count(*)')} AS m_b""",
    )


def statements() -> dict[str, str]:
    tables = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    test = [PARTICIPANTS, EVENTS]
    every_signup = (
        "goals",
        """SELECT e.user_id, "group", CASE event_type WHEN 'signup' THEN 'registration' ELSE event_type END AS event_name, ts
           FROM events e JOIN members m ON m.user_id = e.user_id WHERE event_type IN ('signup', 'purchase')""",
    )
    return {
        "scan_tables": "\nUNION ALL\n".join(f"""SELECT '{t}' AS "table", count(*) AS rows FROM {t}""" for t in tables),
        "scan_csv": query([USAGE], [], "SELECT * FROM fx_city_usage"),
        "quantiles": query([], [("q", interpolated(
            "lineitem", "l_extendedprice", {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}, "l_returnflag"))],
            """SELECT l_returnflag, round(q01, 6) AS q01, round(q25, 6) AS q25, round(q50, 6) AS q50,
                      round(q75, 6) AS q75, round(q99, 6) AS q99 FROM q"""),
        "distinct_values": query([EVENTS], [], "SELECT DISTINCT event_name FROM fx_ab_events"),
        "filter_isin": query([EVENTS], [], """SELECT user_id, event_dt, event_name FROM fx_ab_events
            WHERE event_name = 'registration' OR event_name = 'purchase'"""),
        "dup_key_count": query([USAGE], [], "SELECT count(*) - count(DISTINCT puid) AS duplicates FROM fx_city_usage"),
        "dup_row_count": query([EVENTS], [], """SELECT (SELECT count(*) FROM fx_ab_events)
            - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_ab_events)) AS duplicates"""),
        "dedup_key": query([USAGE], [PEOPLE], "SELECT * FROM people"),
        "city_overlap": query([USAGE], [], """
            SELECT (SELECT count(DISTINCT puid) FROM fx_city_usage WHERE city = 'AUTOMOBILE') AS in_a,
                   (SELECT count(DISTINCT puid) FROM fx_city_usage WHERE city = 'BUILDING') AS in_b,
                   (SELECT count(*) FROM (SELECT puid FROM fx_city_usage WHERE city = 'AUTOMOBILE'
                      INTERSECT SELECT puid FROM fx_city_usage WHERE city = 'BUILDING')) AS in_both"""),
        "describe_by_group": query(
            [USAGE], [PEOPLE, CITIES, ("q", interpolated("cities", "hours", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "city"))],
            """SELECT c.city, count(hours) AS count, round(avg(hours), 4) AS mean, round(stddev_samp(hours), 4) AS std,
                      min(hours) AS min, round(any_value(q25), 4) AS q25, round(any_value(q50), 4) AS q50,
                      round(any_value(q75), 4) AS q75, max(hours) AS max
               FROM cities c JOIN q ON q.city = c.city GROUP BY c.city"""),
        "hist_city_hours": query([USAGE], [PEOPLE, CITIES, *histogram_steps("cities", "hours", 20, "city")], "SELECT * FROM hist"),
        "hist_city_hours_fenced": query([USAGE], [PEOPLE, CITIES, *FENCED, *histogram_steps("fenced", "hours", 20, "city")], "SELECT * FROM hist"),
        "hist_value": query([], histogram_steps("events", "value", 20), "SELECT * FROM hist"),
        "mw_value": query([], rank_steps("events", "value", "event_type", "purchase", "click", "two-sided"), RANK_RESULT),
        "mw_city_hours": query([USAGE], [PEOPLE, CITIES, *rank_steps("cities", "hours", "city", "BUILDING", "FURNITURE", "less")], RANK_RESULT),
        "mw_city_hours_fenced": query([USAGE], [PEOPLE, CITIES, *FENCED, *rank_steps("fenced", "hours", "city", "BUILDING", "FURNITURE", "less")], RANK_RESULT),
        "ab_merge": query(test, [MEMBERS, MERGED], "SELECT * FROM merged"),
        "ab_lifetime": query(test, [MEMBERS, MERGED, LIVED], "SELECT * FROM lived WHERE event_name IS NOT NULL"),
        "ab_lifetime_fanout": query([PARTICIPANTS], [MEMBERS, every_signup], """
            SELECT p."group", p.event_name, q.rows, p.joined_rows FROM
              (SELECT g."group", g.event_name, count(*) AS joined_rows FROM goals g
               LEFT JOIN (SELECT user_id, ts FROM goals WHERE event_name = 'registration') r ON r.user_id = g.user_id
               GROUP BY 1, 2) p
              JOIN (SELECT "group", event_name, count(*) AS rows FROM goals GROUP BY 1, 2) q
                ON q."group" = p."group" AND q.event_name = p.event_name"""),
        "ab_overlap": query(test, [MEMBERS], """
            SELECT (SELECT count(DISTINCT user_id) FROM members WHERE "group" = 'A') AS in_a,
                   (SELECT count(DISTINCT user_id) FROM members WHERE "group" = 'B') AS in_b,
                   (SELECT count(*) FROM (SELECT user_id FROM members WHERE "group" = 'A'
                      INTERSECT SELECT user_id FROM members WHERE "group" = 'B')) AS in_both"""),
        "users_by_group": query(test, [MEMBERS, MERGED], """SELECT "group", count(DISTINCT user_id) AS users FROM merged GROUP BY 1"""),
        "sample_size_check": query(test, [MEMBERS, MERGED], """
            SELECT "group", count(DISTINCT user_id) AS users, CAST(3759 AS BIGINT) AS required,
                   count(DISTINCT user_id) >= 3759 AS enough FROM merged GROUP BY 1"""),
        "ab_conversion": query(test, [*TO_BOUGHT, CONVERSION], f"""
            SELECT "group", total_users, buyers, {even('CAST(buyers AS DOUBLE) / total_users * 100', 2)} AS conversion FROM conversion"""),
        "ab_conversion_from_start": query(test, [*TO_BOUGHT, FROM_START], f"""
            SELECT m."group", count(DISTINCT m.user_id) AS total_users,
                   nullif(count(DISTINCT b.user_id), 0) AS buyers,
                   {even('CAST(nullif(count(DISTINCT b.user_id), 0) AS DOUBLE) / count(DISTINCT m.user_id) * 100', 2)} AS conversion
            FROM members m LEFT JOIN from_start b ON b.user_id = m.user_id GROUP BY 1"""),
        "hist_lifetime": query(test, [*TO_BOUGHT, *histogram_steps("bought", "lifetime_days", 20)], "SELECT * FROM hist"),
        "ztest_rows": query(test, [*TO_BOUGHT, _counts("early", "bought"), *share_steps("counts")], SHARE_RESULT),
        "ztest_rows_fanout": query([PARTICIPANTS], [MEMBERS, every_signup, (
            "early", """SELECT g."group", g.event_name FROM goals g
                        JOIN goals r ON r.user_id = g.user_id AND r.event_name = 'registration'
                        WHERE g.ts - r.ts < INTERVAL 8 DAYS"""),
            ("bought", "SELECT * FROM early WHERE event_name = 'purchase'"),
            _counts("early", "bought"), *share_steps("counts")], SHARE_RESULT),
        "ztest_users": query(
            test,
            [*TO_BOUGHT, ("buyers", """SELECT DISTINCT user_id, "group" FROM bought"""), _counts("members", "buyers"), *share_steps("counts")],
            SHARE_RESULT),
    }
