"""The input tables as SQL over the benchmark tables (FIXTURES.md, Part 2)."""

from __future__ import annotations

INPUTS = {
    "fx_flats": """
        SELECT l_orderkey AS id,
               CAST(q AS DOUBLE) AS total_area,
               CAST(CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE n END AS INT) AS rooms,
               CAST(CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE hi % 4 END AS INT) AS balcony,
               CASE WHEN l_orderkey % 5 = 0 THEN NULL
                    ELSE CAST(240 + d % 160 AS DOUBLE) / CAST(100 AS DOUBLE) END AS ceiling_height,
               CAST(lo AS INT) AS floor,
               CAST(hi + 5 AS INT) AS floors_total,
               CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS is_apartment,
               c_nationkey AS city_id,
               c_mktsegment AS type_id
        FROM (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n, min(l_linenumber) AS lo,
                     max(l_linenumber) AS hi, sum(CAST(round(l_discount * 100) AS INT)) AS d
              FROM lineitem GROUP BY l_orderkey) l
        JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey""",
    "fx_advertisement": """
        SELECT o_orderkey AS id,
               CAST(o_orderdate AS DATE) AS first_day_exposition,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL
                    ELSE CAST((o_orderkey * 37) % 500 AS DOUBLE) END AS days_exposition,
               o_totalprice AS last_price
        FROM orders""",
    "fx_city": "SELECT n_nationkey AS city_id, n_name AS city FROM nation",
    "fx_type": """
        SELECT c_mktsegment AS type_id, lower(c_mktsegment) AS type
        FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY') t""",
    "fx_ticket_orders": """
        SELECT o_orderkey AS order_id,
               o_custkey AS user_id,
               CAST(o_orderdate AS DATE) AS created_dt_msk,
               pk AS event_id,
               CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 12 WHEN 3 THEN 16 ELSE 18 END
                    AS INTEGER) AS age_limit,
               CASE WHEN o_orderkey % 20 = 0 THEN 'kzt' ELSE 'rub' END AS currency_code,
               CASE WHEN o_custkey % 5 = 0 THEN 'desktop' WHEN o_custkey % 5 IN (1, 2) THEN 'mobile'
                    WHEN o_orderkey % 3 = 0 THEN 'desktop' ELSE 'mobile' END AS device_type_canonical,
               CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice ELSE o_totalprice END AS revenue,
               CAST(CASE WHEN o_orderkey % 1000 = 7 THEN n * 100 ELSE n END AS INTEGER) AS tickets_count,
               concat('service-', CAST(sk % 36 AS VARCHAR)) AS service_name,
               CASE WHEN rn = 1 THEN NULL
                    ELSE CAST(datediff('day', prev, o_orderdate) AS DOUBLE) END AS days_since_prev
        FROM (SELECT o.*, row_number() OVER w AS rn, lag(o_orderdate) OVER w AS prev
              FROM orders o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) o
        JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk
              FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""",
    "fx_ticket_events": """
        SELECT p_partkey AS event_id, p_type AS event_type_main, p_name AS event_type_description,
               n_name AS region_name, r_name AS city_name
        FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey
        WHERE p_partkey % 50 <> 0""",
    "fx_rates": """
        SELECT d AS data, CAST(CASE WHEN day(d) = 31 THEN 1000 ELSE 100 END AS INTEGER) AS nominal,
               CAST(18 AS DOUBLE) + CAST(day(d) % 8 AS DOUBLE) / CAST(8 AS DOUBLE) AS curs, 'kzt' AS cdx
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) t""",
    "fx_ab_participants": """
        SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS "group",
               CASE WHEN user_id % 5 = 0 THEN 'other_test' ELSE 'interface_eu_test' END AS ab_test
        FROM (SELECT DISTINCT user_id FROM events) t""",
    "fx_ab_events": """
        SELECT user_id, ts AS event_dt,
               CASE WHEN event_type = 'signup' AND rn = 1 THEN 'registration'
                    WHEN event_type = 'signup' THEN 'login' ELSE event_type END AS event_name,
               CASE WHEN event_type = 'purchase' THEN value ELSE NULL END AS details
        FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
              FROM events e) e""",
    "fx_city_usage": """
        SELECT c_custkey + copy * 1000000000 AS row_no, c_custkey AS puid, c_mktsegment AS city,
               abs(c_acctbal) AS hours
        FROM (SELECT c_custkey, c_mktsegment, c_acctbal, 0 AS copy FROM customer
              UNION ALL
              SELECT c_custkey, 'AUTOMOBILE', c_acctbal + 1, 1 FROM customer WHERE c_custkey % 10 = 0) c""",
}


def query(tables: list[str], steps: list[tuple[str, str]], body: str) -> str:
    """One statement: the named inputs, then named steps, then the result."""
    parts = [(name, INPUTS[name]) for name in tables] + list(steps)
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in parts)
    return f"WITH {ctes}\n{body}" if ctes else body


def decimals(x: str, digits: int) -> str:
    """Round half up on a decimal value, as double."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def even(x: str, digits: int) -> str:
    """Scale, round to the nearest even integer, scale back."""
    scale = float(10**digits)
    return f"(round_even(({x}) * CAST({scale} AS DOUBLE), 0) / CAST({scale} AS DOUBLE))"


def interpolated(source: str, column: str, levels: dict[str, float], by: str | None = None) -> str:
    """Interpolated percentiles from row numbers, in the arithmetic of array libraries."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    known = f"AND {by} IS NOT NULL" if by else ""
    picks, blends = [], []
    for name, p in levels.items():
        place = f"(n - 1) * CAST({p} AS DOUBLE)"
        picks.append(f"max(CASE WHEN i = floor({place}) THEN v END) AS lo_{name}")
        picks.append(f"max(CASE WHEN i = ceil({place}) THEN v END) AS hi_{name}")
        share = f"({place} - floor({place}))"
        step = f"(hi_{name} - lo_{name})"
        blends.append(
            f"CASE WHEN {share} < CAST(0.5 AS DOUBLE) THEN lo_{name} + {step} * {share} "
            f"ELSE hi_{name} - {step} * (1 - {share}) END AS {name}"
        )
    group = f"GROUP BY {by}" if by else ""
    return f"""
        SELECT {key}{', '.join(blends)} FROM (
          SELECT {key}max(n) AS n, {', '.join(picks)} FROM (
            SELECT {key}CAST({column} AS DOUBLE) AS v,
                   row_number() OVER ({part}ORDER BY {column}) - 1 AS i, count(*) OVER ({part}) AS n
            FROM {source} WHERE {column} IS NOT NULL {known}) placed
          {group}) picked"""


def exact_sum(x: str) -> str:
    """Sum of amounts in decimals, as double."""
    return f"CAST(sum(CAST({x} AS DECIMAL(24,6))) AS DOUBLE)"
