"""Checks of the property queries."""

from __future__ import annotations

from oracles.inputs import decimals, query

FLATS, ADS, CITY, TYPE = "fx_flats", "fx_advertisement", "fx_city", "fx_type"

LIMITS = (
    "limits",
    """SELECT CAST(quantile_disc(total_area, 0.99) AS DOUBLE) AS total_area_limit,
              CAST(quantile_disc(rooms, 0.99) AS DOUBLE) AS rooms_limit,
              CAST(quantile_disc(balcony, 0.99) AS DOUBLE) AS balcony_limit,
              CAST(quantile_disc(ceiling_height, 0.99) AS DOUBLE) AS ceiling_height_limit_h,
              CAST(quantile_disc(ceiling_height, 0.01) AS DOUBLE) AS ceiling_height_limit_l
       FROM fx_flats""",
)
USUAL = (
    "usual",
    """SELECT f.id FROM fx_flats f, limits
       WHERE total_area < total_area_limit
         AND coalesce(rooms < rooms_limit, true)
         AND coalesce(balcony < balcony_limit, true)
         AND coalesce(ceiling_height < ceiling_height_limit_h AND ceiling_height > ceiling_height_limit_l, true)""",
)
REMOVED = (
    "removed",
    """SELECT f.*, a.days_exposition, a.last_price / f.total_area AS price_qm,
              CASE WHEN f.city_id = 0 THEN 'Санкт-Петербург' ELSE 'Лен область' END AS region_cat,
              CASE WHEN a.days_exposition <= 30 THEN 'Меньше месяца'
                   WHEN a.days_exposition BETWEEN 31 AND 90 THEN '1-3 месяца'
                   WHEN a.days_exposition BETWEEN 91 AND 180 THEN '3-6 месяцев'
                   WHEN a.days_exposition BETWEEN 181 AND 365 THEN '6-12 месяцев'
                   ELSE 'Больше года' END AS category_days_exp
       FROM fx_flats f LEFT JOIN fx_advertisement a ON a.id = f.id
       WHERE f.id IN (SELECT id FROM usual) AND a.days_exposition IS NOT NULL AND f.type_id = 'BUILDING'""",
)
SEASON = (
    "season",
    """SELECT a.id, f.total_area, a.last_price / f.total_area AS price_qm,
              a.first_day_exposition AS opened,
              a.first_day_exposition + CAST(round_even(a.days_exposition, 0) AS INT) AS closed
       FROM fx_advertisement a LEFT JOIN fx_flats f ON f.id = a.id
       WHERE a.id IN (SELECT id FROM usual) AND f.type_id = 'BUILDING'
         AND year(a.first_day_exposition) BETWEEN 1996 AND 1999""",
)
TOWNS = (
    "towns",
    """SELECT a.*, c.city, t.type, f.total_area, a.last_price / nullif(f.total_area, 0) AS price_qm
       FROM fx_advertisement a
       LEFT JOIN fx_flats f ON f.id = a.id
       LEFT JOIN fx_city c ON c.city_id = f.city_id
       LEFT JOIN fx_type t ON t.type_id = f.type_id
       WHERE a.id IN (SELECT id FROM usual) AND c.city <> 'NATION_0'""",
)
TRIM = [LIMITS, USUAL]


def _median(column: str, name: str) -> str:
    return f"CAST(quantile_disc({column}, 0.5) AS DOUBLE) AS {name}"


def _named_month(day: str) -> str:
    return f"rpad(lower(strftime({day}, '%B')), 9, ' ')"


def statements() -> dict[str, str]:
    towns = [ADS, FLATS, CITY, TYPE]
    closed_share = decimals("count_closed_adv * CAST(1 AS DOUBLE) / count_adv", 2)
    per_city = (
        "per_city",
        """SELECT city, count(id) AS count_adv, count(id) FILTER (WHERE days_exposition IS NOT NULL) AS count_closed_adv
           FROM towns GROUP BY city""",
    )

    def prices(by: str) -> str:
        return f"""SELECT {by}, {decimals('avg(price_qm)', 0)} AS price_qm, {decimals('avg(total_area)', 2)} AS avg_tot_area
                   FROM towns GROUP BY {by}"""

    def days(by: str) -> str:
        return f"""SELECT {by}, {decimals('avg(days_exposition)', 0)} AS avg_days_exp
                   FROM towns WHERE days_exposition IS NOT NULL GROUP BY {by}"""

    def rooms(region: str, days_label: str) -> str:
        return query(
            [FLATS, ADS], [*TRIM, REMOVED],
            f"""SELECT rooms, count(id) AS count_adv,
                       {decimals('avg(days_exposition)', 0)} AS avg_days_exp,
                       {decimals('avg(price_qm)', 0)} AS avg_price_qm,
                       {decimals('avg(total_area)', 2)} AS avg_tot_area,
                       {decimals('avg(ceiling_height)', 2)} AS avg_ceil_height,
                       {_median('balcony', 'med_balcony')}, {_median('floor', 'med_floor')},
                       {_median('floors_total', 'med_floors_tot')}
                FROM removed WHERE region_cat = '{region}' AND category_days_exp = '{days_label}'
                GROUP BY rooms""",
        )

    return {
        "trim_bounds": query([FLATS], [LIMITS], "SELECT * FROM limits"),
        "trim_ids": query([FLATS], TRIM, "SELECT id FROM usual"),
        "trim_semi_join": query(
            [FLATS, ADS], TRIM,
            "SELECT id, days_exposition, last_price FROM fx_advertisement WHERE id IN (SELECT id FROM usual)",
        ),
        "join_left_filtered": query(
            [FLATS, ADS], [],
            """SELECT a.id, last_price, total_area, type_id
               FROM fx_advertisement a LEFT JOIN fx_flats f ON f.id = a.id WHERE f.type_id = 'BUILDING'""",
        ),
        "bucket_days": query(
            [ADS], [],
            """SELECT id, days_exposition,
                      CASE WHEN days_exposition <= 30 THEN 'Меньше месяца'
                           WHEN days_exposition >= 31 AND days_exposition <= 90 THEN '1-3 месяца'
                           WHEN days_exposition >= 91 AND days_exposition <= 180 THEN '3-6 месяцев'
                           WHEN days_exposition >= 181 AND days_exposition <= 365 THEN '6-12 месяцев'
                           ELSE 'Больше года' END AS category_days_exp
               FROM fx_advertisement""",
        ),
        "filter_between": query(
            [ADS], [], "SELECT id, days_exposition FROM fx_advertisement WHERE days_exposition >= 31 AND days_exposition <= 90"
        ),
        "segment_profile": query(
            [FLATS, ADS], [*TRIM, REMOVED],
            f"""SELECT region_cat, category_days_exp, count(id) AS count_adv,
                       {decimals('count(id) * CAST(1 AS DOUBLE) / (SELECT count(id) FROM removed)', 2)} AS percent_adv,
                       {decimals('avg(price_qm)', 2)} AS avg_price_qm,
                       {decimals('avg(total_area)', 2)} AS avg_tot_area,
                       {decimals('avg(ceiling_height)', 2)} AS avg_ceil_height,
                       {_median('rooms', 'med_rooms')}, {_median('balcony', 'med_balcony')},
                       {_median('floor', 'med_floor')}, {_median('floors_total', 'med_floors_tot')},
                       {decimals('count(id) FILTER (WHERE is_apartment = 1) * CAST(1 AS DOUBLE) / count(id)', 3)} AS percent_apart
                FROM removed GROUP BY region_cat, category_days_exp""",
        ),
        "rooms_profile": rooms("Санкт-Петербург", "Меньше месяца"),
        "rooms_profile_slow": rooms("Лен область", "Больше года"),
        "season_rank": query(
            [FLATS, ADS],
            [
                *TRIM, SEASON,
                ("first_", f"SELECT {_named_month('opened')} AS m, count(id) AS n FROM season GROUP BY 1"),
                ("last_", f"SELECT {_named_month('closed')} AS m, count(id) AS n FROM season GROUP BY 1"),
            ],
            """SELECT coalesce(f.m, l.m) AS month_adv, f.n AS first_date_adv, l.n AS last_date_adv,
                      CAST(dense_rank() OVER (ORDER BY f.n DESC NULLS FIRST) AS INT) AS rank_first,
                      CAST(dense_rank() OVER (ORDER BY l.n DESC NULLS FIRST) AS INT) AS rank_last
               FROM first_ f FULL JOIN last_ l ON l.m = f.m""",
        ),
        "season_prices": query(
            [FLATS, ADS],
            [
                *TRIM, SEASON,
                *[
                    (f"{name}_", f"""SELECT CAST(month({day}) AS INT) AS m, count(id) AS n,
                        {decimals('avg(price_qm)', 2)} AS p, {decimals('avg(total_area)', 2)} AS s
                        FROM season GROUP BY 1""")
                    for name, day in (("first", "opened"), ("last", "closed"))
                ],
            ],
            """SELECT coalesce(f.m, l.m) AS month_adv, f.n AS first_date_adv, f.p AS avg_price_qm_first,
                      f.s AS avg_tot_area_first, l.n AS last_date_adv, l.p AS avg_price_qm_last,
                      l.s AS avg_tot_area_last
               FROM first_ f FULL JOIN last_ l ON l.m = f.m""",
        ),
        "cities_count": query(towns, [*TRIM, TOWNS], "SELECT city, count(id) AS count_adv FROM towns GROUP BY city"),
        "closed_share_by_city": query(
            towns, [*TRIM, TOWNS, per_city], f"SELECT city, count_adv, {closed_share} AS perc_closed_adv FROM per_city"
        ),
        "cities_above_avg": query(
            towns, [*TRIM, TOWNS, per_city],
            f"""SELECT city, count_adv, count_closed_adv, {closed_share} AS perc_closed_adv FROM per_city
                WHERE count_adv > (SELECT avg(count_adv) FROM per_city)""",
        ),
        "price_by_city": query(towns, [*TRIM, TOWNS], prices("city")),
        "price_by_type": query(towns, [*TRIM, TOWNS], prices("type")),
        "days_by_city": query(towns, [*TRIM, TOWNS], days("city")),
        "days_by_type": query(towns, [*TRIM, TOWNS], days("type")),
    }
