"""Property listings: time on market, seasons, and towns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsieve.functions import labels
from factsieve.functions.calendar import month_text, whole_days, years_between
from factsieve.functions.categories import days_label, region_label
from factsieve.functions.rounding import half_up, ratio
from factsieve.operators.joins import keep_listed
from factsieve.operators.trimming import Limit, above_average, percentile_trim, trim_bounds

# Area must be known; the other three may be missing.
LIMITS = [
    Limit("total_area", high=0.99, keep_null=False),
    Limit("rooms", high=0.99),
    Limit("balcony", high=0.99),
    Limit("ceiling_height", low=0.01, high=0.99),
]


#: Year of the day a listing was opened, a column of advertisements that are stored by it.
LISTING_YEAR = "listing_year"


@dataclass(frozen=True)
class Market:
    """Tables of the listings database and the values that single out its parts.

    Tables are given as functions, so a query opens only the ones it reads. ``stored_bounds``, if
    given, opens the one row of ``bound_row`` as it was stored for the present flats; without it
    every analysis finds the bounds again.
    """

    flats: Callable[[], DataFrame]
    advertisement: Callable[[], DataFrame]
    city: Callable[[], DataFrame]
    settlement_type: Callable[[], DataFrame]
    main_city_id: object
    main_city: str
    target_type: object
    first_year: int
    last_year: int
    stored_bounds: Callable[[], DataFrame] | None = None


def bound_row(market: Market, sketches: DataFrame | None = None) -> DataFrame:
    """The bounds of all limited columns as one row, to be stored."""
    return trim_bounds(market.flats(), LIMITS, sketches)


def bounds(market: Market, sketches: DataFrame | None = None) -> DataFrame:
    found = bound_row(market, sketches)
    return found.select(
        F.col("total_area_high").alias("total_area_limit"),
        F.col("rooms_high").alias("rooms_limit"),
        F.col("balcony_high").alias("balcony_limit"),
        F.col("ceiling_height_high").alias("ceiling_height_limit_h"),
        F.col("ceiling_height_low").alias("ceiling_height_limit_l"),
    )


def usual_flats(market: Market) -> DataFrame:
    """Flats without outliers.

    ``id`` is the key of the table, so filtering its rows equals filtering by a list of the
    ids that pass, and one scan of flats serves in place of a scan and a semi-join.
    """
    return percentile_trim(market.flats(), LIMITS, market.stored_bounds() if market.stored_bounds else None)


def usual_ids(market: Market) -> DataFrame:
    return usual_flats(market).select("id")


def usual_advertisements(market: Market) -> DataFrame:
    """Advertisements of flats without outliers, by semi-join on the id list."""
    return keep_listed(market.advertisement(), usual_ids(market), "id")


def listed_with_flat(market: Market) -> DataFrame:
    """Advertisements left-joined to flats of one type; the filter makes the join inner."""
    joined = market.advertisement().join(market.flats(), "id", "left")
    return joined.filter(F.col("type_id") == market.target_type)


def closed_listings(market: Market) -> DataFrame:
    """Removed listings of the target type with region, time on market and price per area."""
    flats = usual_flats(market).filter(F.col("type_id") == market.target_type)
    removed = market.advertisement().filter(F.col("days_exposition").isNotNull())
    return flats.join(removed, "id").select(
        "*",
        region_label(F.col("city_id"), market.main_city_id).alias("region_cat"),
        days_label(F.col("days_exposition")).alias("category_days_exp"),
        ratio(F.col("last_price"), F.col("total_area")).alias("price_qm"),
    )


def _median(column: str) -> Column:
    """Discrete median of a count of rooms, balconies or floors.

    Its buffer is one entry per distinct value and merges map-side; for such counts that is
    a few dozen entries per group, whatever the number of rows.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})").cast("double").alias(f"med_{column}")


def segment_profile(market: Market) -> DataFrame:
    groups = closed_listings(market).groupBy("region_cat", "category_days_exp").agg(
        F.count("id").alias("count_adv"),
        half_up(F.avg("price_qm"), 2).alias("avg_price_qm"),
        half_up(F.avg("total_area"), 2).alias("avg_tot_area"),
        half_up(F.avg("ceiling_height"), 2).alias("avg_ceil_height"),
        _median("rooms"),
        _median("balcony"),
        _median("floor"),
        _median("floors_total"),
        half_up(ratio(F.count_if(F.col("is_apartment") == 1), F.count("id")), 3).alias("percent_apart"),
    )
    total = F.sum("count_adv").over(Window.partitionBy())  # at most ten rows: two regions, five ranges
    return (
        groups.withColumn("percent_adv", half_up(ratio(F.col("count_adv"), total), 2))
        .select(
            "region_cat", "category_days_exp", "count_adv", "percent_adv", "avg_price_qm", "avg_tot_area",
            "avg_ceil_height", "med_rooms", "med_balcony", "med_floor",
            F.col("med_floors_total").alias("med_floors_tot"), "percent_apart",
        )
        .orderBy(F.desc("region_cat"), "category_days_exp")
    )


def rooms_profile(
    market: Market, region: str = labels.REGION_MAIN, days: str = labels.DAYS_UP_TO_MONTH
) -> DataFrame:
    part = closed_listings(market).filter((F.col("region_cat") == region) & (F.col("category_days_exp") == days))
    return (
        part.groupBy("rooms")
        .agg(
            F.count("id").alias("count_adv"),
            half_up(F.avg("days_exposition"), 0).alias("avg_days_exp"),
            half_up(F.avg("price_qm"), 0).alias("avg_price_qm"),
            half_up(F.avg("total_area"), 2).alias("avg_tot_area"),
            half_up(F.avg("ceiling_height"), 2).alias("avg_ceil_height"),
            _median("balcony"),
            _median("floor"),
            _median("floors_total").alias("med_floors_tot"),
        )
        .orderBy(F.desc("count_adv"))
    )


def _season_listings(market: Market) -> DataFrame:
    """Listings of the target type opened in the covered years, with both dates."""
    flats = usual_flats(market).filter(F.col("type_id") == market.target_type).select("id", "total_area")
    opened = F.col("first_day_exposition")
    ads = market.advertisement().filter(years_between(opened, market.first_year, market.last_year))
    if LISTING_YEAR in ads.columns:  # stored by year: other years' files are not opened
        ads = ads.filter(F.col(LISTING_YEAR).between(market.first_year, market.last_year))
    return ads.join(flats, "id").select(
        "id",
        "total_area",
        ratio(F.col("last_price"), F.col("total_area")).alias("price_qm"),
        opened.cast("date").alias("opened"),
        F.date_add(opened.cast("date"), whole_days(F.col("days_exposition"))).alias("removed"),
    )


def season_rank(market: Market) -> DataFrame:
    """Listings opened and removed by month name, each ranked, the busiest first.

    Listings not removed yet form a month without a name. It matches nothing in the full
    join, and its missing count ranks first, as NULL does in a descending database sort.
    """
    listings = _season_listings(market)
    first = listings.groupBy(month_text(F.col("opened")).alias("month_adv")).agg(F.count("id").alias("first_date_adv"))
    last = listings.groupBy(month_text(F.col("removed")).alias("month_adv")).agg(F.count("id").alias("last_date_adv"))
    months = first.join(last, "month_adv", "full")

    def rank(column: str) -> Column:  # over twelve months and the unnamed one
        return F.dense_rank().over(Window.orderBy(F.col(column).desc_nulls_first()))

    return months.select(
        "month_adv",
        "first_date_adv",
        "last_date_adv",
        rank("first_date_adv").alias("rank_first"),
        rank("last_date_adv").alias("rank_last"),
    ).orderBy("rank_first")


def season_prices(market: Market) -> DataFrame:
    """Listings, price per area and area by month opened and by month removed."""
    listings = _season_listings(market)

    def by_month(day: str, suffix: str) -> DataFrame:
        return listings.groupBy(F.month(day).alias("month_adv")).agg(
            F.count("id").alias(f"{suffix}_date_adv"),
            half_up(F.avg("price_qm"), 2).alias(f"avg_price_qm_{suffix}"),
            half_up(F.avg("total_area"), 2).alias(f"avg_tot_area_{suffix}"),
        )

    both = by_month("opened", "first").join(by_month("removed", "last"), "month_adv", "full")
    return both.orderBy(F.col("month_adv").asc_nulls_last())


def town_listings(market: Market) -> DataFrame:
    """Listings without outliers outside the main city, with their town.

    The town must be known (its name is compared), so the join is inner.
    """
    towns = market.city().filter(F.col("city") != market.main_city)
    flats = usual_flats(market).join(towns, "city_id")
    price = ratio(F.col("last_price"), F.col("total_area"))
    return market.advertisement().join(flats, "id").withColumn("price_qm", price)


def typed_listings(market: Market) -> DataFrame:
    """The same with the settlement type; an unknown type forms a group of its own."""
    return town_listings(market).join(market.settlement_type(), "type_id", "left")


def cities_count(market: Market) -> DataFrame:
    return town_listings(market).groupBy("city").agg(F.count("id").alias("count_adv")).orderBy(F.desc("count_adv"))


def _closed_by_city(market: Market) -> DataFrame:
    return town_listings(market).groupBy("city").agg(
        F.count("id").alias("count_adv"),
        F.count_if(F.col("days_exposition").isNotNull()).alias("count_closed_adv"),
    )


def _closed_share() -> Column:
    return half_up(ratio(F.col("count_closed_adv"), F.col("count_adv")), 2).alias("perc_closed_adv")


def closed_share_by_city(market: Market) -> DataFrame:
    shares = _closed_by_city(market).select("city", "count_adv", _closed_share())
    return shares.orderBy(F.desc("perc_closed_adv"), F.desc("count_adv"))


def cities_above_avg(market: Market) -> DataFrame:
    """The same for towns with more listings than the mean town."""
    busy = above_average(_closed_by_city(market), "count_adv")
    shares = busy.select("city", "count_adv", "count_closed_adv", _closed_share())
    return shares.orderBy(F.desc("perc_closed_adv"), F.desc("count_adv"))


def _prices(listings: DataFrame, by: str) -> DataFrame:
    groups = listings.groupBy(by).agg(
        half_up(F.avg("price_qm"), 0).alias("price_qm"), half_up(F.avg("total_area"), 2).alias("avg_tot_area")
    )
    return groups.orderBy(F.col("price_qm").desc_nulls_first(), F.col("avg_tot_area").desc_nulls_first())


def price_by_city(market: Market) -> DataFrame:
    return _prices(town_listings(market), "city")


def price_by_type(market: Market) -> DataFrame:
    return _prices(typed_listings(market), "type")


def _days(listings: DataFrame, by: str) -> DataFrame:
    removed = listings.filter(F.col("days_exposition").isNotNull())
    groups = removed.groupBy(by).agg(half_up(F.avg("days_exposition"), 0).alias("avg_days_exp"))
    return groups.orderBy("avg_days_exp")


def days_by_city(market: Market) -> DataFrame:
    return _days(town_listings(market), "city")


def days_by_type(market: Market) -> DataFrame:
    return _days(typed_listings(market), "type")
