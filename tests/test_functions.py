import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factsieve.functions import calendar, categories, labels, normal, rounding


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)


def applied(spark, values, expression, kind="double"):
    rows = column(spark, values, kind).select("i", expression.alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_cents_equals_scalar_rounding(spark):
    rng = random.Random(5)
    values = [rng.uniform(-1e6, 1e6) for _ in range(3000)]
    values += [n + 0.005 for n in range(-300, 300)] + [n / 1000 for n in range(-2000, 2000, 5)]
    values += [0.125, 0.375, 2.675, 1.005, 0.155, 0.285, -0.125, 0.0, 5e-324]
    assert applied(spark, values, rounding.cents(F.col("x"))) == [round(v, 2) for v in values]


def test_half_even_equals_array_rounding(spark):
    values = [0.125, 0.375, 0.145, 0.285, -2.5, 1.005, 33.335, 1e9 + 0.125]
    assert applied(spark, values, rounding.half_even(F.col("x"), 2)) == list(np.round(values, 2))


def test_half_up_rounds_decimal_ties_away_from_zero(spark):
    values = [0.125, 0.285, 2.5, -0.125, 1.005]
    assert applied(spark, values, rounding.half_up(F.col("x"), 2)) == [0.13, 0.29, 2.5, -0.13, 1.01]


def test_ratio_by_zero_is_null(spark):
    assert applied(spark, [0.0, 4.0], rounding.ratio(F.lit(2), F.col("x"))) == [None, 0.5]


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1] * 999 + [1e9, -1e9, 0.01]
    sums = {column(spark, v).agg(rounding.exact_sum(F.col("x"))).first()[0] for v in (values, values[::-1])}
    assert sums == {99.91}


@pytest.mark.parametrize("x", [-6.0, -2.3, -0.46, -1e-9, 0.0, 0.2, 0.46875, 0.5, 1.0, 3.99, 4.0, 4.01, 9.0, 25.0])
def test_erfc(spark, x):
    found = applied(spark, [x], normal.erfc(F.col("x")))[0]
    assert found == pytest.approx(math.erfc(x), rel=1e-13)


def test_far_tail_keeps_its_digits(spark):
    found = applied(spark, [8.98], normal.upper_tail(F.col("x")))[0]
    assert found == pytest.approx(0.5 * math.erfc(8.98 / math.sqrt(2)), rel=1e-12)


def test_day_ranges_have_gaps_that_fall_to_the_last_label(spark):
    values = [0.0, 30.0, 30.5, 31.0, 90.0, 91.0, 180.0, 181.0, 365.0, 366.0, None]
    assert applied(spark, values, categories.days_label(F.col("x"))) == [
        labels.DAYS_UP_TO_MONTH, labels.DAYS_UP_TO_MONTH, labels.DAYS_OVER_YEAR, labels.DAYS_1_3_MONTHS,
        labels.DAYS_1_3_MONTHS, labels.DAYS_3_6_MONTHS, labels.DAYS_3_6_MONTHS, labels.DAYS_6_12_MONTHS,
        labels.DAYS_6_12_MONTHS, labels.DAYS_OVER_YEAR, labels.DAYS_OVER_YEAR,
    ]


def test_season_weekday_and_month_text(spark):
    days = [dt.date(2024, m, 1) for m in range(1, 13)]
    assert applied(spark, days, calendar.season(F.month("x")), "date") == (
        [labels.WINTER] * 2 + [labels.SPRING] * 3 + [labels.SUMMER] * 3 + [labels.AUTUMN] * 3 + [labels.WINTER]
    )
    assert applied(spark, days, calendar.iso_weekday(F.col("x")), "date") == [d.isoweekday() for d in days]
    assert applied(spark, days[4:5], calendar.month_text(F.col("x")), "date") == ["may      "]


def test_whole_days_round_to_even(spark):
    assert applied(spark, [0.5, 1.5, 2.5, 2.7, -0.5, None], calendar.whole_days(F.col("x"))) == [0, 2, 2, 3, 0, None]


def test_lifetime_is_floored(spark):
    start = dt.datetime(2024, 3, 30, 12)
    moments = [start + dt.timedelta(**d) for d in (
        {"days": 7, "hours": 23}, {"days": 8}, {"microseconds": -1}, {"days": -1}, {"days": -1, "seconds": -1}, {},
    )]
    found = applied(spark, moments, calendar.lifetime_days(F.lit(start).cast("timestamp_ntz"), F.col("x")), "timestamp_ntz")
    assert found == [(m - start).days for m in moments] == [7, 8, -1, -1, -2, 0]


def test_years_between_is_a_range(spark):
    days = [dt.date(1995, 12, 31), dt.date(1996, 1, 1), dt.date(1999, 12, 31), dt.date(2000, 1, 1)]
    assert applied(spark, days, calendar.years_between(F.col("x"), 1996, 1999), "date") == [False, True, True, False]


def test_conversion_only_at_the_rate_of_the_currency(spark):
    rows = spark.createDataFrame(
        [(100.0, "kzt", "kzt", 100, 18.125), (100.0, "rub", "kzt", 100, 18.125), (100.0, "kzt", None, None, None)],
        "amount double, cc string, cdx string, nominal int, curs double",
    )
    c = F.col
    out = rows.select(categories.in_home_currency(c("amount"), c("cc"), c("cdx"), c("nominal"), c("curs"))).collect()
    assert [r[0] for r in out] == [round(100.0 / 100 * 18.125, 2), 100.0, 100.0]


def test_change_class(spark):
    assert applied(spark, [1.0, -1.0, 0.0, None], categories.change_class(F.col("x"))) == ["up", "down", "zero", "missing"]
