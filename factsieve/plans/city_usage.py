"""Hours of use in two cities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.operators.hypothesis import mann_whitney
from factsieve.operators.quality import dedup
from factsieve.operators.trimming import iqr_filter


def people(usage: DataFrame, order: str) -> DataFrame:
    """One row per person, the first in the given order."""
    return dedup(usage, ["puid"], order)


def two_cities(usage: DataFrame, order: str, a: str, b: str) -> DataFrame:
    return people(usage, order).filter(F.col("city").isin(a, b))


def city_test(usage: DataFrame, order: str, a: str, b: str, fenced: bool = False) -> DataFrame:
    """Are hours in a lower than in b? On all values, or on those inside quartile fences."""
    rows = two_cities(usage, order, a, b)
    if fenced:
        rows = iqr_filter(rows, "hours", ["city"])
    return mann_whitney(rows, "hours", "city", a, b, "less")
