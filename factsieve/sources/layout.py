"""Listings stored for joins: both tables in buckets by id, advertisements by year as well.

Tables bucketed alike are joined on the bucket key without a shuffle, and a span of years opens only
those years' files. The tables are external ones in the session's catalog; their files lie in the
shared folder.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.plans.property import LISTING_YEAR, Market
from factsieve.session import scratch_path


def bucketed(
    spark: SparkSession, frame: DataFrame, table: str, key: str, buckets: int, partition_by: list[str] | None = None
) -> None:
    """Write a table in buckets by a key, one file per bucket (and partition), each in order of the key.

    Rows are dealt by the same hash that the buckets use, so every task writes one bucket.
    """
    dealt = frame.repartition(buckets, key)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).partitionBy(*(partition_by or []))
    writer.option("path", scratch_path(spark, table)).mode("overwrite").saveAsTable(table)


def bucketed_market(spark: SparkSession, market: Market, name: str, buckets: int = 16) -> Market:
    """The market over bucketed copies of its flats and advertisements, written if the catalog lacks them.

    ``name`` tells the copies of different tables and versions apart. With more buckets than
    cores in the cluster every core reads buckets of its own.
    """
    safe = re.sub(r"\W", "_", name)
    flats, ads = f"flats_{safe}", f"advertisement_{safe}"
    if not spark.catalog.tableExists(flats):
        bucketed(spark, market.flats(), flats, "id", buckets)
    if not spark.catalog.tableExists(ads):
        dated = market.advertisement().withColumn(LISTING_YEAR, F.year("first_day_exposition"))
        bucketed(spark, dated, ads, "id", buckets, [LISTING_YEAR])
    return replace(market, flats=lambda: spark.table(flats), advertisement=lambda: spark.table(ads))
