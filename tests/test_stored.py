"""Results stored once per version of their inputs: bounds, cleaned orders and what reads them."""

import re
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from factsieve import registry
from factsieve.operators.trimming import Limit, percentile_trim, trim_bounds
from factsieve.plans import property, tickets
from factsieve.sources import standins
from factsieve.sources.stored import is_complete, stored, table_version

FOLDER = "/root/testdata/sf0.001"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_a_result_is_made_once_for_each_version(spark, tmp_path):
    table = f"{tmp_path}/t.parquet"
    spark.range(5).write.parquet(table)
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(table).selectExpr("max(id) AS top")

    def ask():
        return stored(spark, "top", table_version(spark, table), make, folder=f"{tmp_path}/kept").first().top

    assert [ask(), ask()] == [4, 4] and len(made) == 1
    spark.range(9).write.mode("append").parquet(table)
    assert ask() == 8 and len(made) == 2


def test_a_broken_write_is_not_read(spark, tmp_path):
    with pytest.raises(Exception, match="broken"):
        stored(spark, "x", "1", lambda: spark.range(3).selectExpr("raise_error('broken') AS a"), folder=str(tmp_path))
    assert not is_complete(spark, f"{tmp_path}/x-1")
    assert stored(spark, "x", "1", lambda: spark.range(3), folder=str(tmp_path)).count() == 3


def test_given_bounds_trim_like_computed_ones(spark):
    rows = [(i, float(i % 50), None if i % 7 == 0 else i % 9) for i in range(1000)] + [(2000, None, None)]
    df = spark.createDataFrame(rows, "id long, area double, rooms int")
    limits = [Limit("area", low=0.01, high=0.99, keep_null=False), Limit("rooms", high=0.9)]
    known = trim_bounds(df, limits)
    assert rows_of(percentile_trim(df, limits, known)) == rows_of(percentile_trim(df, limits))
    assert percentile_trim(df, limits, known).columns == df.columns


@pytest.mark.parametrize("analysis", ["segment_profile", "season_prices", "closed_share_by_city", "days_by_type"])
def test_stored_bounds_spare_the_passes_that_find_them(spark, analysis):
    plain, given = registry.plain_market(spark, FOLDER), registry.market(spark, FOLDER)
    run = getattr(property, analysis)
    found, computed = run(given), run(plain)
    assert "percentile_approx" in optimized(computed) and "percentile_approx" not in optimized(found)
    assert "raise_error" not in optimized(found)
    lines = r"Relation \[[^\]]*l_orderkey"
    assert len(re.findall(lines, optimized(found))) <= len(re.findall(lines, optimized(run(replace(plain, stored_bounds=given.stored_bounds)))))
    assert len(re.findall(lines, optimized(found))) < len(re.findall(lines, optimized(computed)))
    assert rows_of(found) == rows_of(computed)


def test_cleaned_orders_are_read_by_season(spark):
    plain, given = registry.plain_sales(spark, FOLDER), registry.sales(spark, FOLDER)
    kept = tickets.clean_orders(given)
    assert rows_of(kept.select(*sorted(kept.columns))) == rows_of(tickets.clean_orders(plain).select(*sorted(kept.columns)))
    plan = tickets.daily_activity(given)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*season", plan)
    assert "o_orderkey" not in plan  # the orders themselves are not read again


def test_stored_orders_are_shuffled_whole_once(spark):
    """Dealt by day where duplicates are dropped; the caps are found from what is stored."""
    plain = registry.plain_sales(spark, FOLDER)
    plan = tickets.order_layout(plain)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(created_dt_msk") == 1
    assert len(re.findall(r"Exchange [^\n]*device_type_canonical", plan)) == 0  # none by all columns
    assert "percentile_approx" not in plan
    assert rows_of(tickets.order_layout(plain).select("order_id")) == rows_of(tickets.deduplicated(plain).select("order_id"))


def test_gaps_of_orders_with_repeated_and_missing_keys(spark, tmp_path):
    rows = [
        (1, 1, "2024-01-05", 10.0), (2, 1, "2024-01-09", 11.0), (3, 1, "2024-01-09", 12.0), (1, 2, "2024-02-01", 13.0),
        (1, 2, "2024-02-01", 13.0), (4, 2, "2024-02-03", 14.0), (1, 1, "2024-03-01", 15.0), (5, None, "2024-01-01", 16.0),
        (6, 1, None, 17.0), (None, 1, "2024-01-02", 18.0), (7, 2, "2024-02-03", 19.0), (8, 3, "2024-01-01", 20.0),
    ]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(1, 8).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = standins.ticket_orders(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(o_custkey#\d+L?, o_orderdate", plan)) == 1  # the days only
    got = sorted((r.revenue, r.days_since_prev is None, r.days_since_prev) for r in found.collect())
    # an order without a key is a day of its user; the first order of a day looks back, the others do not
    assert got == [
        (10.0, False, 3.0), (11.0, False, 4.0), (12.0, False, 0.0), (13.0, True, None), (13.0, True, None),
        (14.0, False, 2.0), (15.0, False, 52.0), (19.0, False, 0.0),
    ]


def test_rates_go_to_the_orders(spark):
    """The orders are not dealt by day, of which one may hold a large part of them."""
    plain = registry.plain_sales(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tickets.priced(plain)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"BroadcastHashJoin \[created_dt_msk", plan)
    assert "hashpartitioning(created_dt_msk" not in plan
