"""Every registered query against its DuckDB statement, and the shape of the plans."""

import re

import duckdb
import pytest

import __spark_entry__ as driver
from factsieve import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES = registry.queries()
CHECKS = driver.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(CHECKS) and set(QUERIES) <= set(driver.queries())


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in places) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, "" if v is None else v) for v in row))


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_duckdb(spark, database, key):
    frame = QUERIES[key](spark, FOLDER)
    found = ordered([tuple(r) for r in frame.collect()], frame.columns)
    answer = database.execute(CHECKS[key])
    columns = [d[0] for d in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    assert found == ordered(answer.fetchall(), columns)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def plan_of(spark, key):
    return QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["segment_profile", "tickets_clean", "partner_summary", "mw_gap", "ztest_users"])
def test_no_python_and_no_cartesian_product(spark, key):
    plan = plan_of(spark, key)
    assert not re.search(r"Python|InPandas|CartesianProduct", plan)


def test_scans_read_only_the_columns_in_use(spark):
    plan = QUERIES["trim_bounds"](spark, FOLDER)._jdf.queryExecution().toString()
    schema = re.search(r"ReadSchema: struct<l_orderkey:bigint,[^>]*>", plan).group()
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema


def test_year_range_reaches_the_scan(spark):
    frame = spark.read.parquet(f"{FOLDER}/orders.parquet")
    from factsieve.functions.calendar import years_between
    from pyspark.sql import functions as F

    plan = frame.filter(years_between(F.col("o_orderdate"), 1996, 1999))._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual", plan)


def test_bounds_and_rows_share_one_shuffle(spark):
    from factsieve.plans import tickets

    frame = tickets.kpi(tickets.clean_orders(registry.plain_sales(spark, FOLDER)))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReusedExchange \[user_id", plan)


@pytest.mark.parametrize("key", ["mw_orders_per_user", "group_overlap", "dedup_key", "exclude_overlap"])
def test_plans_aggregate_by_hash(spark, key):
    assert "SortAggregate" not in plan_of(spark, key)


def test_events_are_joined_after_grouping(spark):
    for key in ("pivot_event_season", "ticket_price_change", "region_summary"):
        plan = QUERIES[key](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Join LeftOuter, \(event_id|Join Inner, \(event_id|Join .*event_id", plan), key
        at = re.search(r"Join (LeftOuter|Inner), \(event_id", plan).start()
        assert "Aggregate [event_id" in plan[at:], key


def test_shares_need_no_window_in_one_task(spark):
    plan = QUERIES["revenue_by_segment"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan[: plan.index("Aggregate")]


def test_large_rates_and_orders_lose_no_row(spark):
    from factsieve.plans import tickets

    sales = registry.sales(spark, FOLDER)
    rows = tickets.deduplicated(sales)
    assert rows.filter("tickets_count > 127").count() > 0
    assert rows.filter("nominal > 127 AND currency_code = cdx").count() > 0
    assert rows.filter("revenue_rub IS NULL OR tickets_count IS NULL").count() == 0


def test_board_filter_reaches_the_scan_of_the_orders(spark):
    plan = QUERIES["kpi_filtered"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[(o_orderkey[^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
    assert any("o_totalprice" in columns and "o_orderdate" in pushed and "GreaterThanOrEqual" in pushed for columns, pushed in scans), scans
