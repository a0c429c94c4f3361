"""Stored daily figures, user sketches, value sketches and bucketed tables: same results, fewer reads."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from factsieve import registry
from factsieve.operators import order_statistics
from factsieve.operators.order_statistics import column_quantiles, part_sketches, quantiles
from factsieve.plans import board, property, tickets

FOLDER = "/root/testdata/sf0.001"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def plain(values, p, kind):
    values = sorted(v for v in values if v is not None)
    if kind == "discrete":
        return values[max(0, -(-int(round(p * 1e9)) * len(values) // 10**9) - 1)]
    place = (len(values) - 1) * p
    low, share = values[int(place)], place - int(place)
    return low + (values[min(int(place) + 1, len(values) - 1)] - low) * share


SPREADS = {
    "even": "CAST(id AS DOUBLE)",
    "log": "exp(id % 700 / 10D)",
    "hot": "CASE WHEN id % 3 = 0 THEN 5D ELSE id / 7D END",
    "tiny and one outlier": "CASE WHEN id = 17 THEN 1e12 ELSE id * 1e-9 END",
    "gaps": "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN double('nan') ELSE id % 100 * 1D END",
}


@pytest.mark.parametrize("spread", SPREADS)
@pytest.mark.parametrize("kind", ["discrete", "interpolated"])
def test_percentiles_from_stored_sketches_are_exact(spark, spread, kind, monkeypatch):
    """Sketches far smaller than the data, so that their error matters."""
    monkeypatch.setattr(order_statistics, "STORED_SIZE", 400)
    monkeypatch.setattr(order_statistics, "STORED_MARGIN", 4 * 2.296 / 400**0.9021)
    df = spark.range(20_000).selectExpr("id % 7 AS part", f"{SPREADS[spread]} AS x")
    levels = {"low": 0.01, "mid": 0.5, "high": 0.99}
    kept = part_sketches(df, ["x"], ["part"])
    found = column_quantiles(df, {n: ("x", p) for n, p in levels.items()}, kind, kept).first().asDict()
    values = [r.x for r in df.filter("NOT isnan(x)").collect()]
    for name, p in levels.items():
        assert found[name] == pytest.approx(plain(values, p, kind), rel=1e-12), name


def test_sketches_by_group_merge_over_parts_and_loads(spark, tmp_path):
    """A second load appends its own sketches; percentiles by group then read the values once."""
    first = spark.range(5000).selectExpr("id % 3 AS g", "1 AS load", "CAST(id * 37 % 1009 AS DOUBLE) AS x")
    second = spark.range(3000).selectExpr("id % 4 AS g", "2 AS load", "CAST(id * 11 % 701 AS DOUBLE) AS x")
    for load in (first, second):
        part_sketches(load, ["x"], ["g", "load"]).write.mode("append").parquet(f"{tmp_path}/sketches")
        load.write.mode("append").parquet(f"{tmp_path}/values")
    kept, rows = spark.read.parquet(f"{tmp_path}/sketches"), spark.read.parquet(f"{tmp_path}/values")
    levels = {"q1": 0.25, "q9": 0.9}
    found = quantiles(rows, "x", levels, ["g"], sketches=kept)
    assert sorted(map(str, found.collect())) == sorted(map(str, quantiles(rows, "x", levels, ["g"]).collect()))
    plan = optimized(found)
    assert plan.count("Relation [g") == 2 and "percentile_approx" not in plan  # the values once, the sketches once
    assert len(re.findall(r"Relation \[[^\]]*x#\d+[^\]]*\]", optimized(quantiles(rows, "x", levels, ["g"])))) == 2


def test_sketches_of_nothing(spark):
    df = spark.range(0).selectExpr("id AS part", "CAST(id AS DOUBLE) AS x")
    assert column_quantiles(df, {"m": ("x", 0.5)}, "discrete", part_sketches(df, ["x"], ["part"])).first().m is None
    empty = spark.range(3).selectExpr("id AS part", "CAST(NULL AS DOUBLE) AS x")
    assert column_quantiles(empty, {"m": ("x", 0.5)}, "discrete", part_sketches(empty, ["x"], ["part"])).first().m is None


@pytest.mark.parametrize("key", ["trim_bounds_from_sketches", "cap_q99_from_sketches"])
def test_bounds_from_sketches_need_no_sketch_pass(spark, key):
    plan = optimized(registry.queries()[key](spark, FOLDER))
    assert "percentile_approx" not in plan and "kll_merge_agg_double" in plan
    other = optimized(registry.queries()[key.removesuffix("_from_sketches")](spark, FOLDER))
    assert plan.count("l_quantity") < other.count("l_quantity") or plan.count("o_totalprice") < other.count("o_totalprice")


def test_board_queries_read_no_orders(spark):
    for key, query in registry.queries().items():
        if key.endswith("_from_board"):
            assert "o_orderkey" not in optimized(query(spark, FOLDER)), key


def test_daily_figures_read_the_orders_once_and_group_before_the_events(spark):
    given = registry.sales(spark, FOLDER)
    plan = optimized(board.daily(given))
    assert len(re.findall(r"Relation \[[^\]]*revenue_rub", plan)) == 1
    at = re.search(r"Join \w+, \(event_id", plan).start()
    assert "Aggregate [created_dt_msk" in plan[at:]


def test_figures_of_no_rows(spark):
    rows = registry.daily_board(spark, FOLDER).filter("false")
    assert tickets.kpi(rows).first().asDict() == tickets.kpi(tickets.clean_orders(registry.sales(spark, FOLDER)).filter("false")).first().asDict()


def test_merged_user_sketches_stay_within_their_error(spark):
    """Sets of 200 to 60,000 users, half of them in several days."""
    orders = spark.range(120_000).selectExpr(
        "(id * 7919) % 60000 AS user_id",
        "date_add(DATE '2024-01-01', CAST(id % 120 AS INT)) AS created_dt_msk",
        "CASE WHEN id % 5 = 0 THEN 'desktop' ELSE 'mobile' END AS device_type_canonical",
        "concat('r', id % 300) AS region_name",
    )
    kept = orders.groupBy(*board.USER_KEYS).agg(F.hll_sketch_agg("user_id", board.REGISTERS).alias("users"))
    for grain in ("day", "weekday", "month", "device", "region"):
        near = {r[grain]: r.users for r in board.users_by(kept, grain).collect()}
        exact = {r[grain]: r.users for r in board.exact_users_by(orders, grain).collect()}
        assert near.keys() == exact.keys()
        wrong = [k for k, n in exact.items() if abs(near[k] - n) > board.ERROR * n]
        assert len(wrong) <= 0.01 * len(exact), (grain, wrong)


def test_bucketed_listings_join_without_a_shuffle(spark):
    given = registry.bucketed_market(spark, FOLDER)
    assert registry.bucketed_market(spark, FOLDER).flats().count() == given.flats().count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(property.season_prices(replace(given, stored_bounds=registry.market(spark, FOLDER).stored_bounds)))
        joins = [m.start() for m in re.finditer(r"SortMergeJoin \[id#", plan)]
        assert joins
        below = plan[joins[-1] :]
        assert "Exchange hashpartitioning(id#" not in plan
        assert re.search(r"SelectedBucketsCount: 16 out of 16", below)
        assert re.search(r"PartitionFilters: \[[^\]]*listing_year#\d+ >= 1996\)[^\]]*listing_year#\d+ <= 1999", plan)
        other = physical(property.season_prices(registry.market(spark, FOLDER)))
        assert "Exchange hashpartitioning(id#" in other or "Exchange hashpartitioning(o_orderkey#" in other
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rates(spark, rows):
    return spark.createDataFrame(rows, "data date, nominal int, curs double, cdx string")


def test_a_second_rate_on_one_day_is_an_error(spark):
    import datetime as dt

    day, other = dt.date(2024, 9, 1), dt.date(2024, 9, 2)
    orders = spark.createDataFrame([(1, day), (2, other), (3, dt.date(2024, 9, 3))], "order_id long, created_dt_msk date")
    sales = lambda rows: tickets.Sales(orders=lambda: orders, events=lambda: orders, rates=lambda: rates(spark, rows))
    one_each = [(day, 100, 18.5, "kzt"), (other, 100, 19.0, "kzt")]
    found = tickets.with_rates(orders, sales(one_each)).collect()
    assert sorted((r.order_id, r.curs) for r in found if r.curs) == [(1, 18.5), (2, 19.0)] and len(found) == 3
    for second in ((day, 1, 90.0, "usd"), (day, 100, 18.5, "kzt")):
        with pytest.raises(Exception, match="more than one rate on 2024-09-01"):
            tickets.with_rates(orders, sales([*one_each, second])).collect()
