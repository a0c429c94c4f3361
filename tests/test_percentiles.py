import math
import re

import numpy as np
import pytest

from factsieve.operators.order_statistics import BRACKET_SHARE, column_quantiles, quantiles
from factsieve.operators.trimming import (
    Limit, above_average, iqr_fences, iqr_filter, percentile_cap, percentile_trim, trim_bounds,
)

LEVELS = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.99, "g": 1.0}
RNG = np.random.default_rng(3)
SAMPLES = {
    "uniform": RNG.uniform(0, 1000, 4001),
    "heavy_tail": RNG.lognormal(3, 3, 4000),
    "signed": RNG.normal(0, 50, 3999),
    "ties": RNG.integers(0, 7, 5000).astype(float),
    "hot_value": np.concatenate([np.full(2000, 350.0), RNG.uniform(0, 1000, 4000)]),
    "narrow_far_from_zero": 1.7e9 + RNG.uniform(0, 0.5, 3000),
    "tiny": RNG.uniform(0, 1e-9, 3000),
    "tiny_with_one_larger": np.concatenate([RNG.uniform(0, 1e-6, 4000), [1e-3]]),
    "tiny_log_spread": 10 ** RNG.uniform(-300, -5, 4000),
    "one_value": np.array([4.25]),
    "two_values": np.array([1.0, 3.0]),
    "extremes": np.array([-1e308, -1.0, 0.0, 1e-300, 2.0, 1e308, math.inf]),
}


def frame(spark, values, schema="x double"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], schema).repartition(4)


@pytest.mark.parametrize("name", [n for n in SAMPLES if n != "extremes"])
def test_interpolated_equals_numpy(spark, name):
    found = quantiles(frame(spark, SAMPLES[name]), "x", LEVELS).first()
    expected = np.quantile(SAMPLES[name], list(LEVELS.values()))
    np.testing.assert_allclose([found[k] for k in LEVELS], expected, rtol=1e-14, atol=0)


@pytest.mark.parametrize("name", list(SAMPLES))
def test_discrete_is_the_value_at_the_rank(spark, name):
    ordered = np.sort(SAMPLES[name])
    found = quantiles(frame(spark, ordered), "x", LEVELS, kind="discrete").first()
    for key, p in LEVELS.items():
        assert found[key] == ordered[max(math.ceil(p * len(ordered)), 1) - 1]


def test_groups_and_missing_values(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", None), ("b", float("nan")), ("b", 5.0), (None, 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = {r.k: r.m for r in quantiles(df, "x", {"m": 0.5}, ["k"]).collect()}
    assert found == {"a": 50.0, "b": 5.0}


def test_skewed_group(spark):
    values = [("hot", float(i % 997) / 7) for i in range(6000)] + [(f"g{i % 50}", float(i)) for i in range(3000)]
    df = spark.createDataFrame(values, "k string, x double").repartition(8)
    found = {r.k: r.q for r in quantiles(df, "x", {"q": 0.9}, ["k"]).collect()}
    for key in ("hot", "g0", "g49"):
        assert found[key] == pytest.approx(np.quantile([v for k, v in values if k == key], 0.9), rel=1e-14)


def test_columns_share_one_pass(spark):
    df = spark.createDataFrame([(i, float(i * i), None if i % 3 else i) for i in range(100)], "a int, b double, c int")
    wanted = {"a99": ("a", 0.99), "b01": ("b", 0.01), "c50": ("c", 0.5)}
    assert tuple(column_quantiles(df, wanted, "discrete").first()) == (98.0, 0.0, 48.0)


def test_empty_input(spark):
    empty = frame(spark, [])
    assert quantiles(empty, "x", {"m": 0.5}).first().m is None
    assert tuple(column_quantiles(empty, {"m": ("x", 0.5)}, "interpolated").first()) == (None,)


def test_trim_is_strict_and_keeps_null_where_told(spark):
    rows = [(i, float(i), None if i == 50 else i) for i in range(1, 101)] + [(101, None, 5)]
    df = spark.createDataFrame(rows, "id int, area double, rooms int")
    limits = [Limit("area", high=0.99, keep_null=False), Limit("rooms", low=0.01, high=0.99)]
    bounds = trim_bounds(df, limits).first()
    assert (bounds.area_high, bounds.rooms_low, bounds.rooms_high) == (99.0, 1.0, 99.0)
    kept = {r.id for r in percentile_trim(df, limits).collect()}
    assert kept == set(range(2, 99))  # 50 has no room count and stays, 101 has no area and goes


def test_cap_is_inclusive_and_positive(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(-5, 96)], "x double, n int")
    kept = sorted(r.x for r in percentile_cap(df, {"x": 0.99, "n": 0.99}, positive=["x"]).collect())
    assert kept == [float(i) for i in range(1, 95)]


def test_iqr_filter_by_group(spark):
    rows = [("a", float(i)) for i in range(20)] + [("a", 500.0), ("b", 1.0), ("b", 1.0), ("b", 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    kept = sorted((r.k, r.x) for r in iqr_filter(df, "x", ["k"]).collect())
    assert kept == [("a", float(i)) for i in range(20)] + [("b", 1.0)] * 3
    fences = {r.k: (r.fence_low, r.fence_high) for r in iqr_fences(df, "x", ["k"]).collect()}
    assert fences == {"a": (5.0 - 15.0, 15.0 + 15.0), "b": (1.0, 1.0)}


def test_above_average(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "k string, n int")
    assert [r.k for r in above_average(df, "n").collect()] == ["c"]


def shares(spark, values):
    """Largest number of rows that a task of the second pass orders, as a share of all."""
    from factsieve.operators import order_statistics as stats
    from factsieve.operators.attach import attach
    from pyspark.sql import functions as F

    rows = stats.measured(frame(spark, values), "x", [])
    ends = rows.agg(F.expr(f"{stats._sketch('_v', [0.25, 0.5, 0.99])} AS _ends"))
    placed = attach(rows, ends, []).selectExpr(f"{stats._place('_v', '_ends', [0.25, 0.5, 0.99])} AS _at")
    return placed.groupBy("_at._gap", "_at._own").count().count() / len(values)


@pytest.mark.parametrize("name", ["uniform", "tiny_with_one_larger", "tiny_log_spread", "hot_value"])
def test_few_values_are_ordered_whatever_the_distribution(spark, name):
    values = np.concatenate([SAMPLES[name], SAMPLES[name][: len(SAMPLES[name]) // 3] * (1 + 1e-9)])
    many = np.concatenate([values * (1 + k * 1e-7) for k in range(12)])
    assert shares(spark, many) <= 3 * BRACKET_SHARE + 12 / len(many)


def test_grouped_fences_do_not_shuffle_rows_on_the_group_alone(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        df = spark.range(20_000).selectExpr("CAST(id % 2 AS STRING) AS k", "CAST(id * 7 % 1000 AS DOUBLE) AS x")
        found = iqr_filter(df, "x", ["k"])
        plan = found._jdf.queryExecution().toString()
        assert found.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    alone = re.findall(r"Exchange hashpartitioning\(k#\d+, \d+\).*\n(.*)", plan[plan.index("Physical Plan") :])
    assert all("Aggregate" in below for below in alone)
