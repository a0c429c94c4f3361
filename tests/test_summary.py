import numpy as np
import pytest

from factsieve.operators import summary

RNG = np.random.default_rng(11)


@pytest.mark.parametrize(
    "values,bins",
    [
        (RNG.exponential(3, 2000), 20),
        (RNG.integers(0, 11, 3000).astype(float), 10),
        (np.round(RNG.uniform(0, 3, 3000), 1), 30),
        (np.array([2.0, 2.0, 2.0]), 10),
        (np.array([-10.0, 0.1, 0.2, 0.3, 29.0]), 20),
    ],
)
def test_histogram_equals_numpy(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    rows = summary.histogram(df, "x", bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins)
    assert [r["count"] for r in rows] == list(counts)
    np.testing.assert_allclose([r.bin_low for r in rows] + [rows[-1].bin_high], edges, rtol=1e-12, atol=1e-12)


def test_histogram_by_group_keeps_empty_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 1.0), ("b", 2.0), (None, 4.0)], "k string, x double")
    rows = summary.histogram(df, "x", 5, ["k"]).orderBy("k", "bin").collect()
    assert [r["count"] for r in rows] == [1, 0, 0, 0, 1, 1, 0, 0, 0, 1]


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 40.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = summary.box_stats(df, "x").first()
    assert (row.q1, row.median, row.q3) == tuple(np.quantile(values, [0.25, 0.5, 0.75]))
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 5.0, 1)


def test_pivot_counts_and_shares(spark):
    rows = [("a", "s", 1), ("a", "s", 2), ("a", "w", 3), ("b", "s", 4), (None, "s", 5), ("b", "other", 6)]
    df = spark.createDataFrame(rows, "k string, season string, id int")
    table = summary.pivot_count(df, "k", "season", {"s": "summer", "w": "winter"}, "id")
    shares = {r.k: tuple(r)[1:] for r in summary.column_shares(table, ["summer", "winter"]).collect()}
    assert shares == {"a": (2, 1, 66.67, 100.0), "b": (1, None, 33.33, None)}


def test_share_heat_and_mean(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 6)], "k string, n int")
    rows = {r.k: (r.n_pct, r.n_heat) for r in summary.add_share(df, ["n"], shaded=["n"]).collect()}
    assert rows == {"a": (10.0, 0.0), "b": (30.0, 0.4), "c": (60.0, 1.0)}
    assert {r.m for r in summary.add_mean(df, "n", "m").collect()} == {10 / 3}


def test_activity_counts_distinct_keys(spark):
    df = spark.createDataFrame([("a", 1, "u"), ("a", 2, "u"), ("a", 3, None), (None, 4, "v")], "k string, o int, u string")
    assert [tuple(r) for r in summary.activity(df, "k", "o", "u", "users").collect()] == [("a", 3, 1)]
