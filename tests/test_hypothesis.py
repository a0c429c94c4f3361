import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factsieve.operators.hypothesis import (
    group_counts, mann_whitney, proportions_ztest, required_sample_size, sample_size_check,
)

RNG = np.random.default_rng(17)
SAMPLES = {
    "continuous": (RNG.exponential(2, 700), RNG.exponential(2.3, 1100)),
    "ties": (RNG.integers(1, 9, 900).astype(float), RNG.integers(1, 10, 400).astype(float)),
    "signed_hot_value": (np.concatenate([np.zeros(500), RNG.normal(0, 5, 300)]), np.concatenate([np.zeros(200), RNG.normal(1, 5, 300)])),
    "narrow": (1e9 + RNG.uniform(0, 0.01, 300), 1e9 + RNG.uniform(0, 0.012, 300)),
    "tiny_with_one_larger": (np.concatenate([RNG.uniform(0, 1e-6, 500), [1e-3]]), RNG.uniform(0, 1.1e-6, 400)),
    "small": (np.array([1.0, 5.0, 9.0]), np.array([2.0, 3.0, 4.0, 8.0, 9.0])),
}


def brute(a, b, alternative):
    """Rank sums on one machine."""
    ranks = pd.Series(np.concatenate([a, b])).rank()
    n1, n2, n = len(a), len(b), len(a) + len(b)
    u1 = ranks[:n1].sum() - n1 * (n1 + 1) / 2
    u = {"greater": u1, "less": n1 * n2 - u1, "two-sided": max(u1, n1 * n2 - u1)}[alternative]
    t = pd.Series(np.concatenate([a, b])).value_counts().to_numpy().astype(float)
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    z = (u - n1 * n2 / 2 - 0.5) / sigma
    p = 0.5 * math.erfc(z / math.sqrt(2)) * (2 if alternative == "two-sided" else 1)
    return u1, z, min(p, 1.0)


def samples(spark, a, b):
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("a", None), ("c", 1.0), ("b", float("nan"))]
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


@pytest.mark.parametrize("name", list(SAMPLES))
@pytest.mark.parametrize("alternative", ["greater", "less", "two-sided"])
def test_mann_whitney_equals_brute_force(spark, name, alternative):
    a, b = SAMPLES[name]
    row = mann_whitney(samples(spark, a, b), "x", "g", "a", "b", alternative).first()
    u, z, p = brute(a, b, alternative)
    assert (row.n_a, row.n_b, row.u) == (len(a), len(b), u)
    assert row.z == pytest.approx(z, rel=1e-12, abs=1e-12) and row.p_value == pytest.approx(p, rel=1e-11)
    assert row.reject_h0 == (p <= 0.05) and row.small_sample == (min(len(a), len(b)) <= 8)


def test_mann_whitney_without_spread_or_rows(spark):
    equal = mann_whitney(samples(spark, [1.0] * 5, [1.0] * 4), "x", "g", "a", "b").first()
    assert (equal.n_a, equal.n_b, equal.u, equal.p_value) == (5, 4, 10.0, 1.0)
    empty = mann_whitney(samples(spark, [], []), "x", "g", "a", "b").first()
    assert (empty.n_a, empty.n_b, empty.p_value) == (0, 0, None)


def test_published_conversion_figures(spark):
    counts = spark.createDataFrame([("A", 5383, 1542), ("B", 5467, 1687)], "g string, n long, m long")
    row = proportions_ztest(group_counts(counts, "g", "A", "B", F.col("n"), F.col("m"))).first()
    assert round(row.z, 2) == -2.52 and round(row.p_value, 4) == 0.0059
    assert row.enough_data and row.reject_h0


def test_ztest_sides_and_precondition(spark):
    counts = spark.createDataFrame([(100, 10, 100, 30)], "n_a long, m_a long, n_b long, m_b long")
    p = {side: proportions_ztest(counts, side).first().p_value for side in ("smaller", "larger", "two-sided")}
    assert p["smaller"] + p["larger"] == pytest.approx(1) and p["two-sided"] == pytest.approx(2 * p["smaller"])
    assert proportions_ztest(counts).first().enough_data is False  # exactly ten successes in a


def test_verdict_rejects_at_equality(spark):
    counts = spark.createDataFrame([(400, 100, 400, 100)], "n_a long, m_a long, n_b long, m_b long")
    row = proportions_ztest(counts, "smaller", alpha=0.5).first()
    assert row.p_value == 0.5 and row.reject_h0


def test_sample_size(spark):
    assert required_sample_size(0.3, 0.33) == pytest.approx(3759.6, abs=0.1)
    assert required_sample_size(0.3, 0.33, alternative="smaller") < 3000
    sizes = spark.createDataFrame([("A", 5383), ("B", 3758)], "g string, users long")
    assert [tuple(r) for r in sample_size_check(sizes, "users", 0.3, 0.33).orderBy("g").collect()] == [
        ("A", 5383, 3759, True), ("B", 3758, 3759, False),
    ]
