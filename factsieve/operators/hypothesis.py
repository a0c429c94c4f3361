"""Statistical tests whose heavy part is a distributed aggregate over the samples."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.normal import upper_tail
from factsieve.functions.rounding import ratio
from factsieve.operators.order_statistics import before, measured


def rank_sums(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """One row: sample sizes, twice the rank sum of sample a, and the tie term.

    Rows are reduced to counts per distinct value, and these are dealt to tasks by range. In
    a range of values the rank sum needs only the counts ahead of it inside the range; what the
    ranges before add to it is their total count, once per row of sample a. So a range becomes one
    row, and one running total over as many rows as there are shuffle partitions does the rest.
    """
    samples = measured(df.filter(F.col(group).isin(a, b)), value, [group]).withColumnRenamed(group, "_group")
    values = samples.groupBy("_v").agg(F.expr("count(*) AS _n"), F.count_if(F.col("_group") == a).alias("_n_a"))
    dealt = values.repartitionByRange("_v").withColumn("_range", F.spark_partition_id())
    ordered = dealt.selectExpr("*", f"{before(['_range'], '_v')} AS _before")
    own = "CAST(_n_a AS DECIMAL(20,0)) * (CAST(_before AS DECIMAL(20,0)) * 2 + _n + 1)"
    ranges = ordered.groupBy("_range").agg(
        F.expr("sum(_n) AS _n"),
        F.expr("sum(_n_a) AS _n_a"),
        F.expr(f"sum(CAST({own} AS DECIMAL(38,0))) AS _own"),
        F.expr("sum(CAST(_n AS DOUBLE) * _n * _n - _n) AS _ties"),
    )
    ranges = ranges.selectExpr("*", f"{before([], '_range')} AS _ahead")
    return ranges.agg(
        F.expr("coalesce(sum(_n_a), 0L) AS n_a"),
        F.expr("coalesce(sum(_n) - sum(_n_a), 0L) AS n_b"),
        F.expr("sum(_own + CAST(_n_a AS DECIMAL(18,0)) * CAST(_ahead AS DECIMAL(18,0)) * 2) AS _twice_ranks"),
        F.expr("sum(_ties) AS _ties"),
    )


def mann_whitney(
    df: DataFrame,
    value: str,
    group: str,
    a: str,
    b: str,
    alternative: str = "two-sided",
    alpha: float = 0.05,
) -> DataFrame:
    """Rank-sum test of sample a against sample b, with tie and continuity corrections.

    One row: sample sizes, U of sample a, z, p-value and verdict. NULL and NaN values are
    left out and not counted. The p-value is asymptotic; ``small_sample`` marks samples of
    at most 8 values, for which an exact distribution would differ. Rank sums are added
    as twice their value in decimals, so they stay exact beyond 2^53.
    """
    sums = rank_sums(df, value, group, a, b)
    a_n, b_n = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    lowest = "CAST(n_a AS DECIMAL(19,0)) * CAST(n_a + 1 AS DECIMAL(19,0))"
    scored = sums.withColumn("u", F.expr(f"CAST(_twice_ranks - {lowest} AS DOUBLE) / 2D"))
    other = a_n * b_n - F.col("u")
    side = {"greater": F.col("u"), "less": other, "two-sided": F.greatest(F.col("u"), other)}[alternative]
    total = a_n + b_n
    sigma = F.sqrt(a_n * b_n / 12.0 * ((total + 1.0) - ratio(F.col("_ties"), total * (total - 1.0))))
    scored = scored.withColumn("z", ratio(side - a_n * b_n / 2.0 - 0.5, sigma))
    p = upper_tail(F.col("z")) * (2.0 if alternative == "two-sided" else 1.0)
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    p = F.when(F.col("z").isNotNull(), F.least(p, F.lit(1.0))).when(both, F.lit(1.0))  # all values equal
    scored = scored.withColumn("p_value", p)
    return scored.select(
        "n_a", "n_b", "u", "z", "p_value", *verdict(alpha), (F.least("n_a", "n_b") <= 8).alias("small_sample")
    )


def verdict(alpha: float) -> list[Column]:
    """The null hypothesis stays only while p is above alpha; equality rejects it."""
    return [(F.col("p_value") <= F.lit(alpha)).alias("reject_h0")]


def proportions_ztest(counts: DataFrame, alternative: str = "smaller", alpha: float = 0.05) -> DataFrame:
    """Pooled two-proportion z-test on one row with ``n_a, m_a, n_b, m_b``.

    ``enough_data`` holds when successes and failures exceed 10 in both groups.
    """
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    m_a, m_b = F.col("m_a").cast("double"), F.col("m_b").cast("double")
    shares = counts.withColumns({"p_a": ratio(m_a, n_a), "p_b": ratio(m_b, n_b)})
    pooled = ratio(m_a + m_b, n_a + n_b)
    spread = F.sqrt(pooled * (1.0 - pooled) * (ratio(F.lit(1.0), n_a) + ratio(F.lit(1.0), n_b)))
    tested = shares.withColumn("z", ratio(F.col("p_a") - F.col("p_b"), spread))
    z = F.col("z")
    p = {
        "smaller": upper_tail(-z),
        "larger": upper_tail(z),
        "two-sided": upper_tail(F.abs(z)) * 2.0,
    }[alternative]
    enough = F.lit(True)
    for share, size in ((F.col("p_a"), n_a), (F.col("p_b"), n_b)):
        enough = enough & (share * size > 10) & ((1.0 - share) * size > 10)
    return tested.withColumn("p_value", p).select(
        "n_a", "m_a", "n_b", "m_b", "p_a", "p_b", "z", "p_value", enough.alias("enough_data"), *verdict(alpha)
    )


def group_counts(df: DataFrame, group: str, a: str, b: str, size: Column, success: Column) -> DataFrame:
    """One row ``n_a, m_a, n_b, m_b`` from two columns of a small per-group table."""
    in_a, in_b = F.col(group) == a, F.col(group) == b
    pick = lambda name, side, x: F.coalesce(F.max(F.when(side, x)), F.lit(0)).alias(name)
    return df.agg(
        pick("n_a", in_a, size), pick("m_a", in_a, success), pick("n_b", in_b, size), pick("m_b", in_b, success)
    )


def required_sample_size(
    p1: float, p2: float, alpha: float = 0.05, power: float = 0.8, alternative: str = "two-sided"
) -> float:
    """Size of each group at which a z-test finds p2 against p1 with the given power."""
    effect = (p2 - p1) / math.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2)
    tail = alpha / 2 if alternative == "two-sided" else alpha
    needed = NormalDist().inv_cdf(1 - tail) + NormalDist().inv_cdf(power)
    return 2 * (needed / effect) ** 2


def sample_size_check(sizes: DataFrame, column: str, p1: float, p2: float, **options) -> DataFrame:
    """Compare the size each group has with the size the test needs."""
    needed = int(required_sample_size(p1, p2, **options))
    checked = sizes.withColumn("required", F.lit(needed).cast("bigint"))
    return checked.withColumn("enough", F.col(column) >= F.col("required"))
