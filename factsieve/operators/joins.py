"""Join shapes beyond a plain equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_facts(left: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join of few distinct keys to many facts, safe for keys with very many facts.

    Spark cannot split a hot key on the right side of a left join. So matched rows come
    from an inner join, whose hot partitions it can split on either side, and unmatched
    rows from an anti-join with the distinct keys, which are reduced before their shuffle.
    """
    matched = left.join(facts, key)
    keys = facts.select(key).distinct()
    unmatched = left.join(keys, key, "left_anti")
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema.fields if f.name != key]
    return matched.unionByName(unmatched.select("*", *added))


def keep_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in a list of ids."""
    return df.join(ids, key, "left_semi")


def _rows_in(df: DataFrame, key: str, group: str, a: str, b: str) -> DataFrame:
    """Rows of each key in groups a and b; counts, unlike labels, aggregate by hash."""
    in_a, in_b = F.count_if(F.col(group) == a), F.count_if(F.col(group) == b)
    return df.groupBy(key).agg(in_a.alias("_a"), in_b.alias("_b"))


def sole_group_keys(df: DataFrame, key: str, group: str, a: str, b: str) -> DataFrame:
    """Keys found in exactly one of the groups a and b."""
    return _rows_in(df, key, group, a, b).filter((F.col("_a") > 0) != (F.col("_b") > 0)).select(key)


def independent_samples(df: DataFrame, key: str, group: str, a: str, b: str) -> DataFrame:
    """Rows of groups a and b without the keys that occur in both."""
    rows = df.filter(F.col(group).isin(a, b))
    return keep_listed(rows, sole_group_keys(rows, key, group, a, b), key)


def overlap_count(df: DataFrame, key: str, group: str, a: str, b: str) -> DataFrame:
    """How many keys occur in a, in b, and in both, from one grouped pass."""
    rows = _rows_in(df.filter(F.col(group).isin(a, b) & F.col(key).isNotNull()), key, group, a, b)
    in_a, in_b = F.col("_a") > 0, F.col("_b") > 0
    return rows.agg(
        F.count_if(in_a).alias("in_a"), F.count_if(in_b).alias("in_b"), F.count_if(in_a & in_b).alias("in_both")
    )
