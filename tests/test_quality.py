import pytest
from factsieve.operators import quality


def orders(spark):
    rows = [(1, "u", 10.0), (2, "u", 10.0), (3, "v", None), (9, "v", None), (4, "v", 5.0)]
    return spark.createDataFrame(rows, "order_id long, user string, gap double")


def test_duplicate_counts(spark):
    df = orders(spark)
    rest = quality.other_columns(df, ["order_id"])
    assert quality.duplicate_count(df, rest).first()[0] == 2
    assert quality.duplicate_count(df, rest, keep="none").first()[0] == 4
    assert quality.duplicate_count(df, df.columns).first()[0] == 0
    assert quality.duplicate_count(df.limit(0), df.columns).first()[0] == 0


def test_hidden_duplicates_keep_the_lowest_id_and_null_rows(spark):
    kept = quality.drop_hidden_duplicates(orders(spark), "order_id")
    assert kept.columns == ["order_id", "user", "gap"]
    assert sorted(r.order_id for r in kept.collect()) == [1, 3, 4]


def test_dedup_keeps_the_first_row_of_a_hot_key(spark):
    rows = [(i, "hot", f"c{i}") for i in range(5000, 0, -1)] + [(i, f"k{i}", "x") for i in range(2500)]
    df = spark.createDataFrame(rows, "row_no int, puid string, city string").repartition(6)
    kept = quality.dedup(df, ["puid"], "row_no").collect()
    assert len(kept) == 2501
    assert [(r.row_no, r.city) for r in kept if r.puid == "hot"] == [(1, "c1")]


def test_dedup_keeps_one_row_of_equal_null_and_tied_orders(spark):
    rows = [
        ("a", 1, "x", 0.5), ("a", 1, "y", None), ("a", 1, "y", None), ("a", 2, "z", 1.0),  # tied, one repeated
        ("b", None, "p", 1.0), ("b", None, "q", 2.0),  # no order at all
        ("c", None, "p", 1.0), ("c", 7, "q", 2.0),  # NULL comes last
        (None, 3, "n", 1.0), (None, 3, "m", 1.0),  # a key that is NULL
        ("d", 1, "same", 1.0), ("d", 1, "same", 1.0),
    ] + [("hot", 1, f"c{i}", float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "puid string, row_no int, city string, hours double")
    kept = [tuple(r) for r in quality.dedup(df, ["puid"], "row_no").collect()]
    assert sorted(str(r[0]) for r in kept) == ["None", "a", "b", "c", "d", "hot"]
    assert all(r in rows for r in kept)
    by_key = {r[0]: r for r in kept}
    assert by_key["a"][1] == 1 and by_key["c"] == ("c", 7, "q", 2.0)
    again = quality.dedup(df.repartition(7, "city"), ["puid"], "row_no").collect()
    assert sorted(map(str, kept)) == sorted(str(tuple(r)) for r in again)  # whatever the partitions
    plan = quality.dedup(df, ["puid"], "row_no")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan


@pytest.mark.parametrize("kind", ["string", "double", "date", "timestamp", "bigint"])
def test_dedup_by_orders_of_other_types(spark, kind):
    """The same rows and ties under an order of each type; extremes of long, moments before 1970."""
    day = "date_add(DATE '1969-12-25', row_no)"
    order = {
        "string": "lpad(CAST(row_no AS STRING), 3, '0')", "double": "row_no / 2D", "date": day,
        "timestamp": f"CAST({day} AS TIMESTAMP) + INTERVAL 1 MICROSECOND",
        "bigint": "CASE row_no WHEN 0 THEN -9223372036854775808L WHEN 20 THEN 9223372036854775807L ELSE row_no END",
    }[kind]
    rows = [(f"k{i % 7}", None if i % 5 == 4 else (i * 3) % 21, f"c{i % 4}") for i in range(200)] + [("n", None, "x"), ("n", None, "y")]
    df = spark.createDataFrame(rows, "puid string, row_no int, city string").selectExpr("puid", f"{order} AS place", "row_no", "city")
    kept = quality.dedup(df, ["puid"], "place").collect()
    assert len(kept) == 8
    for row in kept:
        known = [r[1] for r in rows if r[0] == row.puid and r[1] is not None]
        assert row.row_no == min(known, default=None)


def test_null_profile_and_counts(spark):
    df = orders(spark)
    profile = {r.column: (r.type, r.filled, r.missing) for r in quality.null_profile(df).collect()}
    assert profile == {"order_id": ("bigint", 5, 0), "user": ("string", 5, 0), "gap": ("double", 3, 2)}
    assert quality.null_count(df, "gap").first()[0] == 2
    assert {r.user: r.missing for r in quality.null_count(df, "gap", ["user"]).collect()} == {"u": 0, "v": 2}


def test_describe(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "x double")
    row = quality.describe(df, "x").first()
    assert (row["count"], row.mean, row.min, row.q25, row.q50, row.q75, row.max) == (5, 3.0, 1.0, 2.0, 3.0, 4.0, 5.0)
    assert abs(row["std"] - 2.5**0.5) < 1e-12


def test_distinct_values(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "x string")
    assert {r.x for r in quality.distinct_values(df, "x").collect()} == {"a", "b", None}
    assert [r.x for r in quality.distinct_values(df, "x", dropna=True, sort=True).collect()] == ["a", "b"]


def test_narrowing_reports_what_does_not_fit(spark):
    df = spark.createDataFrame([(127, 1), (128, 2), (-129, None)], "a int, b int")
    assert [tuple(r) for r in quality.narrow_integers(df, ["b"]).collect()] == [(127, 1), (128, 2), (-129, None)]
    with pytest.raises(Exception, match="a does not fit tinyint"):
        quality.narrow_integers(df, ["a"]).collect()
    assert {r.column: r.failures for r in quality.narrowing_failures(df, ["a", "b"]).collect()} == {"a": 2, "b": 0}


def test_retained_share_and_signed_totals(spark):
    df = orders(spark)
    row = quality.retained_share(df, df.na.drop()).first()
    assert (row.rows_before, row.rows_after, row.kept_pct) == (5, 3, 60.0)
    x = spark.createDataFrame([(-2.0,), (3.0,), (4.0,), (0.0,), (None,)], "x double")
    assert tuple(quality.signed_totals(x, "x").first()) == (-2.0, 7.0)


def test_labels_and_head(spark):
    df = spark.createDataFrame([(2, "x"), (1, "y"), (3, None)], "i int, k string")
    merged = quality.replace_labels(df, "k", {"x": "y"})
    assert [tuple(r) for r in quality.head(merged, 2, ["i"]).collect()] == [(1, "y"), (2, "y")]
