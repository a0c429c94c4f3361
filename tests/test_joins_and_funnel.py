import datetime as dt
import re

from pyspark.sql import functions as F

from factsieve.operators import funnel, joins

DAY0 = dt.datetime(2024, 5, 1, 12)


def at(days):
    return DAY0 + dt.timedelta(days=days)


def events(spark):
    rows = [
        ("u1", "A", "registration", at(0)), ("u1", "A", "purchase", at(7.9)), ("u1", "A", "purchase", at(8)),
        ("u2", "A", "registration", at(0)), ("u2", "A", "purchase", at(9)), ("u2", "A", "registration", at(5)),
        ("u3", "B", "purchase", at(1)), ("u4", "B", "registration", at(3)), ("u4", "B", "purchase", at(2)),
    ]
    return spark.createDataFrame(rows, "user_id string, `group` string, event_name string, event_dt timestamp_ntz")


def lived(spark, which="first"):
    return funnel.with_lifetime(
        events(spark), "user_id", "event_name", "registration", "event_dt", "registration_dt", which
    )


def buyers(frame):
    return {r.user_id for r in funnel.within_days(frame, 7).filter("event_name = 'purchase'").collect()}


def test_window_of_days(spark):
    first = lived(spark)
    assert first.count() == 9  # one start per user: no row is multiplied
    assert buyers(first) == {"u1", "u4"}
    early = funnel.within_days(first, 7, min_days=0).filter("event_name = 'purchase'")
    assert {r.user_id for r in early.collect()} == {"u1"}  # u4 bought before registering


def test_last_start_decides_as_all_pairs_would(spark):
    frame = events(spark)
    starts = frame.filter("event_name = 'registration'").select("user_id", F.col("event_dt").alias("s"))
    pairs = frame.join(starts, "user_id").filter("event_name = 'purchase'")
    near = pairs.filter("event_dt < s + INTERVAL 8 DAYS")
    assert buyers(lived(spark, "last")) == {r.user_id for r in near.collect()} == {"u1", "u2", "u4"}


def test_fanout_equals_the_join_it_replaces(spark):
    frame = events(spark)
    starts = frame.filter("event_name = 'registration'").select("user_id", F.col("event_dt").alias("s"))
    joined = frame.join(starts, "user_id", "left").groupBy("group", "event_name").count()
    expected = {(r["group"], r.event_name): r["count"] for r in joined.collect()}
    found = funnel.fanout(frame, "user_id", "group", "event_name", "registration").collect()
    assert {(r["group"], r.event_name): r.joined_rows for r in found} == expected
    assert sum(r.rows for r in found) == 9


def plain_windowed_fanout(frame, days):
    starts = frame.filter("event_name = 'registration'").select("user_id", F.col("event_dt").alias("s"))
    pairs = frame.join(starts, "user_id").filter(F.expr(f"event_dt < s + INTERVAL {days + 1} DAYS"))
    return {(r["group"], r.event_name): r["count"] for r in pairs.groupBy("group", "event_name").count().collect()}


def windowed(frame, days):
    return funnel.windowed_fanout(frame, "user_id", "group", "event_name", "registration", "event_dt", days)


def test_windowed_fanout_equals_the_join_it_replaces(spark):
    """Hot users, several starts a day, events at midnight and at equal moments."""
    names = "array('registration', 'purchase', 'login')"
    frame = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 97 = 0 THEN NULL ELSE concat('u', id % 40) END AS user_id",
        "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS `group`",
        f"{names}[CAST(id * 7 % 11 % 3 AS INT)] AS event_name",
        """CASE WHEN id % 50 = 0 THEN TIMESTAMP_NTZ '2024-05-01' + make_dt_interval(CAST(id % 20 AS INT))
                WHEN id % 301 = 0 THEN NULL
                ELSE TIMESTAMP_NTZ '2024-05-01' + make_dt_interval(CAST(id % 30 AS INT), CAST(id * 13 % 24 AS INT), 0, id % 5)
           END AS event_dt""",
    )
    for days in (0, 7):
        expected = plain_windowed_fanout(frame, days)
        assert {(r["group"], r.event_name): r.joined_rows for r in windowed(frame, days).collect()} == expected
    assert windowed(frame.limit(0), 7).count() == 0


def test_a_hot_user_is_spread_over_days(spark):
    """Moments are put in order inside a user's day; windows over a user alone run over days."""
    plan = windowed(events(spark), 7)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"\[user_id#\d+, _day#\d+\], \[_at#", plan)
    assert re.search(r"\[user_id#\d+\], \[_day#", plan)
    assert not re.search(r"\[user_id#\d+\], \[_at#", plan)


def test_windowed_fanout_passes_its_rows_through_one_step(spark):
    """The events are read once, and their parts are as many as the session says, however few their bytes."""
    plan = windowed(events(spark), 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert re.search(rf"RepartitionByExpression \[user_id#\d+, _day#\d+\], {parts}", plan)


def test_windowed_fanout_without_starts_or_groups(spark):
    rows = [("u1", None, "registration", at(0)), ("u1", None, "purchase", at(1)), ("u2", "B", "purchase", at(1))]
    frame = spark.createDataFrame(rows, "user_id string, `group` string, event_name string, event_dt timestamp_ntz")
    found = {(r["group"], r.event_name): r.joined_rows for r in windowed(frame, 7).collect()}
    assert found == {(None, "registration"): 1, (None, "purchase"): 1}


def test_conversion_counts_users_without_events(spark):
    people = spark.createDataFrame([("u1", "A"), ("u2", "A"), ("u9", "A"), ("u3", "B")], "user_id string, `group` string")
    goals = funnel.within_days(lived(spark), 7).filter("event_name = 'purchase' AND `group` = 'A'")
    rows = {r["group"]: tuple(r)[1:] for r in funnel.conversion(people, goals, "group", "user_id").collect()}
    assert rows == {"A": (3, 1, 33.33), "B": (1, None, None)}


def test_left_join_facts_equals_left_join(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, i int")
    facts = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 7), ("z", 8), (None, 9)], "k string, v int")
    order = lambda d: sorted(map(str, d.select("k", "i", "v").collect()))
    assert order(joins.left_join_facts(left, facts, "k")) == order(left.join(facts, "k", "left"))


def test_independent_samples_and_overlap(spark):
    rows = [("u1", "m", 1), ("u1", "d", 2), ("u2", "m", 3), ("u2", "m", 4), ("u3", "d", 5), ("u4", "x", 6), (None, "m", 7)]
    df = spark.createDataFrame(rows, "u string, g string, i int")
    assert {r.i for r in joins.independent_samples(df, "u", "g", "m", "d").collect()} == {3, 4, 5}
    assert tuple(joins.overlap_count(df, "u", "g", "m", "d").first()) == (2, 2, 1)
