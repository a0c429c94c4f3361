import datetime as dt
from types import SimpleNamespace

import pytest

from factsieve.session import scratch_path, shared_folder
from factsieve.sources import schemas, standins
from factsieve.sources.readers import load, read_csv

TEXT = 'user_id,event_dt,event_name,details\nu1,2020-12-01 00:00:05,purchase,"4,99"\nu2,2020-12-02 10:00:00,login,\n'
EXPECTED = [
    ("u1", dt.datetime(2020, 12, 1, 0, 0, 5), "purchase", "4,99"),
    ("u2", dt.datetime(2020, 12, 2, 10), "login", None),
]


def test_csv_by_schema(spark, tmp_path):
    (tmp_path / "events.csv").write_text(TEXT)
    rows = read_csv(spark, str(tmp_path / "events.csv"), schemas.AB_EVENTS, timestamp_format="yyyy-MM-dd HH:mm:ss")
    assert rows.schema == schemas.AB_EVENTS and [tuple(r) for r in rows.collect()] == EXPECTED


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("puid,city,hours\np1,Москва,much\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(tmp_path / "bad.csv"), schemas.CITY_USAGE).collect()


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == folder
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(folder) and spark.sparkContext.applicationId in first


def test_shared_folder_is_never_a_guess_on_a_cluster():
    class Unset:
        def get(self, key, default=None):
            return default

    session = SimpleNamespace(conf=Unset(), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(session)


def test_load_sees_a_changed_schema(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert load(spark, str(tmp_path), "t").columns == ["id"]
    spark.range(3).selectExpr("id", "id AS more").write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert load(spark, str(tmp_path), "t").columns == ["id", "more"]


def test_gap_to_previous_order_matches_a_plain_window(spark):
    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    plain = orders.selectExpr(
        "o_orderkey AS order_id",
        """CAST(datediff(o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
           AS DOUBLE) AS expected""",
    )
    both = standins.ticket_orders(spark, folder).join(plain, "order_id")
    assert both.count() > 1000 and both.filter("NOT (days_since_prev <=> expected)").count() == 0
