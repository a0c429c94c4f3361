"""Explicit schemas of every input table; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FLATS = _table(
    id=T.StringType(), total_area=T.DoubleType(), rooms=T.IntegerType(), balcony=T.IntegerType(),
    ceiling_height=T.DoubleType(), floor=T.IntegerType(), floors_total=T.IntegerType(),
    is_apartment=T.IntegerType(), city_id=T.StringType(), type_id=T.StringType(),
)
ADVERTISEMENT = _table(
    id=T.StringType(), first_day_exposition=T.DateType(), days_exposition=T.DoubleType(), last_price=T.DoubleType(),
)
CITY = _table(city_id=T.StringType(), city=T.StringType())
SETTLEMENT_TYPE = _table(type_id=T.StringType(), type=T.StringType())
TICKET_ORDERS = _table(
    order_id=T.LongType(), user_id=T.StringType(), created_dt_msk=T.DateType(), created_ts_msk=T.TimestampNTZType(),
    event_id=T.LongType(), age_limit=T.IntegerType(), currency_code=T.StringType(),
    device_type_canonical=T.StringType(), revenue=T.DoubleType(), service_name=T.StringType(),
    tickets_count=T.IntegerType(), total=T.DoubleType(), days_since_prev=T.DoubleType(),
)
TICKET_EVENTS = _table(
    event_id=T.LongType(), event_type_description=T.StringType(), event_type_main=T.StringType(),
    region_name=T.StringType(), city_name=T.StringType(), venue_name=T.StringType(), venue_address=T.StringType(),
)
CURRENCY_RATES = _table(data=T.DateType(), nominal=T.IntegerType(), curs=T.DoubleType(), cdx=T.StringType())
AB_PARTICIPANTS = _table(user_id=T.StringType(), group=T.StringType(), ab_test=T.StringType())
AB_EVENTS = _table(
    user_id=T.StringType(), event_dt=T.TimestampNTZType(), event_name=T.StringType(), details=T.StringType(),
)
CITY_USAGE = _table(puid=T.StringType(), city=T.StringType(), hours=T.DoubleType())
