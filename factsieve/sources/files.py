"""The inputs of each analysis from CSV files with the schemas of ``schemas``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from factsieve.plans.interface_test import Experiment
from factsieve.plans.property import Market
from factsieve.plans.tickets import Sales
from factsieve.sources import schemas
from factsieve.sources.readers import read_csv

#: Timestamps with or without fractions of a second.
MOMENT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def market_from_files(spark: SparkSession, folder: str, **parts: object) -> Market:
    """Listings from ``flats``, ``advertisement``, ``city`` and ``type`` under a folder; ``parts`` as in ``Market``."""
    read = lambda name, schema: partial(read_csv, spark, f"{folder}/{name}", schema)
    return Market(
        flats=read("flats", schemas.FLATS),
        advertisement=read("advertisement", schemas.ADVERTISEMENT),
        city=read("city", schemas.CITY),
        settlement_type=read("type", schemas.SETTLEMENT_TYPE),
        **parts,
    )


def sales_from_files(spark: SparkSession, folder: str) -> Sales:
    """Ticket sales from ``orders``, ``events`` and ``rates`` under a folder."""

    def read(name: str, schema) -> DataFrame:
        return read_csv(spark, f"{folder}/{name}", schema, timestamp_format=MOMENT)

    return Sales(
        orders=partial(read, "orders", schemas.TICKET_ORDERS),
        events=partial(read, "events", schemas.TICKET_EVENTS),
        rates=partial(read, "rates", schemas.CURRENCY_RATES),
    )


def experiment_from_files(spark: SparkSession, folder: str, name: str) -> Experiment:
    """A conversion test from ``participants`` and ``events`` under a folder."""

    def events() -> DataFrame:
        return read_csv(spark, f"{folder}/events", schemas.AB_EVENTS, timestamp_format=MOMENT)

    return Experiment(
        participants=partial(read_csv, spark, f"{folder}/participants", schemas.AB_PARTICIPANTS), events=events, name=name
    )
