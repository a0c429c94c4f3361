"""Readers: parquet tables and CSV files. Zipped files are unpacked when they are staged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    timestamp_format: str | None = None,
    date_format: str | None = None,
) -> DataFrame:
    """Delimited text with a header line and a given schema.

    Files behind http are staged to storage first. A malformed row fails the read instead
    of turning into NULLs, and the header must match the schema.
    """
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
    if date_format:
        reader = reader.option("dateFormat", date_format)
    return reader.csv(path)
