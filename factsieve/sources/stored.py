"""Results that several queries share, written once per version of their inputs and read from then on."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factsieve.session import shared_folder


def _path(spark: SparkSession, path: str):
    """A path and its file system, through the file systems that Spark itself uses."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_version(spark: SparkSession, *paths: str) -> str:
    """A short name for the present files of some tables: their names, sizes and times of change.

    Only the listing is read. Appending to a table, or writing it anew, gives another version.
    """
    marks = []
    for path in sorted(paths):
        root, system = _path(spark, path)
        files = system.listFiles(root, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                marks.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(marks)).encode()).hexdigest()[:16]


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path has ended; a broken one leaves no mark."""
    root, system = _path(spark, os.path.join(path, "_SUCCESS"))
    return system.exists(root)


def stored(
    spark: SparkSession,
    name: str,
    version: str,
    make: Callable[[], DataFrame],
    partition_by: list[str] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """The rows of ``make()``, computed the first time a version is asked for and read from Parquet after.

    The folder is one that all executors reach (by default the session's shared folder). Rows are
    written to a hidden folder beside their place and moved there when complete; of two sessions
    that write one version at once, the first to end is read by both.
    """
    parent = folder or os.path.join(shared_folder(spark), "stored")
    place = os.path.join(parent, f"{name}-{version}")
    if not is_complete(spark, place):
        draft, system = _path(spark, os.path.join(parent, f"_{name}-{uuid.uuid4().hex}"))
        make().write.partitionBy(*(partition_by or [])).parquet(draft.toString())
        if is_complete(spark, place):
            system.delete(draft, True)
        else:
            system.rename(draft, _path(spark, place)[0])
    return spark.read.parquet(place)
