"""Arrow helpers shared by the operators: text columns as bytes, row filters, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Every ASCII byte that is no letter or digit becomes a space, A-Z become a-z, the rest stays.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; null has none."""
    return text.translate(_ALNUM).split() if text else []


def raw(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def map_rows(
    frame: DataFrame, columns: list[str], start: Callable[[], Callable[..., pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply a function to each Arrow batch of the chosen columns; no shuffle.

    ``start()`` runs once a task and returns the function, which gets the batch's columns.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            yield work(*(batch.column(i) for i in range(len(columns))))

    return frame.select(*columns).mapInArrow(task, schema)


def filter_rows(frame: DataFrame, columns: list[str], start: Callable[[], Callable[..., list[bool]]]) -> DataFrame:
    """Keep the rows for which the function says so; all columns stay as they are, no shuffle."""
    places = [frame.columns.index(c) for c in columns]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            yield batch.filter(pa.array(work(*(batch.column(i) for i in places)), pa.bool_()))

    return frame.mapInArrow(task, frame.schema)
