"""Benchmark decontamination: Wu-Manber search for word windows of test items.

Symbols are words. The patterns are all windows of ten consecutive item words, and a whole
item where it has fewer. Patterns of one length are searched together. The shift table says,
for two adjacent words, how far the window may move before any pattern could end there; for two
words found in no pattern that is nearly a whole window. Where the shift is zero, the two
words are the suffix of some patterns; those are told apart by their first two words and then
compared word by word.

The search maps document rows where they lie: no shuffle and no join. Items reach the tasks in
blocks of bounded size; a larger benchmark takes several passes over the same rows, each adding
to the hits of the one before.

Null texts have no words; items without words have no window. Items without an id count for
the hit words but not as items. Repeated items count once. Empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.batches import filter_rows, map_rows, plain_words, raw

WINDOW = 10
#: Bytes of item text that one pass hands to the tasks; their tables take some hundred times that.
BLOCK_BYTES = 1 << 20

Item = tuple[int | None, bytes]


class Patterns:
    """Wu-Manber tables for the windows of some items."""

    def __init__(self, items: list[Item], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in plain_words(text)]
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if words else 0):
                windows.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
        self.tables = [self._table(m, found) for m, found in sorted(windows.items())]

    @staticmethod
    def _table(length: int, windows: dict[tuple[int, ...], set]) -> tuple:
        block = min(2, length)
        shift: dict[tuple[int, ...], int] = {}
        bucket: dict[tuple[int, ...], dict[tuple[int, ...], list]] = {}
        for words, items in windows.items():
            for end in range(block, length + 1):
                key = words[end - block : end]
                shift[key] = min(shift.get(key, length), length - end)
            prefixes = bucket.setdefault(words[length - block :], {})
            prefixes.setdefault(words[:block], []).append((words, items))
        return length, block, length - block + 1, shift, bucket

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """(first word, length, items) of every occurrence."""
        numbers = tuple(map(self.number.get, words, repeat(0)))
        n = len(numbers)
        for length, block, far, shift, bucket in self.tables:
            end, get = length, shift.get
            while end <= n:
                suffix = numbers[end - block : end]
                step = get(suffix, far)
                if step:
                    end += step
                    continue
                first = end - length
                for pattern, items in bucket[suffix].get(numbers[first : first + block], ()):
                    if numbers[first:end] == pattern:
                        yield first, length, items
                end += 1


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[Item]]:
    """The items' ids and texts in blocks of about ``limit`` bytes, one at a time on the driver.

    Items are dealt to blocks by a hash of their text. A single item above the limit makes its
    block larger.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // limit)
    for k in range(blocks):
        part = rows.filter(F.expr(f"pmod(xxhash64(text), {blocks}) = {k}")) if blocks > 1 else rows
        yield [(r["item_id"], r["text"].encode()) for r in part.collect()]


def _mark(hit: np.ndarray, found: set, patterns: Patterns, words: list[bytes]) -> None:
    for first, length, items in patterns.search(words):
        hit[first : first + length] = True
        found.update(items)


def _scan(docs: DataFrame, block: list[Item], window: int) -> DataFrame:
    """One pass: adds the hits of a block to the columns ``hit`` (packed bits) and ``items``."""

    def start() -> Callable[..., pa.RecordBatch]:
        patterns = Patterns(block, window)

        def work(ids, texts, hits, items):
            out_hits, out_items = [], []
            for text, hit, found in zip(raw(texts), hits.to_pylist(), items.to_pylist()):
                words = plain_words(text)
                mask = np.unpackbits(np.frombuffer(hit, np.uint8), count=len(words)) if hit else np.zeros(len(words), np.uint8)
                kept = set(found)
                _mark(mask, kept, patterns, words)
                out_hits.append(np.packbits(mask).tobytes() if mask.any() else b"")
                out_items.append(sorted(x for x in kept if x is not None))
            arrays = [ids, texts, pa.array(out_hits, pa.binary()), pa.array(out_items, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "hit", "items"])

        return work

    schema = "doc_id long, text string, hit binary, items array<long>"
    return map_rows(docs, ["doc_id", "text", "hit", "items"], start, schema)


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, hit, items) for every row: a packed bit for each word, and the items that occur."""
    frame = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.lit(b"").alias("hit"),
        F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("items"),
    )
    for block in item_blocks(items, limit):
        frame = _scan(frame, block, window)
    return frame


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def start():
        def work(ids, texts, hits, items):
            counts = [len(plain_words(t)) for t in raw(texts)]
            n_hit = [int(np.bitwise_count(np.frombuffer(h, np.uint8)).sum()) for h in hits.to_pylist()]
            named = [sorted(map(str, x)) for x in items.to_pylist()]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
            arrays = [
                ids,
                pa.array(counts, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in named], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array([n > 0 for n in n_hit], pa.bool_()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names)

        return work

    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return map_rows(occurrences(docs, items, window, limit), ["doc_id", "text", "hit", "items"], start, schema)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window occurs; all columns are kept."""
    for block in item_blocks(items, limit):

        def start(block=block):
            patterns = Patterns(block, window)
            return lambda texts: [next(patterns.search(plain_words(t)), None) is None for t in raw(texts)]

        docs = filter_rows(docs, ["text"], start)
    return docs
