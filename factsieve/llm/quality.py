"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text is read as runs of word characters and of signs. A word stands for its shape (number,
capitals, capitalised, other) or for "same as before", a sign run for itself; so a small labelled
sample is enough whatever the language. The one-, two- and three-grams of these are hashed into buckets.
The raw model counts them over all documents, the target model over a bounded sample of
documents labelled good. A document's log weight is the sum of log(target / raw) over its
n-grams. Adding Gumbel noise and taking the k largest keys draws k documents without
replacement, in proportion to their weights.

``k`` follows from the data: raw text is a mixture of which the labelled share p is target
text, so p times the weight, at most one, is the chance that a document belongs to the target;
k is the sum of these chances. The k-th largest key is found exactly by counting key digits, with
no global sort.

Texts without n-grams (null, empty, blank) have a null weight and are never drawn. Noise
comes from a hash of the id, so repeated rows share their fate, and ties with the k-th key
are all drawn. Without labelled good documents nothing is known: every text with n-grams is
drawn. Null ids take part. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.batches import filter_rows, map_rows, raw
from factsieve.llm.storage import checkpointed

BUCKET_BITS = 14
#: Labelled good documents whose n-grams make up the target model.
TARGET_DOCUMENTS = 5000
SEED = 20
_DIGIT = 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)
# Kinds of byte: 0 white space, 1 a-z, 2 A-Z, 3 digit, 4 part of a non-ASCII character, 5 sign.
_KIND = np.array(
    [
        0 if b in b" \t\n\r\v\f" else 4 if b >= 0x80 else 3 if chr(b).isdigit() else 1 if chr(b).islower() else 2 if chr(b).isupper() else 5
        for b in range(256)
    ],
    np.uint8,
)
_POWER = np.cumprod(np.full(64, _PRIME, np.uint64))


def shapes(text: bytes | None) -> np.ndarray:
    """One code per run of a text: 1 to 4 for word shapes, 5 for a repeat, a hash for signs."""
    data = np.frombuffer(text or b"", np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    kind = _KIND[data]
    group = np.where(kind == 5, 2, kind > 0)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    length = np.diff(np.r_[starts, len(data)])
    place = (np.arange(len(data)) - np.repeat(starts, length)) & 63
    name = np.add.reduceat(_POWER[place] * (data + np.uint64(1)), starts)
    small, large = (np.add.reduceat((kind == k).astype(np.int64), starts) for k in (1, 2))
    number = np.add.reduceat((kind == 3).astype(np.int64), starts) == length
    capital = (small == 0) & (large > 0) & (length > 1)
    code = np.where(number, 1, np.where(capital, 2, np.where(kind[starts] == 2, 3, 4))).astype(np.uint64)
    code = np.where(group[starts] == 2, name | np.uint64(1 << 63), code)
    full = group[starts] > 0
    code, name = code[full], name[full]
    code[1:][name[1:] == name[:-1]] = 5
    return code


def buckets(text: bytes | None) -> np.ndarray:
    """The bucket of every one-, two- and three-gram of a text's codes."""
    one = shapes(text) * _PRIME + np.uint64(1)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * _PRIME + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * _PRIME + one[2:]
    mixed = np.concatenate([one, two, three])
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    """Log ratio of each bucket, and the share of good documents among the labelled ones."""

    ratio: np.ndarray | None
    share: float

    def key(self, doc_id: int | None, text: bytes | None) -> tuple[float | None, int, float | None]:
        """(log weight, n-grams, Gumbel key) of a document."""
        found = buckets(text)
        if not len(found):
            return None, 0, None
        weight = float(self.ratio[found].sum()) if self.ratio is not None else 0.0
        uniform = (xxhash.xxh64_intdigest(str(doc_id), SEED) + 0.5) / 2.0**64
        return weight, len(found), weight - math.log(-math.log(uniform))


def fit(docs: DataFrame, labels: DataFrame, sample: int = TARGET_DOCUMENTS) -> Model:
    """Count both models in one pass over the texts; only ids of the sample and bucket sums reach the driver."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    good = known.filter("quality = 1").select("doc_id").distinct()
    target = frozenset(r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect())
    if not target:
        return Model(None, 1.0)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                found = np.bincount(buckets(text), minlength=0)
                both[0, : len(found)] += found
                if doc_id in target:
                    both[1, : len(found)] += found
        at = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, both[0, at], both[1, at])], ["bucket", "r", "t"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "bucket long, r long, t long")
    sums = rows.groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).collect()
    counts = np.zeros((2, 1 << BUCKET_BITS))
    for row in sums:
        counts[:, row["bucket"]] = row["r"], row["t"]
    common = (counts[0] + 1) / (counts[0].sum() + len(counts[0]))
    # where the sample says little, the target model falls back on the raw one
    chosen = (counts[1] + len(common) * common) / (counts[1].sum() + len(common))
    return Model(np.log(chosen) - np.log(common), share)


def _ordered(key: float) -> int:
    """A long that sorts as the double does."""
    bits = int(np.float64(key).view(np.int64))
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def weights(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id, log_weight, n_grams, gumbel_key, and the key's digits."""

    def start():
        def work(ids, texts):
            found = [model.key(d, t) for d, t in zip(ids.to_pylist(), raw(texts))]
            weight, n, key = ([f[k] for f in found] for k in range(3))
            digits = [None if k is None else _ordered(k) for k in key]
            kinds = (pa.float64(), pa.int64(), pa.float64(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip((weight, n, key, digits), kinds)]
            return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "log_weight", "n_grams", "gumbel_key", "digits"])

        return work

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, log_weight double, n_grams long, gumbel_key double, digits long"
    return map_rows(frame, ["doc_id", "text"], start, schema)


def threshold(keyed: DataFrame, share: float) -> int | None:
    """The digits of the k-th largest key, by counting 16 bits at a time; None if nothing is drawn."""
    drawn = keyed.filter("digits IS NOT NULL")
    chance = F.least(F.lit(0.0), F.lit(math.log(share) if share else -1e9) + F.col("log_weight"))
    k = round(drawn.agg(F.sum(F.exp(chance))).first()[0] or 0.0)
    if k < 1:
        return None
    found, rest = 0, drawn
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        digit = F.shiftright("digits", shift)
        rows = rest.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()
        for row in sorted(rows, key=lambda r: -r["d"]):
            if row["n"] >= k:
                break
            k -= row["n"]
        found = row["d"]
        rest = rest.filter(digit == found)
    return found


def resample(docs: DataFrame, labels: DataFrame, sample: int = TARGET_DOCUMENTS) -> DataFrame:
    """One row per document row: doc_id, log_weight, n_grams, gumbel_key, sampled."""
    model = fit(docs, labels, sample)
    keyed = checkpointed(weights(docs, model))
    least = threshold(keyed, model.share)
    drawn = F.coalesce(F.col("digits") >= least, F.lit(False)) if least is not None else F.lit(False)
    return keyed.withColumn("sampled", drawn).drop("digits")


def sampled(docs: DataFrame, labels: DataFrame, sample: int = TARGET_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` that are drawn; all columns are kept."""
    model = fit(docs, labels, sample)
    least = threshold(checkpointed(weights(docs, model).select("log_weight", "digits")), model.share)

    def start() -> Callable[..., list[bool]]:
        def keep(ids, texts):
            keys = (model.key(None if d is None else int(d), t)[2] for d, t in zip(ids.to_pylist(), raw(texts)))
            return [least is not None and k is not None and _ordered(k) >= least for k in keys]

        return keep

    return filter_rows(docs, ["doc_id", "text"], start)
