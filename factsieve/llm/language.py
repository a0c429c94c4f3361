"""Language identification by compression with per-language dictionaries.

A text is encoded with zstandard once per language, each time with that language's sample text
as raw-content dictionary; the language whose dictionary makes it smallest wins. Where the
margin to the next language is narrow the answer is rejected. Long texts are encoded block by
block, so that the dictionary counts for every part of a text and not for its start alone.

The dictionaries come from a bounded sample of labelled rows that are not held out: about
``samples`` ids of each language, chosen by a hash, of whose texts whole ones are taken until a
dictionary is full. A language that has only long texts is learned from a piece of each. Every
language is learned; its name and its dictionary reach the driver and each task, and a text is
encoded once for each. Texts are lower-cased and ASCII signs and digits blanked before both steps.

Null, empty and letterless texts get ``und``. Ties go to the first name in order and are
rejected. Rows without an id or language are not learned from but are predicted. With nothing
to learn from every text is ``und``. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.batches import filter_rows, map_rows

SAMPLES = 300
SAMPLE_TEXT_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 17
BLOCK_BYTES = 1 << 11
LEVEL = 3
#: Languages whose encoders a task holds at once, about 0.7 MB each; with more it builds them in turn for each batch.
CODERS = 200
#: A narrow margin: the best is less than this share smaller than the next.
MARGIN = 0.002
UNKNOWN = "und"

_BLANKED = bytes(0x20 if b < 0x61 or 0x7B <= b < 0x80 else b for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def fold(text: str) -> bytes:
    return text.lower().encode().translate(_BLANKED)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, samples: int = SAMPLES, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """The dictionary of each language, from whole texts of at most ``SAMPLE_TEXT_BYTES`` where it has any.

    Else from pieces of its texts that are at most as long and start at the first letter.
    """
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")
    rows = docs.filter(usable & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text")
    rows = rows.withColumn("short", F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    # of each language the share of hashes that holds about ``samples`` ids
    counts = rows.groupBy("lang").agg(
        F.approx_count_distinct(F.when(F.col("short"), F.col("doc_id"))).alias("n_short"),
        F.approx_count_distinct("doc_id").alias("n"),
    )
    n = F.when(F.col("n_short") > 0, F.col("n_short")).otherwise(F.col("n"))
    shares = counts.select("lang", (F.col("n_short") > 0).alias("short"), (F.lit(samples) / n).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    # four bytes a character at most
    piece = F.regexp_extract("text", rf"\p{{L}}[\s\S]{{0,{SAMPLE_TEXT_BYTES // 4 - 1}}}", 0)
    # the names of the languages reach the driver anyway, with their dictionaries
    picked = rows.join(F.broadcast(shares), ["lang", "short"]).filter(place < F.col("share"))
    picked = picked.select("lang", place.alias("place"), F.when(F.col("short"), F.col("text")).otherwise(piece).alias("text"))
    picked = picked.groupBy("lang", "place").agg(F.min("text").alias("text"))

    def fill(group: pa.Table) -> pa.Table:
        held = b""
        for _, text in sorted(zip(group["place"].to_pylist(), group["text"].to_pylist())):
            data = fold(text)
            if len(held) + len(data) < size and data not in held:
                held = data + b" " + held
        return pa.table([group["lang"].slice(0, 1), pa.array([held], pa.binary())], ["lang", "data"])

    filled = picked.groupBy("lang").applyInArrow(fill, "lang string, data binary").collect()
    found = {row["lang"]: bytes(row["data"]) for row in filled}
    return {name: held for name, held in sorted(found.items()) if held.strip()}


def judge_all(dictionaries: dict[str, bytes], level: int = LEVEL) -> Callable[[pa.Array], list[tuple[str, float]]]:
    """A function from texts to (language, score) each: the score is the margin to the next, 0 to 1.

    Texts are taken out of their Arrow column one at a time, so a task holds its batch once.
    """

    def coders(names: list[str]) -> list[tuple[str, Callable[[bytes], bytes]]]:
        found = []
        for name in names:
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            coder = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False)
            found.append((name, coder.compress))
        return found

    parts = [list(dictionaries)[i : i + CODERS] for i in range(0, len(dictionaries), CODERS)]
    kept = coders(parts[0]) if len(parts) == 1 else None

    def answers(texts: pa.Array) -> list[tuple[str, float]]:
        least: list[list[tuple[int, str]]] = [[] for _ in texts]
        for part in parts:
            encoders = kept or coders(part)
            for sizes, text in zip(least, (t.as_py() for t in texts)):
                if text and _LETTER.search(text):
                    data = fold(text)
                    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
                    sizes += [(sum(len(encode(b)) for b in blocks), name) for name, encode in encoders]
                    sizes.sort()
                    del sizes[2:]
        return [verdict(sizes) for sizes in least]

    def verdict(sizes: list[tuple[int, str]]) -> tuple[str, float]:
        if not sizes:
            return UNKNOWN, 0.0
        return sizes[0][1], 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]

    return answers


def judge(dictionaries: dict[str, bytes], level: int = LEVEL) -> Callable[[str | None], tuple[str, float]]:
    """As ``judge_all`` for one text."""
    answers = judge_all(dictionaries, level)
    return lambda text: answers(pa.array([text], pa.string()))[0]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score, rejected."""

    def start():
        answers = judge_all(dictionaries)

        def work(ids, out, texts):
            found = answers(texts)
            names, scores = ([f[k] for f in found] for k in (0, 1))
            arrays = [ids, out, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

        return work

    key = F.col("doc_id").cast("long")
    frame = docs.select(key.alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    found = map_rows(frame, ["doc_id", "held_out", "text"], start, schema)
    return found.withColumn("rejected", F.expr(f"lang_pred = '{UNKNOWN}' OR score < {margin}D"))


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is told with more than a narrow margin; all columns are kept."""

    def start():
        answers = judge_all(dictionaries)

        def keep(texts):
            return [name != UNKNOWN and score >= margin for name, score in answers(texts)]

        return keep

    return filter_rows(docs, ["text"], start)
