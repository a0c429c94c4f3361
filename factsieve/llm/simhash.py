"""Near-duplicates by SimHash: a self-join of binary tries over the fingerprints.

A fingerprint takes the majority of each bit over the hashes of all word shingles. Two
fingerprints link when few bits differ. With a budget of three bits, one of four 16-bit quarters
agrees in full; so there are four tries, each reading another quarter first, and node pairs
are followed only inside a subtree whose first quarter is equal. Subtrees are dealt to tasks
by quarter and value. Within a task the trie is joined with itself: pairs of nodes go down
together, differing bits add up, and a pair over budget is dropped with all below it.

A subtree with more fingerprints than one task's share is not kept whole: the same argument
applies to its remaining 48 bits (four sixths of 12), so its fingerprints go to four smaller
subtrees each, by the sixth that agrees, and once more for the remaining 36 bits (of 9 each).

Null ids take part and null texts count as empty; a class of which no row has an id has a null
component. Texts of any length are hashed whole. Texts without words have fingerprint zero and link
like any other. Repeated rows give repeated rows, equal fingerprints are one node, an empty table gives
no rows. Only doc_id and text are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.batches import map_rows, raw, spaced_words
from factsieve.llm.components import components
from factsieve.llm.storage import checkpointed

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Subtrees up to this size are never split; above it, one task's share of the rows decides.
SUBTREE = 1024
_STEP = 1 << 16
_BLOCK = 1 << 18
_LEAF = 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; zero if it has no words."""
    words = spaced_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = ([0] + (ends + 1).tolist())[: max(1, len(words) - shingle + 1)]
    last = ends.tolist()[min(shingle, len(words)) - 1 :]
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(first), _STEP):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(first[i : i + _STEP], last[i : i + _STEP])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(first)).tobytes(), "big")


def _row_key() -> Column:
    return F.expr("coalesce(CAST(doc_id AS BIGINT), 4611686018427387904 + (xxhash64(text) & 2305843009213693951))")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, others: Sequence[str] = ()) -> DataFrame:
    """(doc_id, row_key, code) for every row; ``code`` holds the fingerprint's bits as a signed long.

    ``row_key`` is the id, or for a null id a number above 2**62 drawn from the text. The long columns ``others`` are kept.
    """
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), F.col("text"), *others)

    def start():
        def work(ids, keys, texts, *rest):
            codes = np.array([fingerprint(t, shingle) for t in raw(texts)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([ids, keys, pa.array(codes), *rest], ["doc_id", "row_key", "code", *others])

        return work

    schema = ", ".join(f"`{c}` long" for c in ["doc_id", "row_key", "code", *others])
    return map_rows(frame, ["doc_id", "row_key", "text", *others], start, schema)


def _halves(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the bit turns to one in each range of sorted codes that agree above it."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        wide = lo < hi
        if not wide.any():
            return lo
        middle = (lo + hi) >> 1
        one = (codes[np.minimum(middle, len(codes) - 1)] & bit) != 0
        hi = np.where(wide & one, middle, hi)
        lo = np.where(wide & ~one, middle + 1, lo)


def trie_join(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int) -> Iterator:
    """Index pairs (i < j) of codes within ``budget`` bits and inside the same subtree.

    A subtree is a range of sorted codes that agree in the first ``depth`` bits, and so is
    every node below. Node pairs are taken from a stack in blocks of bounded size, so memory
    does not grow with the pairs. Pairs of a few codes are compared directly.
    """
    stack = [(starts, ends, starts, ends, np.zeros(len(starts), np.int64), depth)]
    while stack:
        a0, a1, b0, b1, diff, depth = stack.pop()
        if len(a0) > _BLOCK:
            half = len(a0) // 2
            stack.append((a0[half:], a1[half:], b0[half:], b1[half:], diff[half:], depth))
            a0, a1, b0, b1, diff = a0[:half], a1[:half], b0[:half], b1[:half], diff[:half]
        own = a0 == b0
        small = ((a1 - a0) * (b1 - b0) <= _LEAF) | (depth == 64)
        if small.any():
            across = (b1 - b0)[small]
            size = (a1 - a0)[small] * across
            pair = np.repeat(np.arange(len(size)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i = a0[small][pair] + place // across[pair]
            j = b0[small][pair] + place % across[pair]
            near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
            keep = near & (~own[small][pair] | (i < j))
            if keep.any():
                yield i[keep], j[keep]
            a0, a1, b0, b1, diff, own = (x[~small] for x in (a0, a1, b0, b1, diff, own))
        if not len(a0):
            continue
        bit = np.uint64(1 << (63 - depth))
        am, bm = _halves(codes, a0, a1, bit), _halves(codes, b0, b1, bit)
        cross = ~own  # of a node with itself, one order of the two halves is enough
        parts = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + 1),
            (am[cross], a1[cross], b0[cross], bm[cross], diff[cross] + 1),
        ]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts))
        keep = (a1 > a0) & (b1 > b0) & (diff <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        if keep.any():
            stack.append((a0[keep], a1[keep], b0[keep], b1[keep], diff[keep], depth + 1))


def connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i and j in place; a class has its smallest index as label."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _rotate(codes: np.ndarray, shift: int) -> np.ndarray:
    if not shift:
        return codes
    return (codes << np.uint64(shift)) | (codes >> np.uint64(64 - shift))


def _subtrees(codes: DataFrame) -> DataFrame:
    """Four rows a code: the quarter that must agree, as an id that holds its place and value."""
    quarters = [
        F.expr(f"struct(CAST({k} AS INT) AS trie, CAST(shiftrightunsigned(code, {48 - 16 * k}) & 65535 AS LONG) AS node)")
        for k in range(4)
    ]
    return codes.select("code", F.explode(F.array(*quarters)).alias("s")).select("code", "s.trie", "s.node")


def _refine(rows: DataFrame, width: int, level: int) -> DataFrame:
    """Split subtrees: of the bits not yet equal, one of four parts of ``width`` bits must agree too.

    ``trie`` and ``node`` of a split subtree hash the old ones with the part and its value.
    ``rest`` holds the bits not yet equal; the part that must agree is cut out of it.
    """
    rest = F.col("rest")
    parts = [
        F.struct(
            F.lit(k).alias("part"),
            F.shiftrightunsigned(rest, width * (3 - k)).bitwiseAND((1 << width) - 1).alias("value"),
            # the other three parts, closed up
            F.shiftrightunsigned(rest, width * (4 - k))
            .bitwiseAND((1 << (width * k)) - 1)
            .alias("high"),
            rest.bitwiseAND((1 << (width * (3 - k))) - 1).alias("low"),
            F.lit(width * (3 - k)).alias("low_width"),
        )
        for k in range(4)
    ]
    split = rows.select("code", "trie", "node", F.explode(F.array(*parts)).alias("p"))
    return split.select(
        "code",
        (F.col("trie") * 4 + F.col("p.part") + 4 * level).alias("trie"),
        F.xxhash64("trie", "node", "p.part", "p.value").alias("node"),
        F.expr("p.high * CAST(power(2, p.low_width) AS BIGINT) + p.low").alias("rest"),
    )


def _heavy(rows: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Rows of subtrees of up to ``share`` codes, and the rest. Heavy subtrees are few: under rows / share."""
    sizes = rows.groupBy("trie", "node").agg(F.count("*").alias("n")).filter(F.col("n") > share).select("trie", "node")
    return rows.join(sizes, ["trie", "node"], "left_anti"), rows.join(sizes, ["trie", "node"], "left_semi")


def _join_tasks(rows: DataFrame, budget: int) -> DataFrame:
    """(a, b): a forest over the linked codes of each task, each subtree joined with itself."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for batch in batches]
        if not held:
            return
        code, trie, node = (np.concatenate(x) for x in zip(*held))
        for kind in np.unique(trie):
            at = trie == kind
            shift = 16 * int(kind) if kind < 4 else 0  # the equal quarter comes first
            own, group = _rotate(code[at].view(np.uint64), shift), node[at]
            order = np.lexsort((own, group))
            own, group = own[order], group[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(own)]
            several = ends - starts > 1
            label = np.arange(len(own))
            for i, j in trie_join(own, starts[several], ends[several], 16 if kind < 4 else 0, budget):
                connect(label, i, j)
            linked = np.flatnonzero(label != np.arange(len(own)))
            if len(linked):
                a, b = (_rotate(own[x], (64 - shift) % 64).view(np.int64) for x in (linked, label[linked]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.select("code", "trie", "node").mapInArrow(task, "a long, b long")


def links(codes: DataFrame, budget: int = MAX_BITS, split: int = SUBTREE) -> DataFrame:
    """(a, b): codes that a chain of links within ``budget`` bits joins, enough to connect each class.

    ``codes`` holds distinct long codes in a column ``code``. The argument of the equal quarter
    needs a budget of at most three bits.
    """
    if not 0 <= budget <= 3:
        raise ValueError("the equal quarter needs a budget of 0 to 3 bits")
    spark = codes.sparkSession
    rows = _subtrees(codes)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = max(split, 4 * codes.count() // tasks)
    light, heavy = _heavy(rows, share)
    kept = [light.select("code", "trie", "node")]
    heavy = heavy.withColumn(
        "rest",
        F.expr(  # the other three quarters, closed up to 48 bits
            "CASE trie WHEN 0 THEN code & 281474976710655"
            " WHEN 1 THEN shiftleft(shiftrightunsigned(code, 48), 32) | (code & 4294967295)"
            " WHEN 2 THEN shiftleft(shiftrightunsigned(code, 32), 16) | (code & 65535)"
            " ELSE shiftrightunsigned(code, 16) END"
        ),
    )
    for level, width in ((1, 12), (2, 9)):
        rows = _refine(heavy, width, level)
        if level == 2:
            kept.append(rows.select("code", "trie", "node"))
            break
        light, heavy = _heavy(rows, share)
        kept.append(light.select("code", "trie", "node"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return _join_tasks(out.repartition("trie", "node"), budget).distinct()


def classes(prints: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """(code, component, component_id) for every distinct code: its group, and the smallest id reachable by links, if any has one."""
    least = checkpointed(prints.groupBy("code").agg(F.min("doc_id").alias("doc_id")))
    groups = components(links(least.select("code"), budget)).withColumnRenamed("node", "code")
    named = least.join(groups, "code", "left").withColumn("component", F.coalesce("component", "code"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "component").select("code", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """One row per document row: doc_id, row_key, fingerprint (16 hex digits), component_id."""
    prints = checkpointed(fingerprints(docs, shingle))
    named = prints.join(classes(prints, budget), "code", "left")
    return named.select(
        "doc_id",
        "row_key",
        F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` less all but one of each class: the one with the smallest id.

    Of several rows with that id the one with the smallest hash of all its columns stays, of repeated rows
    one. An id may stay once for each class that it occurs in. A row without an id stays only where no member
    of its class has one. All columns are kept.
    """
    own = "_key" + "_" * max(len(c) for c in docs.columns)  # no column of docs has this name
    hashed = own + "_"
    row_hash = F.xxhash64(*docs.columns)
    rows = docs.select("doc_id", "text", row_hash.alias(hashed))
    prints = checkpointed(fingerprints(rows, shingle, [hashed]))
    least = prints.groupBy("code").agg(F.min(F.struct("row_key", hashed)).alias("least"))
    least = least.join(classes(prints, budget), "code").groupBy("component").agg(F.min("least").alias("least"))
    keepers = least.select(F.col("least.row_key").alias(own), F.col(f"least.{hashed}").alias(hashed))
    kept = docs.withColumn(own, _row_key()).withColumn(hashed, row_hash).join(keepers, [own, hashed], "left_semi")
    return kept.dropDuplicates([own, hashed]).drop(own, hashed)
