"""Hard negatives by exact integer scores: Strassen products of tiles, then mergeable top lists.

Vectors become integers; anchors and rows are dealt to blocks, and each pair of blocks is one task's
work: the scores of its anchors against its rows, as a recursive Strassen product of int64 tiles.
From each product an anchor keeps its best rows of the same label, and in a second pass, for every
positive found, the best rows of other labels inside that positive's window of scores. Lists
of blocks merge by score and id, so only the best few of each pair of blocks are ever shuffled.

The first pass also groups by label, so only same-label tiles are multiplied there. Rows of a block
are dealt by a row number of their own: equal vectors, labels or ids of any number are spread.

Defined results: a row without label or vector, or with a component that is null or not finite, takes
no part. Rows are told apart by place, not by id: of repeated rows each is a row (and an anchor) of
its own, and equal lines of the result may repeat. Ties go to the smaller id, a missing id last; it
can be a positive or negative, not an anchor. Vectors of different lengths have no score with each
other; all vectors of length zero score zero. Scores must fit 64 bits (sums on the way may wrap, as
int64 arithmetic is exact modulo 2 ** 64); a tile in which one might not is an error. No rows, no
anchors or no positives give no rows. Columns other than id, label and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.storage import checkpointed

#: Below this side a product is not split further.
LEAF = 8
#: Components of a block of rows or anchors at most; bounds a task's memory.
BLOCK_COMPONENTS = 1 << 20
#: Rows are dealt to so many blocks at least, where there are enough of them.
BLOCKS = 64
#: Anchors multiplied at once.
TILE = 256

_POSITIVE = "anchor_row long, anchor_id long, score long, vec_id long, row long"
_NEGATIVE = (
    "anchor_row long, anchor_id long, no int, positive_id long, positive_score long, negative_id long, negative_score long"
)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The matrix product by seven half-size products; odd sides are padded with zeros."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    if rows % 2 or inner % 2 or columns % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    (a11, a12), (a21, a22) = (np.hsplit(half, 2) for half in np.vsplit(a, 2))
    (b11, b12), (b21, b22) = (np.hsplit(half, 2) for half in np.vsplit(b, 2))
    diagonal = strassen(a11 + a22, b11 + b22, leaf)
    low_left = strassen(a21 + a22, b11, leaf)
    up_right = strassen(a11, b12 - b22, leaf)
    back_left = strassen(a22, b21 - b11, leaf)
    back_right = strassen(a11 + a12, b22, leaf)
    low = strassen(a21 - a11, b11 + b12, leaf)
    up = strassen(a12 - a22, b21 + b22, leaf)
    top = np.hstack([diagonal + back_left - back_right + up, up_right + back_right])
    bottom = np.hstack([low_left + back_left, diagonal - low_left + up_right + low])
    return np.vstack([top, bottom])[:rows, :columns]


def integers(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Equally long vectors as a matrix of floor(scale * x)."""
    vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten(), np.float64)
    whole = np.floor(scale * flat)
    if whole.size and np.abs(whole).max() >= 2.0**62:
        raise ValueError("a scaled component does not fit 64 bits")
    return whole.astype(np.int64).reshape(len(vectors), -1)


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    largest = [max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0 for m in (a, b)]
    return largest[0] * largest[1] * a.shape[1] < 1 << 63


def _ids(table: pa.Table, name: str) -> np.ndarray:
    """Ids for sorting; a missing one comes last."""
    return np.asarray(table.column(name).fill_null(np.iinfo(np.int64).max), np.int64)


def _best(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k places of ``among`` with the highest scores; equal ones in the order given."""
    if len(among) > k:
        own = scores[among]
        among = among[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return among[np.argsort(-scores[among], kind="stable")][:k]


def _tiles(anchors: DataFrame, rows: DataFrame, keys: list[str], scale: float, pick: Callable, schema: str) -> DataFrame:
    """Score every pair of an anchor block and a row block; ``pick`` gets a tile's anchors, rows and scores."""
    kind = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (f.split() for f in schema.split(", "))])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        left = left.rename_columns([c.removeprefix("a_") for c in left.column_names])
        if len(left) and len(right):
            right = right.take(np.lexsort([_ids(right, "row"), _ids(right, "vec_id"), np.asarray(right["vec_id"].is_null())]))
            a, b = integers(left["vector"], scale), integers(right["vector"], scale).T
            if not _fits(a, b):
                raise ValueError("a score might not fit 64 bits")
            for start in range(0, len(left), TILE):
                part = left.slice(start, TILE)
                found += pick(part, right, strassen(a[start : start + TILE], b))
        return pa.Table.from_pylist([dict(zip(kind.names, row)) for row in found], kind)

    # both sides come from one table; the anchors' columns get names of their own
    by = ["anchor_block", "row_block", "length", *keys]
    own = anchors.withColumnsRenamed({c: f"a_{c}" for c in anchors.columns})
    return own.groupBy(*[f"a_{c}" for c in by]).cogroup(rows.groupBy(*by)).applyInArrow(work, schema)


def _merged(found: DataFrame, by: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The k best of each list, from the lists of all blocks; limited in each task before the shuffle."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return found.withColumn(rank, best).filter(F.col(rank) <= k)


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    scale: float = 256.0,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives, best first.

    ``vectors`` has vec_id, label and embedding; ``anchor`` tells which rows are anchors. Positives
    are the best other rows of the anchor's label, negatives the best rows of other labels that
    score from ``low_percent`` of the positive's score up to that score.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = checkpointed(
        usable.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"),
            F.col("embedding").alias("vector"),
            F.size("embedding").alias("length"),
            F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    size = rows.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max("length"), F.lit(0))).first()
    most = max(1, BLOCK_COMPONENTS // max(1, size[2]))
    row_blocks = max(1, -(-size[0] // most), min(BLOCKS, size[0] // 128))
    anchor_blocks = max(1, -(-size[1] // max(1, most // 4)))
    own = F.xxhash64("row")

    def each(name: str, blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)

    asked = rows.filter("is_anchor").withColumn("anchor_block", F.pmod(own, F.lit(anchor_blocks)).cast("int"))
    asked = asked.withColumnsRenamed({"vec_id": "anchor_id", "row": "anchor_row"}).drop("is_anchor")
    dealt = rows.drop("is_anchor").withColumn("row_block", F.pmod(own, F.lit(row_blocks)).cast("int"))
    dealt = dealt.select("*", each("anchor_block", anchor_blocks))

    def best_positives(part: pa.Table, table: pa.Table, scores: np.ndarray) -> list[tuple]:
        ids, places = table["vec_id"].to_pylist(), np.asarray(table["row"])
        out = []
        for own, anchor_id, line in zip(part["anchor_row"].to_pylist(), part["anchor_id"].to_pylist(), scores):
            for j in _best(line, np.flatnonzero(places != own), positives):
                out.append((own, anchor_id, int(line[j]), ids[j], int(places[j])))
        return out

    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("row")]
    found = _tiles(asked.select("*", each("row_block", row_blocks)), dealt, ["label"], scale, best_positives, _POSITIVE)
    # a join by the anchor follows; at most ``positives`` entries each
    lists = (
        _merged(found, ["anchor_row"], order, positives, "no")
        .groupBy("anchor_row")
        .agg(F.collect_list(F.struct("no", "vec_id", "score")).alias("positives"))
    )
    windowed = checkpointed(asked.join(lists, "anchor_row"))

    def best_negatives(part: pa.Table, table: pa.Table, scores: np.ndarray) -> list[tuple]:
        ids, labels = table["vec_id"].to_pylist(), np.asarray(table["label"])
        out = []
        for own, line in zip(part.to_pylist(), scores):
            bounds = [(-(-low_percent * p["score"] // 100), p["score"]) for p in own["positives"]]
            low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
            among = np.flatnonzero((labels != own["label"]) & (line >= low) & (line <= high))
            for p, (low, high) in zip(own["positives"], bounds):
                inside = among[(line[among] >= low) & (line[among] <= high)]
                for j in _best(line, inside, negatives):
                    out.append(
                        (own["anchor_row"], own["anchor_id"], p["no"], p["vec_id"], p["score"], ids[j], int(line[j]))
                    )
        return out

    order = [F.desc("negative_score"), F.col("negative_id").asc_nulls_last()]
    hard = _tiles(windowed.select("*", each("row_block", row_blocks)), dealt, [], scale, best_negatives, _NEGATIVE)
    ranked = _merged(hard, ["anchor_row", "no"], order, negatives, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """The labels that the mining query is specified with: every seventh id takes the next label of ten."""
    label = F.col("label").cast("long")
    return vectors.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding"
    )
