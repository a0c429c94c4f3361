"""A Merkle manifest of documents: a tree of hashes per language, one root over all of them.

Cogrouped subtree exchange. Every document is a leaf; a block is ``SPAN`` consecutive leaves of a
language. Blocks are reduced to one node each, these in turn, until every language has one node; the
languages' nodes are reduced the same way to the root. On the way back down each block is cogrouped
with one row of outer nodes, the siblings of its path up to the root, which is all that its leaves
need to finish their proofs and to fold them. No task sees more than a block and one path, whatever
the size of a language.

Defined results: a null field hashes as ``-``. Leaves ascend by doc_id, null first; of equal ids by
the leaf's hash, and fully equal rows are interchangeable. A row without doc_id has a leaf and a proof
like any other and is never tampered with. A text of any length is hashed inside the JVM. An empty
table gives no rows. Columns other than the five that are hashed are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.storage import checkpointed

#: Nodes that become their parent's hash.
FAN = 8
#: Levels that a block reduces at once.
LEVELS = 3
#: Leaves (or nodes) of a block.
SPAN = FAN**LEVELS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NODE = "lane string, pos long, n long, digest string"
_PATH = "lane string, pos long, lefts array<string>, rights array<string>, subroot string, root string"
_PROOF = (
    "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def tree_hash(digests: list[str]) -> str:
    """Hash of the digests' hex text, one after the other."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hash of a document's fields, each with its length in bytes; null is ``-``."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def lowered_text() -> Column:
    """The tampering that the manifest's query detects: A-Z lower-cased in every third document."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate("text", _UPPER, _UPPER.lower())).otherwise(F.col("text"))


def placed(rows: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """Rows with their place ``pos`` (from 0) in the order of their lane and the lane's size ``n``.

    Rows are dealt to tasks by range, numbered inside a range, and the sizes of a lane's earlier
    ranges, one row each, are added. A lane of any size, or of equal rows, is spread over ranges.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = checkpointed(tied.repartitionByRange(lane, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(lane).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(lane, "_part").agg(F.count("*").alias("_size"))
    sizes = sizes.select(
        lane,
        "_part",
        F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(lane)).alias("n"),
    )
    row = F.row_number().over(Window.partitionBy(lane, "_part").orderBy(*order, "_tie"))
    numbered = dealt.withColumn("_row", row - 1).join(sizes, [lane, "_part"])
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_row")).alias("pos"), "n")


def _levels(digests: list[str], n: int) -> list[list[str]]:
    """A block's levels, its own nodes first, up to the one node of the lane or of the block."""
    levels = [digests]
    while n > 1 and len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([tree_hash(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        n = -(-n // FAN)
    return levels


def _siblings(levels: list[list[str]], i: int) -> Iterator[tuple[str, str]]:
    """What stands to the left and right of a node in its run, level by level."""
    for level in levels[:-1]:
        first = i - i % FAN
        yield "".join(level[first:i]), "".join(level[i + 1 : first + FAN])
        i //= FAN


def _block() -> Column:
    return F.floor(F.col("pos") / SPAN).alias("block")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks, and so on until every lane has one node."""

    def reduced(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iloc[0])
        top = _levels(block.sort_values("pos")["digest"].tolist(), n)[-1]
        return pd.DataFrame({"lane": [key[0]], "pos": [key[1]], "n": [-(-n // SPAN)], "digest": top})

    layers = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        below = layers[-1].select("lane", "pos", "n", "digest")
        layers.append(checkpointed(below.groupBy("lane", _block()).applyInPandas(reduced, _NODE)))
        largest = -(-largest // SPAN)
    return layers


def _exchanged(nodes: DataFrame, outer: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Blocks of nodes cogrouped with the one row of outer nodes that each block needs."""

    def joined(key: tuple, block: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        block, path = block.sort_values("pos"), path.iloc[0]
        levels = _levels(block["digest"].tolist(), int(block["n"].iloc[0]))
        around = list(zip(path["lefts"], path["rights"]))
        paths = [[*_siblings(levels, i), *around] for i in range(len(block))]
        return finish(block, path, paths)

    blocks = nodes.groupBy("lane", _block())
    return blocks.cogroup(outer.groupBy("lane", F.col("pos").alias("block"))).applyInPandas(joined, schema)


def _longer(block: pd.DataFrame, outer: pd.Series, paths: list) -> pd.DataFrame:
    """The path of every node of a block."""
    return pd.DataFrame(
        {
            "lane": block["lane"],
            "pos": block["pos"],
            "lefts": [[left for left, _ in p] for p in paths],
            "rights": [[right for _, right in p] for p in paths],
            "subroot": outer["subroot"],
            "root": outer["root"],
        }
    )


def _of_languages(block: pd.DataFrame, outer: pd.Series, paths: list) -> pd.DataFrame:
    """The path of every language, as the single node of a lane of its own."""
    found = _longer(block, outer, paths)
    return found.assign(lane=block["name"], pos=0, subroot=block["digest"])


def _proven(block: pd.DataFrame, outer: pd.Series, paths: list) -> pd.DataFrame:
    """Proofs of a block's leaves, each folded from the leaf as it is found now."""
    folded = []
    for now, path in zip(block["seen"], paths):
        for left, right in path:
            now = hashlib.sha256(f"{left}{now}{right}".encode()).hexdigest()
        folded.append(now)
    return pd.DataFrame(
        {
            "doc_id": block["doc_id"],
            "leaf": block["digest"],
            "subroot": outer["subroot"],
            "root": outer["root"],
            "proof_sha256": [tree_hash([left + right for left, right in p]) for p in paths],
            "folded_root": folded,
            "verified": [f == outer["root"] for f in folded],
        }
    )


def _down(layers: list[DataFrame], outer: DataFrame, finish: Callable, schema: str) -> DataFrame:
    for layer in reversed(layers[1:-1]):
        outer = _exchanged(layer, outer, _longer, _PATH)
    return _exchanged(layers[0], outer, finish, schema)


def manifest(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """One row per document: leaf, subroot of its language, root, hash of its proof, and its check.

    ``found_text`` is the text as it is found when the manifest is checked later, an expression over
    the documents' columns (by default the text itself). ``folded_root`` is the root that the leaf
    found then and the original siblings give, ``verified`` whether that is the root.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    found = F.col("text") if found_text is None else found_text
    hashed = docs.select(
        *columns, found.alias("_found"), leaf_hash(*[F.col(c) for c in columns]).alias("digest")
    ).select(
        F.col("doc_id"),
        # sorts like the language in UTF-8, null first, and is never null itself
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("lane"),
        "digest",
        F.when(F.col("_found").eqNullSafe(F.col("text")), F.col("digest"))
        .otherwise(leaf_hash(*[F.col(c) for c in columns[:-1]], F.col("_found")))
        .alias("seen"),
    )
    leaves = checkpointed(placed(checkpointed(hashed), "lane", ["doc_id", "digest"]))
    layers = _climb(leaves.withColumn("doc_id", F.col("doc_id").cast("string")))

    subroots = layers[-1].select(F.lit("").alias("lane"), F.col("lane").alias("name"), "digest")
    languages = _climb(checkpointed(placed(subroots, "lane", ["name"])))
    root = languages[-1].select(
        "lane",
        "pos",
        F.array().cast("array<string>").alias("lefts"),
        F.array().cast("array<string>").alias("rights"),
        F.lit("").alias("subroot"),
        F.col("digest").alias("root"),
    )
    paths = _down(languages, root, _of_languages, _PATH)
    proven = _down(layers, paths, _proven, _PROOF)
    return proven.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
