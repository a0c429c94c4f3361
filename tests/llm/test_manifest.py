"""The Merkle manifest against a plain tree in Python, and its edge rules."""

import hashlib
import zlib

import pytest

from factsieve.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return None if text is None else text.translate({i: i + 32 for i in range(65, 91)})


def leaf(row, change=lambda t: t):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], change(row["text"])]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def plain_manifest(rows):
    lanes = {}
    for row in rows:
        lanes.setdefault(row["lang"], []).append(row)
    names = sorted(lanes, key=lambda n: (n is not None, (n or "").encode()))
    for rows in lanes.values():
        rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {n: tree([leaf(r) for r in lanes[n]]) for n in names}
    top = tree([trees[n][-1][0] for n in names])
    root = top[-1][0] if names else None
    for j, name in enumerate(names):
        for i, row in enumerate(lanes[name]):
            around = [*path(trees[name], i), *path(top, j)]
            chosen = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            now = leaf(row, lower) if chosen else leaf(row)
            for left, right in around:
                now = digest(left, now, right)
            proof = digest(*[left + right for left, right in around])
            yield row["doc_id"], leaf(row), trees[name][-1][0], root, proof, now, now == root


def in_order(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: tuple(str(v) for v in r))


def check(docs):
    found = merkle.manifest(docs, merkle.lowered_text())
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert in_order(found.collect()) == in_order(plain_manifest([r.asDict() for r in docs.collect()]))


def test_manifest_of_a_table_equals_a_plain_tree(spark, folder):
    check(spark.read.parquet(f"{folder}/documents.parquet"))


def test_nulls_long_texts_repeated_rows_and_clashing_columns(odd):
    check(odd.withColumnsRenamed({"score": "leaf", "length": "pos"}))


def test_empty_table(none):
    assert merkle.manifest(none).count() == 0


@pytest.mark.parametrize("size", [8, 65, 513])
def test_sizes_around_full_runs_and_blocks(spark, size):
    """One language that fills its runs and blocks, or exceeds them by one, beside two of one row."""
    check(
        spark.range(size).selectExpr(
            "id AS doc_id", "concat('Text ', id) AS text", "'en' AS lang", "'s' AS source", "id AS n_chars"
        ).unionByName(
            spark.createDataFrame(
                [(-1, "A", None, "s", 1), (9_007_199_254_740_993, "B", "Ω", None, None)],
                "doc_id long, text string, lang string, source string, n_chars long",
            )
        )
    )


def test_many_languages(spark):
    """More languages than one run, and than one block, holds."""
    check(
        spark.range(1400).selectExpr(
            "id AS doc_id", "concat('Text ', id) AS text", "concat('l', id % 700) AS lang", "'s' AS source", "id AS n_chars"
        )
    )


def test_every_change_of_a_leaf_is_found(spark):
    docs = spark.range(100).selectExpr(
        "id AS doc_id", "concat('Text ', id) AS text", "CAST(id % 3 AS STRING) AS lang", "'s' AS source", "id AS n_chars"
    )
    from pyspark.sql import functions as F

    changed = F.when(F.col("doc_id") == 41, F.lit("text 41")).otherwise(F.col("text"))
    found = merkle.manifest(docs, changed)
    assert [r["doc_id"] for r in found.filter("not verified").collect()] == [41]
    assert merkle.manifest(docs).filter("not verified").count() == 0
