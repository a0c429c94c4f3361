"""Hard negatives against a plain search, and the Strassen product against the plain one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factsieve.llm import hard_negatives
from factsieve.llm.hard_negatives import strassen

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, score string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (16, 64, 33), (70, 20, 9), (0, 4, 5), (5, 0, 4), (17, 17, 17)])
def test_strassen_equals_the_plain_product(shape):
    r = np.random.default_rng(sum(shape))
    a = r.integers(-(2**20), 2**20, shape[:2])
    b = r.integers(-(2**20), 2**20, shape[1:])
    assert (strassen(a, b, leaf=2) == a @ b).all()


def test_sums_that_wrap_on_the_way_leave_the_result_exact():
    a = np.array([[2**40, 1, 2**40, 3]] * 4)
    b = np.array([[2**22, -(2**22), 5, 1]] * 4).T.copy()
    assert (strassen(a * 1, b, leaf=1) == a @ b).all()


def plain(rows):
    """(anchor, positive, rank, negative, scores) by a search over all rows, told apart by place."""
    usable = []
    for place, (vec_id, label, vector, *_) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        usable.append((place, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    order = lambda e: (-e[0], e[1] is None, e[1] or 0)
    for place, vec_id, label, vector in usable:
        if vec_id is None or vec_id % 100:
            continue
        scored = [(sum(a * b for a, b in zip(vector, v)), i, own, p) for p, i, own, v in usable if p != place and len(v) == len(vector)]
        positives = sorted([(s, i) for s, i, own, _ in scored if own == label], key=order)[:5]
        for ps, positive in positives:
            window = [(s, i) for s, i, own, _ in scored if own != label and 80 * ps <= 100 * s <= 100 * ps]
            for rank, (s, i) in enumerate(sorted(window, key=order)[:5], 1):
                yield vec_id, positive, rank, i, ps, s


def check(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    found = hard_negatives.mine(hard_negatives.shifted_labels(table), F.col("vec_id") % 100 == 0)
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert text(found.collect()) == text(plain(rows))


def test_ties_nulls_repeated_rows_and_lengths(spark):
    r = np.random.default_rng(3)
    few = [[float(x) for x in r.choice([-0.5, 0, 0.25, 0.5], 6)] for _ in range(12)]  # many equal vectors
    rows = [(i, int(r.integers(0, 4)), few[int(r.integers(0, 12))], "x", "y") for i in range(0, 450, 3)]
    rows += rows[:40]
    rows += [
        (500, None, few[0], None, None), (600, 1, None, None, None), (None, 1, few[1], None, None),
        (None, 2, few[1], None, None), (700, 1, [0.5, None, 0.0, 0.0, 0.0, 0.0], None, None),
        (800, 1, [math.nan] * 6, None, None), (900, 1, [math.inf] * 6, None, None), (1000, 2, [], None, None),
        (1001, 2, [], None, None), (1002, 3, [], None, None), (1100, 2, [0.5, 0.5], None, None),
        (1101, 2, [0.5, 0.25], None, None), (1102, 1, [0.5, 0.25], None, None), (1200, -3, few[2], None, None),
    ]
    check(spark, rows)


def test_many_blocks(spark, monkeypatch):
    """Rows and anchors over several blocks, with long vectors of one hot label."""
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", 16 * 40)
    monkeypatch.setattr(hard_negatives, "TILE", 3)
    r = np.random.default_rng(5)
    rows = [(i * 10, 1 if i % 3 else int(r.integers(0, 9)), [float(x) for x in r.uniform(-0.1, 1, 16)], "", "") for i in range(300)]
    check(spark, rows)


def test_no_rows_no_anchors_and_no_positives(spark):
    check(spark, [])
    check(spark, [(1, 1, [0.5], "", ""), (2, 1, [0.5], "", "")])
    check(spark, [(100, 1, [0.5], "", ""), (2, 2, [0.5], "", "")])


def test_a_score_beyond_64_bits_is_an_error(spark):
    rows = spark.createDataFrame([(100, 1, [1e14], "", ""), (101, 1, [1e14], "", "")], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(rows, F.col("vec_id") % 100 == 0).collect()
