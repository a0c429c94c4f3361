"""SimHash, trie join, components and the cover tree against brute force."""

import numpy as np
import pytest
import xxhash

from factsieve.llm import cover_tree, simhash
from factsieve.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, pairs):
    label = list(range(n))
    for i, j in pairs:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "A b C", "a b c a b c a b c", "É é x y z" * 40, "x\x0by\x1cz w q"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def some_codes(seed=1, groups=60):
    rng = np.random.default_rng(seed)
    out = {0, 1, 2**64 - 1}
    for base in rng.integers(0, 2**63, groups, dtype=np.uint64).tolist():
        for _ in range(8):
            code = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                code ^= 1 << bit
            out.add(code)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_join_finds_exactly_the_near_pairs(budget):
    codes = some_codes()
    found = set()
    for i, j in simhash.trie_join(codes, np.array([0]), np.array([len(codes)]), 0, budget):
        pairs = list(zip(i.tolist(), j.tolist()))
        assert not found & set(pairs) and len(set(pairs)) == len(pairs)
        found |= set(pairs)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= budget
    assert found == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


@pytest.mark.parametrize("split", [1, 4, 1024])
def test_split_subtrees_lose_no_link(spark, split):
    codes = some_codes(2, 30)
    signed = codes.view(np.int64).tolist()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000" if split < 1024 else old)
    try:
        edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"), 3, split).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    place = {c: k for k, c in enumerate(signed)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    want = classes(len(codes), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    assert classes(len(codes), [(place[e["a"]], place[e["b"]]) for e in edges]) == want


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (7, 200), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}}
    assert components(edges.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    assert sorted(r["fingerprint"] for r in rows) == sorted(f"{plain_fingerprint(t['text']):016x}" for t in texts)
    own = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert own[1] == 1 and own[3] == own[4] == own[5] == 3
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1, 3}
    assert simhash.near_duplicates(none).count() == 0


def test_one_document_of_each_class_stays(odd, none):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 3 in ids and None not in ids and 4 not in ids and 5 not in ids
    assert simhash.deduplicated(none).count() == 0


def test_an_id_with_two_texts_stays_once_for_each_class(spark):
    one, two = ("the quick brown fox jumps over a lazy dog " * 3).strip(), "eleven grey herons wait beside some frozen lake at dawn"
    rows = [(1, one), (1, two), (1, two), (2, one), (3, two), (None, one)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in kept) == sorted([(1, one), (1, two)])


def test_a_class_without_ids_has_no_component(spark):
    one, two = "the quick brown fox jumps over a lazy dog", "eleven grey herons wait beside some frozen lake at dawn"
    rows = [(None, one), (None, one), (7, two), (None, two)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (0, 0), (0, 7), (7, 7)]


def test_rows_that_differ_beside_id_and_text_are_settled_by_their_hash(spark):
    text = "the quick brown fox jumps over a lazy dog"
    rows = [(1, text, s) for s in ("a", "b", "c", "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [simhash.deduplicated(table.repartition(n, "source")).collect() for n in (1, 3, 7)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def brute_vectors(rows, threshold=0.95):
    units = [cover_tree.unit(v) for _, v in rows]
    pairs = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold
    ]
    label, links = classes(len(rows), pairs), [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    return sorted(((rows[i][0], links[i], least[label[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [4096, 16])
def test_cover_tree_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    bases = rng.normal(size=(12, 8))
    rows = [(k, (b + rng.normal(scale=s, size=8)).tolist()) for k, (b, s) in enumerate((b, s) for b in bases for s in (0, 0.02, 0.1, 0.2, 0.3))]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, None), (102, [0.0] * 8), (103, [1.0, None] + [0.0] * 6), (104, [float("nan")] * 8)]
    rows += [(105, []), (106, [1.0, 2.0]), (107, [2.0, 4.0]), (None, rows[5][1]), (108, [1e300] * 8), (109, [1e-300] * 8), (110, [float("inf")] * 8)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    found = cover_tree.near_duplicates(frame, block=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str) == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def test_cover_tree_of_no_rows(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nodes_nest_and_halve():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, level = cover_tree.cover_tree(x)
    assert sorted(order.tolist()) == list(range(300))
    for depth, radius in enumerate(cover_tree.RADII, 1):
        assert cover_tree.Nodes(x[order], level, depth).radius.max() <= radius + 1e-5


@pytest.mark.parametrize("threshold", [0.5, 0.95, 0.99, 1.0])
def test_balls_and_open_pairs_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(5)
    bases = rng.normal(size=(8, 8))
    rows = [(k, (bases[k % 8] + rng.normal(scale=(0.02, 0.08, 0.12)[k % 3], size=8)).tolist()) for k in range(160)]
    rows += [(k + 200, [2.0 * v for v in rows[k][1]]) for k in range(0, 160, 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = cover_tree.near_duplicates(frame, threshold, block=16).collect()
    if threshold < 1:  # there, rounding decides whether a vector links with its multiple
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str) == brute_vectors(rows, threshold)
    else:
        assert len(found) == len(rows)


def test_near_copies_meet_other_blocks_as_one_ball(spark, monkeypatch):
    rng = np.random.default_rng(6)
    bases = rng.normal(size=(5, 16))
    rows = [(k, (bases[k % 5] + rng.normal(scale=0.005, size=16)).tolist()) for k in range(600)]
    sent, meet, compare = [], cover_tree._ball_links, cover_tree._member_links
    monkeypatch.setattr(cover_tree, "_ball_links", lambda routed, *more: sent.append(routed.count()) or meet(routed, *more))
    monkeypatch.setattr(cover_tree, "_member_links", lambda opened, *more: sent.append(opened.count()) or compare(opened, *more))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = cover_tree.near_duplicates(frame, block=64).collect()
    assert {(r["n_links"], r["component_id"] % 5 == r["vec_id"] % 5) for r in found} == {(119, True)}
    assert sent[0] < len(rows) / 4 and sent[1] == 0


@pytest.mark.parametrize("same", [True, False])
def test_dual_join_in_small_steps(monkeypatch, same):
    monkeypatch.setattr(cover_tree, "_CHUNK", 50)
    rng = np.random.default_rng(7)

    def tree(n):
        x = rng.normal(size=(n, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        order, level = cover_tree.cover_tree(x)
        return x[order], level, rng.choice([0.0, 0.1], n)

    a = tree(300)
    b = a if same else tree(200)
    gap = np.sqrt(np.maximum(2 - 2 * a[0] @ b[0].T, 0))
    near = gap <= a[2][:, None] + b[2] + 0.3
    expected = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j or not same}
    steps = list(cover_tree.dual_join(a, b, same, 0.3))
    found = [pair for i, j in steps for pair in zip(i.tolist(), j.tolist())]
    assert len(found) == len(expected) and set(found) == expected
    assert max(len(i) for i, _ in steps) <= 50


def test_balls_lie_within_reach():
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 6)), 5, axis=0) + rng.normal(scale=0.05, size=(200, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for reach in (0.0, 0.1, 0.3, 1.0):
        order, start, radius = cover_tree.balls(x, reach)
        assert sorted(order.tolist()) == list(range(200)) and len(start) == len(radius)
        for ball in np.split(order, start[1:]):
            assert len(ball) == 1 or (x[ball] @ x[ball].T >= 1 - reach * reach / 2).all()
