"""Embedding near-duplicates by dual traversal of cover trees; the pairs are exact.

Vectors are scaled to length one, so a cosine of at least t is a distance of at most
d = sqrt(2 - 2 t). Pivots, a bounded sample of vectors, divide the space into cells; cells
are divided into blocks of about ``BLOCK`` vectors by a hash, so a group of copies of any size
fills many blocks. Each block becomes a cover tree: nested levels with halving radii, where every
node has a centre and a covering radius, the largest distance of its vectors to it.

The lowest nodes with several vectors have radii of at most d / 2, so all their vectors link with
each other. These balls take the place of their vectors: a cover tree is built over each block of
balls, and blocks of balls meet in pairs, each in a task of its own. A ball goes to the blocks of
another cell only if it can reach into it, by the cell's covering radius and by the plane half-way
between the pivots. Two trees are traversed together from the top: a pair of nodes whose centres are
farther apart than both radii plus d is dropped with all below; the others go on to their children,
down to balls. Balls that lie within d as a whole link with all their vectors, uncompared; balls of one
vector are compared in double precision. Only the balls that a block pair leaves open have
their vectors sent to it and compared there, in double precision too.

Work and shuffle follow the vectors for building balls, and the square of the number of balls, divided
by ``BLOCK``, for the meeting of blocks that no bound keeps apart.

Pruning in single precision leaves a margin above its rounding error. Vectors that are null,
empty or zero or hold null or non-finite components link with nothing, and vectors of
different length link with nothing either way. Repeated rows are vectors of their own and link.
A class of rows without ids has a null component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.components import components
from factsieve.llm.simhash import connect
from factsieve.llm.storage import checkpointed

THRESHOLD = 0.95
BLOCK = 4096
#: At most so many pivots; they and the radii of their cells are all that reaches the driver.
PIVOTS = 4096
RADII = (1.0, 0.5, 0.25, 0.125)
_SLACK = 1e-4
_CHUNK = 1 << 15
_BALL = "ball long, size long, radius double, vector binary"
_ROUTED = ["ball", "size", "radius", "vector", "block", "place", "level"]


def unit(values: Iterable) -> np.ndarray | None:
    """The vector scaled to length one in double precision; None if it cannot link."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / sqrt(float(x @ x))


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """All vectors of an Arrow list column; one step for the usual case."""
    flat = column.flatten()
    sizes = set(column.value_lengths().to_pylist())
    if not column.null_count and not flat.null_count and len(sizes) == 1 and sizes != {0}:
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        top = np.abs(x).max(axis=1, keepdims=True)
        if np.isfinite(x).all() and (top > 0).all():
            x = x / top
            return list(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None])
    return [unit(v) for v in column.to_pylist()]


def _split(x: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Cover the members by balls around some of them, each vector in the first ball that has it."""
    if len(members) == 1:
        return [members]
    own = x[members].astype(np.float32)
    free, out = np.ones(len(members), bool), []
    for at in range(0, len(members), 256):
        heads = at + np.flatnonzero(free[at : at + 256])
        near = own[heads] @ own.T >= 1 - radius * radius / 2
        for i, row in zip(heads.tolist(), near):
            if free[i]:
                free[i] = False
                ball = np.flatnonzero(row & free)
                free[ball] = False
                out.append(members[np.concatenate(([i], ball))])
    return out


def cover_tree(x: np.ndarray, radii: tuple[float, ...] = RADII) -> tuple[np.ndarray, np.ndarray]:
    """(order, level): the vectors with each node in one run, centre first, and the level at which each starts a node."""
    order, level = [], []

    def descend(members: np.ndarray, depth: int, start: int) -> None:
        if len(members) == 1 or depth == len(radii):
            order.extend(members.tolist())
            level.extend([start] + [len(radii) + 1] * (len(members) - 1))
            return
        for k, part in enumerate(_split(x, members, radii[depth])):
            descend(part, depth + 1, start if k == 0 and depth else depth + 1)

    descend(np.arange(len(x)), 0, 0)
    return np.array(order, np.int64), np.array(level, np.int64)


class Nodes:
    """The nodes of one level of a tree: first vector, covering radius, and the range of their children.

    ``own`` are the covering radii of what the tree holds, where that is balls.
    """

    def __init__(self, x: np.ndarray, level: np.ndarray, depth: int, own: np.ndarray | float = 0.0) -> None:
        starts = level <= depth
        starts[:1] = True
        self.start = np.flatnonzero(starts)
        centre = np.repeat(self.start, np.diff(np.r_[self.start, len(x)]))
        gap = x - x[centre]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap)) + own
        self.radius = np.maximum.reduceat(far, self.start) if len(far) else far
        self.first = self.end = None

    def children(self, below: Nodes, total: int) -> None:
        self.first = np.searchsorted(below.start, self.start)
        self.end = np.searchsorted(below.start, np.r_[self.start[1:], total])


def balls(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, radius): the vectors with each ball in one run, centre first; vectors of a ball lie within ``reach``."""
    most = reach / 2 - _SLACK
    if most <= 0:
        return np.arange(len(x)), np.arange(len(x)), np.zeros(len(x))
    radii = (*(r for r in RADII if r > most), most)
    order, level = cover_tree(x, radii)
    nodes = Nodes(x[order], level, len(radii))
    return order, nodes.start, nodes.radius


def _levels(x: np.ndarray, level: np.ndarray, own: np.ndarray) -> list[Nodes]:
    nodes = [Nodes(x, level, depth, own) for depth in range(1, len(RADII) + 2)]
    for upper, lower in zip(nodes, nodes[1:]):
        upper.children(lower, len(x))
    return nodes


def _near(
    a: np.ndarray, a_radius: np.ndarray, b: np.ndarray, b_radius: np.ndarray, reach: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of balls that may lie within ``reach``; all that do are among them."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    # balls of like size together, so that one limit a row does for all of them
    sizes = np.searchsorted(RADII[::-1], b_radius)
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        part, limit = b[some].T, a_radius + b_radius[some].max() + reach
        least = (1 - limit * limit / 2).astype(np.float32)
        for k in range(0, len(a), 256):
            at = np.flatnonzero(a[k : k + 256] @ part >= least[k : k + 256, None])
            if len(at):
                i, j = np.divmod(at, len(some))
                yield i + k, some[j]


def dual_join(
    a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool, reach: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the balls of two trees that may lie within ``reach``; of a tree with itself those with i < j.

    A tree is its balls' centres, their levels and their radii.
    """
    left = _levels(*a)
    right = left if same else _levels(*b)
    x, y = a[0], b[0]
    last = len(left) - 1
    # where the upper levels hardly gather, as they do not without clusters, their wide nodes only cost
    nodes = [len(p.start) + len(q.start) for p, q in zip(left, right)]
    top = max(depth for depth, n in enumerate(nodes) if n <= 2 * nodes[0])

    def descend(i: np.ndarray, j: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(i), _CHUNK):
            p, q, na, nb = i[at : at + _CHUNK], j[at : at + _CHUNK], left[depth], right[depth]
            near = _gaps(x[na.start[p]], y[nb.start[q]])[1] <= na.radius[p] + nb.radius[q] + reach
            p, q = p[near], q[near]
            if depth == last:
                apart = p < q if same else np.ones(len(p), bool)
                yield na.start[p[apart]], nb.start[q[apart]]
                continue
            for _, ci, cj in _products(na.first[p], na.end[p] - na.first[p], nb.first[q], nb.end[q] - nb.first[q]):
                once = ci <= cj if same else np.ones(len(ci), bool)
                yield from descend(ci[once], cj[once], depth + 1)

    tops = (x[left[top].start], left[top].radius, y[right[top].start], right[top].radius)
    for i, j in _near(*tops, reach):
        once = i <= j if same else np.ones(len(i), bool)
        yield from descend(i[once], j[once], top)


def _gaps(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and distances of rows, in double precision."""
    cosine = np.einsum("ij,ij->i", x, y)
    return cosine, np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _portions(size: np.ndarray) -> list[np.ndarray]:
    """Positions in runs of about ``_CHUNK`` child pairs."""
    if not len(size):
        return []
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // _CHUNK)) + 1)


def _expanded(part: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the positions as often as its size says, and a running number within it."""
    pair = np.repeat(part, size[part])
    return pair, np.arange(len(pair)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])


def _products(
    left: np.ndarray, tall: np.ndarray, right: np.ndarray, wide: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, i, j): all places of each pair of ranges (first, length), in steps of about ``_CHUNK``."""
    most = np.maximum(1, _CHUNK // np.maximum(1, wide))
    of, k = _expanded(np.arange(len(tall)), -(-tall // most))
    first = k * most[of]
    size = np.minimum(tall[of] - first, most[of]) * wide[of]
    for part in _portions(size):
        at, place = _expanded(part, size)
        pair = of[at]
        yield pair, left[pair] + first[at] + place // wide[pair], right[pair] + place % wide[pair]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = (x @ pivots.T).argmax(axis=1)
    gap = x - pivots[cell]
    return cell, np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(row, cell, vector): the nearest pivot, and the unit vector as bytes."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            good = [k for k, u in enumerate(units) if u is not None and len(u) == pivots.shape[1]]
            if not good:
                continue
            x = np.array([units[k] for k in good])
            row = batch.column(0).take(pa.array(good))
            vectors = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([row, pa.array(_nearest(x, pivots)[0]), vectors], ["row", "cell", "vector"])

    return rows.select("row", "embedding").mapInArrow(task, "row long, cell long, vector binary")


def _assign_balls(centres: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``far``: the pivot nearest to the centre, and the distance to it that covers the ball."""
    names = ["ball", "size", "radius", "vector"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = _nearest(_matrix(batch.column(3), pivots.shape[1]), pivots)
            arrays = [*batch.columns, pa.array(cell), pa.array(far + batch.column(2).to_numpy())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "cell", "far"])

    return centres.select(*names).mapInArrow(task, f"{_BALL}, cell long, far double")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _members(blocks: DataFrame, width: int, reach: float) -> DataFrame:
    """(row, vector, ball, size, radius): the ball of each vector, named by the row of its centre."""

    def build(table: pa.Table) -> pa.Table:
        order, start, radius = balls(_matrix(table["vector"], width), reach)
        size = np.diff(np.r_[start, len(order)])
        found = table.select(["row", "vector"]).take(pa.array(order))
        columns = [found["row"].to_numpy()[start], size, radius]
        for name, values in zip(["ball", "size", "radius"], columns):
            found = found.append_column(name, pa.array(np.repeat(values, size)))
        return found

    return blocks.groupBy("block").applyInArrow(build, "row long, vector binary, ball long, size long, radius double")


def _trees(blocks: DataFrame, width: int) -> DataFrame:
    """Add ``place`` and ``level``: where a ball stands in its block's tree."""

    def build(table: pa.Table) -> pa.Table:
        order, level = cover_tree(_matrix(table["vector"], width))
        ordered = table.take(pa.array(order))
        return ordered.append_column("place", pa.array(np.arange(len(order)))).append_column("level", pa.array(level))

    return blocks.groupBy("block").applyInArrow(build, f"{_BALL}, cell long, block long, place long, level long")


def _route(trees: DataFrame, pivots: np.ndarray, radius: np.ndarray, parts: np.ndarray, most: float, reach: float) -> DataFrame:
    """A row for each block pair that a ball takes part in: a <= b, and which of the two it is in.

    ``radius`` covers the balls of a cell as a whole, ``most`` is the largest radius of a ball.
    """
    gaps = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
    near = (gaps <= radius[:, None] + radius[None, :] + reach) & (parts > 0)[:, None] & (parts > 0)[None, :]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for top in range(0, whole.num_rows, 1024):
                batch = whole.slice(top, 1024)
                own, around, cells = (batch.column(k).to_numpy() for k in (4, 2, 5))
                cosine = _matrix(batch.column(3), pivots.shape[1]) @ pivots.T
                far = np.sqrt(np.maximum(2 - 2 * cosine, 0))
                around = around[:, None] + reach
                # the other centre is on its own pivot's side of the plane between both pivots
                ahead = cosine[np.arange(len(cells)), cells][:, None] - cosine
                meets = near[cells] & (far <= radius[None, :] + around) & (ahead <= gaps[cells] * (around + most))
                meets[np.arange(len(cells)), cells] = True
                which, cell = np.nonzero(meets)
                count = parts[cell]
                at, part = _expanded(np.arange(len(which)), count)
                which, other = which[at], (cell[at] << 32) + part
                mine = own[which]
                taken = batch.take(pa.array(which))
                arrays = [pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other))]
                arrays += [taken.column(k) for k in (0, 1, 2, 3, 4, 6, 7)]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", *_ROUTED])

    columns = trees.select("ball", "size", "radius", "vector", "block", "cell", "place", "level")
    return columns.mapInArrow(task, f"a long, b long, {_BALL}, block long, place long, level long")


def _verdict(
    x: np.ndarray, y: np.ndarray, sizes: np.ndarray, radii: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """(linked, open) of pairs of balls by their centres: all their vectors link; or some may, and have to be compared."""
    reach = sqrt(2 - 2 * threshold)
    cosine, gap = _gaps(x, y)
    alone = sizes == 1
    linked = np.where(alone, cosine >= threshold, gap + radii <= reach - _SLACK)
    return linked, ~alone & ~linked & (gap <= radii + reach + _SLACK)


def _ball_links(routed: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, ball, block, n, root, open): links of each of a ball's vectors found in one block pair.

    ``root`` is the least place of the ball's class there. Open balls have vectors that are still to be compared there.
    """

    def join(key: tuple, table: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("block", "ascending"), ("place", "ascending")])
        x, level = _matrix(table["vector"], width), table["level"].to_numpy()
        ball, block, size, radius = (table[c].to_numpy() for c in ("ball", "block", "size", "radius"))
        cut = int(np.searchsorted(block, b)) if a != b else 0
        count, label, waits = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
        right = (x[cut:], level[cut:], radius[cut:])
        left = right if a == b else (x[:cut], level[:cut], radius[:cut])
        for i, j in dual_join(left, right, a == b, sqrt(2 - 2 * threshold) + _SLACK):
            j = j + cut
            linked, unsure = _verdict(x[i], x[j], size[i] * size[j], radius[i] + radius[j], threshold)
            waits[i[unsure]] = waits[j[unsure]] = True
            i, j = i[linked], j[linked]
            for p, q in ((i, j), (j, i)):
                count += np.bincount(p, size[q], minlength=len(x)).astype(np.int64)
            connect(label, i, j)
        some = np.flatnonzero((count > 0) | waits)
        columns = [np.full(len(some), a), np.full(len(some), b)]
        columns += [ball[some], block[some], count[some], ball[label[some]], waits[some]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["a", "b", "ball", "block", "n", "root", "open"])

    schema = "a long, b long, ball long, block long, n long, root long, open boolean"
    return routed.groupBy("a", "b").applyInArrow(join, schema)


def _member_links(opened: DataFrame, width: int, threshold: float) -> DataFrame:
    """(row, n, ball, root): links of a vector found between the open balls of one block pair."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        far = pa.array(table["row"].to_numpy() != table["ball"].to_numpy())
        order = [("block", "ascending"), ("ball", "ascending"), ("far", "ascending")]
        table = table.append_column("far", far).sort_by(order)
        x, ball, block, row = _matrix(table["vector"], width), *(table[c].to_numpy() for c in ("ball", "block", "row"))
        start = np.flatnonzero(np.r_[True, ball[1:] != ball[:-1]])
        size, radius, centre = np.diff(np.r_[start, len(x)]), table["radius"].to_numpy()[start], x[start]
        cut = int(np.searchsorted(block[start], b)) if a != b else 0
        count, label = np.zeros(len(x), np.int64), np.arange(len(start))

        end = len(start) if a == b else cut
        for i, j in _near(centre[:end], radius[:end], centre[cut:], radius[cut:], sqrt(2 - 2 * threshold) + _SLACK):
            j = j + cut
            for at in range(0, len(i), _CHUNK):
                p, q = i[at : at + _CHUNK], j[at : at + _CHUNK]
                p, q = (p[p < q], q[p < q]) if a == b else (p, q)
                unsure = _verdict(centre[p], centre[q], size[p] * size[q], radius[p] + radius[q], threshold)[1]
                p, q = p[unsure], q[unsure]
                for pair, u, v in _products(start[p], size[p], start[q], size[q]):
                    hit = _gaps(x[u], x[v])[0] >= threshold
                    for side in (u, v):
                        np.add.at(count, side[hit], 1)
                    pair = np.unique(pair[hit])
                    connect(label, p[pair], q[pair])
        label = np.repeat(label, size)
        some = np.flatnonzero(count)
        columns = [row[some], count[some], ball[some], ball[start][label[some]]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["row", "n", "ball", "root"])

    return opened.groupBy("a", "b").applyInArrow(join, "row long, n long, ball long, root long")


def _blocks(cells: DataFrame, key: str, parts: np.ndarray) -> DataFrame:
    """Add ``block``: a cell's rows dealt by a hash of their key."""
    spread = F.create_map(*(F.lit(v) for k, p in enumerate(parts.tolist()) for v in (k, max(1, p))))
    part = F.pmod(F.xxhash64(key), F.element_at(spread, F.col("cell").cast("int")))
    return cells.withColumn("block", F.shiftleft("cell", 32) + part)


def _links(rows: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Members (row, ball, size), links of balls (ball, n, root) and of vectors (row, n, ball, root); None if no vector can link."""
    usable = rows.filter("embedding IS NOT NULL AND size(embedding) > 0")
    reach, out = sqrt(2 - 2 * threshold), []
    for width, n in sorted(tuple(r) for r in usable.groupBy(F.size("embedding")).count().collect()):
        same = usable.filter(F.size("embedding") == width)
        wanted = int(min(PIVOTS, max(1, -(-n // block))))
        sample = same.orderBy(F.xxhash64("row"), "row").limit(4 * wanted).select("embedding").collect()
        found = [u for u in (unit(r[0]) for r in sample) if u is not None]
        pivots = np.array(found[:wanted]) if found else np.eye(1, width)
        cells = checkpointed(_assign(same, pivots))
        parts = np.zeros(len(pivots), np.int64)
        for r in cells.groupBy("cell").count().collect():
            parts[r["cell"]] = -(-r["count"] // block)
        members = checkpointed(_members(_blocks(cells, "row", parts), width, reach))
        centres = members.filter("row = ball")
        total = centres.agg(F.count("*").alias("n"), F.max("radius").alias("most")).first()
        pivots = pivots[: max(1, -(-total["n"] // (2 * block)))]
        centres = checkpointed(_assign_balls(centres, pivots))
        radius, parts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
        figures = [F.max("far").alias("far"), F.count("*").alias("n"), F.sum("size").alias("vectors")]
        for r in centres.groupBy("cell").agg(*figures).collect():
            radius[r["cell"]] = r["far"]
            parts[r["cell"]] = max(-(-r["n"] // (2 * block)), -(-r["vectors"] // (8 * block)))
        trees = checkpointed(_trees(_blocks(centres, "ball", parts).drop("far"), width))
        routed = _route(trees, pivots, radius, parts, total["most"] or 0.0, reach + _SLACK)
        links = checkpointed(_ball_links(routed, width, threshold))
        opened = links.filter("open").select("a", "b", "ball", "block").join(members.drop("size"), "ball")
        out.append((members.select("row", "ball", "size"), links, checkpointed(_member_links(opened, width, threshold))))
    return tuple(reduce(DataFrame.unionByName, frames) for frames in zip(*out)) if out else None


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding"
    )
    rows = checkpointed(rows)
    found = _links(rows, threshold, block)
    if found is None:
        none = rows.limit(0)
        found = (
            none.selectExpr("row", "row AS ball", "row AS size"),
            none.selectExpr("row AS ball", "row AS n", "row AS root"),
            none.selectExpr("row", "row AS n", "row AS ball", "row AS root"),
        )
    members, of_balls, of_rows = found
    edges = [f.select(F.col("ball").alias("a"), F.col("root").alias("b")) for f in (of_balls, of_rows)]
    groups = components(edges[0].unionByName(edges[1]))
    for_all = of_balls.groupBy("ball").agg(F.sum("n").alias("for_all"))
    counts = members.join(for_all, "ball", "left").join(of_rows.groupBy("row").agg(F.sum("n").alias("n")), "row", "left")
    counts = counts.join(groups.withColumnRenamed("node", "ball"), "ball", "left")
    zero = F.lit(0)
    counts = counts.select(
        "row",
        (F.col("size") - 1 + F.coalesce("for_all", zero) + F.coalesce("n", zero)).alias("n"),
        F.coalesce("component", "ball").alias("component"),
    )
    found = rows.select("row", "vec_id").join(counts, "row", "left")
    found = found.withColumn("component", F.coalesce("component", "row"))
    least = found.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return found.join(least, "component").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
