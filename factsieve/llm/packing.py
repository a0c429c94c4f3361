"""Packing token sequences into windows by non-negative least squares over a length histogram.

1. Every document is encoded and cut into whole windows and one rest. Whole windows are
   sequences of their own.
2. The rests are counted by length. There are fewer lengths than tokens in a window, so the
   histogram is small whatever the corpus.
3. Rests of at least ``SHORTEST`` tokens are binned by ``UNIT`` tokens. All combinations of at
   most three bins that fill a window are listed, and non-negative least squares finds how
   often to repeat each so that they use up the histogram. Repeats are rounded and cut back
   where they ask for more than there is.
4. What is left, short rests included, is packed greedily: each new sequence takes the
   longest length left, then again and again the longest that still fits; the same choice is
   repeated as often as the counts allow.
5. Rests whose sequences would keep room (long ones, of which no two fit into a window) are laid end
   to end instead and cut where a window ends, at a multiple of ``CUT`` tokens; what is left of
   a rest's last ``CUT`` tokens is the only padding there. The checksum of each part comes from
   checksums at these multiples, taken when the text was encoded.
6. The k-th rest of a length takes the k-th place made for it. Ranks come from counts by
   input partition and length; offsets inside a sequence from a window over its few pieces.

Null texts count as empty and give the end id alone. Texts of any length are encoded whole. Rests of
equal length are interchangeable and ranked by input partition and order. Repeated rows and null ids
are packed as any other, an empty table gives no rows, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.encoder import Encoder
from factsieve.llm.storage import checkpointed

WINDOW = 4096
END_ID = 2
UNIT = 16
SHORTEST = 256
#: Rests are cut at multiples of so many tokens, where a sequence would keep more room than ``ROOM``.
CUT = 8
ROOM = 40
#: Sequence ids of whole windows start here; each input partition has 2**36 of them.
WHOLE = 1 << 60
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long, marks binary"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``part`` is the input partition, ``place`` counts its pieces of that length.

    ``marks`` are a rest's checksums after each ``CUT`` tokens but the last.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.array([end_id], np.uint32).tobytes()
        part, places = TaskContext.get().partitionId(), Counter()
        names = [c.split()[0] for c in PIECE.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    marks = prefix_crcs(piece) if length < window else b""
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, part, places[length], marks))
                    places[length] += 1
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return frame.mapInArrow(task, PIECE)


def prefix_crcs(ids: bytes) -> bytes:
    """Checksums of the first ``CUT``, 2 ``CUT``, .. tokens, as far as tokens are left."""
    crc, out = 0, []
    for start in range(0, len(ids) - 4 * CUT, 4 * CUT):
        crc = zlib.crc32(ids[start : start + 4 * CUT], crc)
        out.append(crc)
    return np.array(out, np.uint32).tobytes()


def _times(matrix: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """Products of a matrix of bits, given by its columns, with checksums as vectors of bits."""
    out = np.zeros_like(crcs)
    for bit in range(32):
        out ^= np.where((crcs >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _zero_bytes() -> list[np.ndarray]:
    """What 1, 2, 4, .. zero bytes do to a checksum."""
    step = np.array([0xEDB88320] + [1 << k for k in range(31)], np.uint32)  # one zero bit, by the checksum's polynomial
    out = []
    for k in range(3 + 24):
        if k >= 3:
            out.append(step)
        step = _times(step, step)
    return out


_ZERO_BYTES = _zero_bytes()


def crc_of_rest(whole: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of the last ``size`` bytes, from those of the whole and of what stands before."""
    moved, size = first.astype(np.uint32), size.astype(np.int64)
    for k, matrix in enumerate(_ZERO_BYTES):
        if not (size >> k).any():
            break
        moved = np.where((size >> k) & 1, _times(matrix, moved), moved)
    return whole.astype(np.uint32) ^ moved


def combinations(bins: list[int], full: int) -> np.ndarray:
    """All choices of one to three bins, largest first, that add up to ``full``; unused slots hold 0."""
    known = set(bins)
    out = [(full, 0, 0)] if full in known else []
    for a in bins:
        if full - a <= a and full - a in known:
            out.append((a, full - a, 0))
        for b in bins:
            c = full - a - b
            if c <= b <= a and c in known:
                out.append((a, b, c))
    return np.array(out, np.int64).reshape(-1, 3)


def least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative x that minimises |matrix x - target|, by the active-set method."""
    x = np.zeros(matrix.shape[1])
    active = np.zeros(len(x), bool)
    slack = 1e-9 * max(1.0, float(np.abs(matrix.T @ target).max(initial=0)))
    for _ in range(3 * matrix.shape[0]):
        gain = matrix.T @ (target - matrix @ x)
        gain[active] = -np.inf
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= slack:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            trial = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            bad = trial <= 0
            if not bad.any():
                x[:] = 0
                x[at] = trial
                break
            old = x[at]
            step = np.min(old[bad] / np.maximum(old[bad] - trial[bad], 1e-300))
            x[at] = old + step * (trial - old)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def repeats(counts: dict[int, int], window: int, unit: int, shortest: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of one sequence, number of such sequences) that use no bin more often than it has rests."""
    bins = range(-(-shortest // unit), window // unit + 1)
    supply = np.zeros(window // unit + 1, np.int64)
    for length, n in counts.items():
        if length >= shortest:
            supply[-(-length // unit)] += n
    options = combinations([b for b in bins if supply[b]], window // unit)
    if not len(options):
        return []
    use = np.zeros((len(supply), len(options)))
    for slot in options.T:
        np.add.at(use, (slot, np.arange(len(options))), slot > 0)
    weight = np.arange(len(supply))[:, None]  # what is left over counts by its tokens
    times = np.rint(least_squares(use * weight, (supply * weight[:, 0]).astype(float))).astype(np.int64)
    for b in np.flatnonzero(use @ times > supply):
        over = int(use[b] @ times - supply[b])
        for k in sorted(np.flatnonzero((use[b] > 0) & (times > 0)), key=lambda k: -times[k]):
            cut = min(int(times[k]), -(-max(over, 0) // int(use[b, k])))  # earlier cuts may have been enough
            times[k] -= cut
            over -= cut * int(use[b, k])
            if over <= 0:
                break
    return [(tuple(int(b) for b in options[k] if b), int(times[k])) for k in np.flatnonzero(times)]


def greedy(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) that use up all counts."""
    left = {length: n for length, n in counts.items() if n}
    lengths = sorted(left)
    out = []
    while lengths:
        used: Counter = Counter()
        room, top = window, len(lengths)
        while room and (top := bisect_right(lengths, room, hi=top)):
            length = lengths[top - 1]
            n = min(left[length], room // length)
            used[length] = n
            room -= n * length
            top -= 1
        times = min(left[length] // n for length, n in used.items())
        out.append((tuple(used.elements()), times))
        for length, n in used.items():
            left[length] -= n * times
        lengths = [x for x in lengths if left[x]]
    return out


def _units(length: int) -> int:
    return -(-length // CUT)


def layout(counts: dict[int, int], window: int = WINDOW, unit: int = UNIT, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (length, first rank, first sequence, first unit).

    Where the unit is -1, ranks from the first on take sequences one by one. Elsewhere they are laid end
    to end in units of ``CUT`` tokens from that unit on, and the sequences are the windows from the first.
    """
    shortest = min(shortest, window)
    rows, base, taken = [], 0, Counter()
    wanted: dict[int, list[tuple[int, int]]] = {}
    for bins, times in repeats(counts, window, unit, shortest):
        for b in bins:
            wanted.setdefault(b, []).append((base, times))
        base += times
    for b, slots in wanted.items():
        lengths = [x for x in range(b * unit, (b - 1) * unit, -1) if counts.get(x) and x >= shortest]
        for first, times in slots:  # the longest rests of the bin first
            while times:
                length = next(x for x in lengths if taken[x] < counts[x])
                n = min(times, counts[length] - taken[length])
                rows.append((length, taken[length], first, -1))
                taken[length] += n
                first += n
                times -= n
    loose: Counter = Counter()
    for lengths, times in greedy({x: n - taken[x] for x, n in counts.items()}, window):
        room, lost = window - sum(lengths), sum(CUT * _units(length) - length for length in lengths)
        if window % CUT == 0 and room > ROOM and 2 * lost < room:
            for length in lengths:
                loose[length] += times
            continue
        for length in lengths:
            rows.append((length, taken[length], base, -1))
            taken[length] += times
        base += times
    at = 0
    for length, n in sorted(loose.items()):
        rows.append((length, taken[length], base, at))
        at += n * _units(length)
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def placed(plan: np.ndarray, length: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each rest, and how many of its tokens stand there; the others begin the next one."""
    keys = plan[:, 0] * (1 << 45) + plan[:, 1]
    order = np.argsort(keys)
    at = order[np.searchsorted(keys[order], length * (1 << 45) + rank, side="right") - 1]
    behind, sequence, unit = rank - plan[at, 1], plan[at, 2], plan[at, 3]
    here = unit + behind * -(-length // CUT)
    whole, per = unit < 0, max(1, window // CUT)
    room = (per - here % per) * CUT
    return np.where(whole, sequence + behind, sequence + here // per), np.where(whole, length, np.minimum(length, room))


def _sequences(rests: DataFrame, plan: np.ndarray, window: int) -> DataFrame:
    """Rests with their sequence, those cut in two parts; the plan is bounded by the number of lengths."""
    names = [c.split()[0] for c in PIECE.split(", ")[:-1]]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*names[1:], "rank")}
            length = given["length"]
            sequence, first = placed(plan, length, given["rank"], window)
            cut = np.flatnonzero(first < length)
            marks = batch.column("marks")
            crcs = np.array(
                [np.frombuffer(marks[int(i)].as_buffer(), np.uint32)[first[i] // CUT - 1] for i in cut], np.uint32
            )
            ends = crc_of_rest(given["ids_crc32"][cut], crcs, 4 * (length - first)[cut])
            given["ids_crc32"] = given["ids_crc32"].copy()
            given["ids_crc32"][cut] = crcs
            given["length"] = first
            tails = {n: given[n][cut] for n in names[1:]}
            tails |= {"start": (given["start"] + first)[cut], "length": (length - first)[cut], "ids_crc32": ends.astype(np.int64)}
            for ids, part, own in (
                (batch.column("doc_id"), given, sequence),
                (batch.column("doc_id").take(pa.array(cut)), tails, sequence[cut] + 1),
            ):
                arrays = [ids, *(pa.array(part[n], pa.int64()) for n in names[1:]), pa.array(own, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id"])

    return rests.mapInArrow(task, PIECE.removesuffix(", marks binary") + ", sequence_id long")


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    unit: int = UNIT,
    shortest: int = SHORTEST,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = checkpointed(pieces(docs, tokenizer, window, end_id))
    rests = cut.filter(F.col("length") < window)
    by_part = rests.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = rests.join(firsts, ["length", "part"]).withColumn("rank", F.col("place") + F.col("first"))
    names = [c.split()[0] for c in PIECE.split(", ")]
    plan = layout(counts, window, unit, shortest)
    spread = _sequences(ranked.select(*names, "rank"), plan, window)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "place", "start", "ids_crc32")
    spread = spread.withColumn(
        "offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    whole = cut.filter(F.col("length") == window).withColumns(
        {"sequence_id": F.lit(WHOLE) + F.shiftleft("part", 36) + F.col("place"), "offset": F.lit(0).cast("long")}
    )
    return spread.select(*COLUMNS).unionByName(whole.select(*COLUMNS))
