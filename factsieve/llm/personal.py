"""Personal data in texts: fixed patterns, and a character tagger trained from the spans they find.

A bidirectional LSTM with CRF transitions is trained in numpy. Its examples are pieces of the documents
around spans of the fixed patterns (at most ``EXAMPLES``, the first by hash), in which spans are
also rewritten in forms that the patterns do not know: bracketed or spelled-out signs in addresses,
national telephone numbers, other separators. Texts are cut into overlapping windows, each decoded by
itself; a span that a window's edge may have cut is left to the next window, and a document's spans
are then chosen together, as the set without overlaps that has the greatest sum of margins.

Only windows with a digit or an at-sign (also ``(at)``, ``[at]``) are decoded. A span must hold one of
these, so the others could give none.

Defined results: a null or empty text has no spans. Texts of any length are searched whole, in linear
time. Places count code points. Pattern spans always stay; of a kind they do not overlap, of
two kinds they may. Tagged spans overlap no other span; of equal sums the earlier span wins. Repeated
rows give repeated results, an empty table none. With no span in any document, the rewritten forms
alone train the tagger. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.batches import map_rows
from factsieve.llm.bilstm import Tagger, encoded, span_tags

KINDS = ("email", "ip", "card", "phone")

#: Pieces of text that the tagger learns from at most, and their length.
EXAMPLES = 1024
PIECE = 256
#: Characters of a window, and from one window to the next.
WIDTH, STRIDE = 96, 48
#: A tagged span must beat no span by so much (natural logarithm of the odds).
MARGIN = 4.0
#: Windows decoded at once.
BATCH = 1024

# Fixed patterns. Runs that a match cannot start inside are entered at their first character only,
# which finds the same matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|[(\[]at[)\]]")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    places = [int(d) for d in reversed(digits)]
    return (sum(places[::2]) + sum(sum(divmod(2 * d, 10)) for d in places[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            yield start, last
        at = text.find("@", last)


def _plausible(kind: int, text: str) -> bool:
    """The digit checks of a kind."""
    if KINDS[kind] == "email":
        return True
    runs = _DIGITS.findall(text)
    digits = "".join(runs)
    if KINDS[kind] == "ip":
        return len(runs) == 4 and all(len(r.lstrip("0")) <= 3 and int(r[-3:] if r.lstrip("0") else "0") <= 255 for r in runs)
    if KINDS[kind] == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def shapes(text: str) -> list[Span]:
    """(kind, start, stop) of every match of the fixed patterns, digit checks aside."""
    found = [(0, *span) for span in _emails(text)]
    if _DIGITS.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


def pattern_spans(text: str | None) -> list[Span]:
    """(kind, start, stop) of the fixed patterns that pass their digit checks, by kind and place."""
    return [s for s in shapes(text or "") if _plausible(s[0], text[s[1] : s[2]])]


# Training -------------------------------------------------------------------------------


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(str(d) for d in r.integers(0, 10, n))


def _pick(r: np.random.Generator, *choices: str) -> str:
    return choices[int(r.integers(len(choices)))]


def _word(r: np.random.Generator, low: int = 3, high: int = 9) -> str:
    return "".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(low, high))))


def written(kind: int, r: np.random.Generator) -> str:
    """A span of a kind as the fixed patterns know it, or in another common form."""
    if KINDS[kind] == "email":
        at = _pick(r, "@", "@", " @ ", "(at)", " (at) ", " [at] ", "[at]", "(at)")
        dot = "." if at == "@" or r.random() < 0.3 else _pick(r, " . ", "[dot]", "(dot)", " [dot] ", " (dot) ", " dot ")
        local = _word(r) + _pick(r, "", "", ".", "_", "+") + _pick(r, _word(r), _digits(r, 2))
        return local + at + dot.join([_word(r), *([_word(r)] if r.random() < 0.4 else []), _pick(r, "com", "org", "net", "de", "io")])
    if KINDS[kind] == "ip":
        dot = _pick(r, ".", ".", "[.]", " . ", "(.)", "[dot]")
        return dot.join(str(p) for p in r.integers(0, 256, 4))
    if KINDS[kind] == "card":
        first = _digits(r, 15)
        whole = next(first + str(d) for d in range(10) if luhn(first + str(d)))
        join = _pick(r, "", "", " ", "-", ".", "/", "  ", " - ")
        return join.join(whole[i : i + 4] for i in range(0, 16, 4))
    area, middle, last = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return _pick(
        r,
        f"+{_digits(r, 1)} ({area}) {middle}-{last}",
        f"+{_digits(r, 2)} {area} {middle} {last}",
        f"({area}) {middle}-{last}",
        f"({area}) {middle} {last}",
        f"{area}-{middle}-{last}",
        f"00{_digits(r, 2)} {area} {middle} {last}",
        f"tel:{area}-{middle}-{last}".removeprefix("tel:"),
    )


def _harmless(r: np.random.Generator) -> str:
    """Digits and signs that are no personal data."""
    n = lambda a, b: str(int(r.integers(a, b)))
    return _pick(
        r,
        f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 32)}",
        f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}",
        f"{n(0, 24)}:{n(10, 60)}",
        f"{n(1900, 2100)}",
        f"{n(1, 1000)}.{n(0, 100)}",
        f"{n(1, 1000)},{n(100, 1000)},{n(100, 1000)}.00",
        f"version {n(1, 9)}.{n(0, 20)}.{n(0, 20)}",
        f"{n(1, 9)}.{n(0, 9)}",
        f'token = "{"".join(_pick(r, *"0123456789abcdef") for _ in range(int(r.integers(16, 48))))}"',
        f"id {n(10**6, 10**9)}",
        f"{n(10**9, 10**12)}",
        f"{n(1, 999)} @ {n(1, 99)}.{n(10, 99)}",
        f"@{_word(r)}",
        f"{n(1990, 2030)}-{n(1990, 2030)}",
        f"pages {n(1, 99)}-{n(100, 999)}",
        f"({n(1, 99)}) {_word(r)} ({n(1, 99)})",
        f"{n(1, 9)} {n(1, 9)} {n(1, 99)} {n(1, 999)}",
        f"{_word(r)} (at) {n(10, 24)}:00",
        f"ISBN {n(100, 999)}-{n(1, 9)}-{n(10, 99)}",
        _digits(r, int(r.integers(20, 60))),
    )


def _example(text: str, r: np.random.Generator) -> tuple[str, list[Span]]:
    """A piece of text with its spans partly rewritten, and with further spans or harmless numbers put in."""
    spans = sorted((s for s in shapes(text)), key=lambda s: (s[1], s[0] == 2, s[0]))
    out, labelled, last = [], [], 0

    def put(kind: int, value: str) -> None:
        start = sum(map(len, out))
        out.append(value)
        if kind >= 0:
            labelled.append((kind, start, start + len(value)))

    for kind, start, stop in spans:
        if start < last or KINDS[kind] == "card" and not 13 <= sum(c.isdigit() for c in text[start:stop]) <= 19:
            continue
        out.append(text[last:start])
        put(kind, text[start:stop] if r.random() < 0.4 else written(kind, r))
        last = stop
    rest = text[last:]
    for _ in range(int(r.integers(0, 3))):
        cut = rest.find(" ", int(r.integers(0, len(rest) + 1)))
        if cut < 0:
            cut = len(rest)
        out.append(rest[:cut] + " ")
        rest = rest[cut:]
        kind = int(r.integers(-2, 4))
        put(kind, written(kind, r) if kind >= 0 else _harmless(r))
        if r.random() < 0.3:
            out.append(_pick(r, ".", ",", "!", "###", "%%%"))
    out.append(rest)
    return "".join(out), labelled


def training_windows(pieces: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of n windows made from pieces of text."""
    r = np.random.default_rng(seed)
    texts, tags = [], []
    for k in range(n):
        text, spans = _example(pieces[k % len(pieces)] if pieces else " ".join(_word(r) for _ in range(30)), r)
        middles = [s[1] for s in spans] or [int(r.integers(0, len(text) + 1))]
        start = max(0, middles[int(r.integers(len(middles)))] - int(r.integers(0, WIDTH)))
        texts.append(text[start : start + WIDTH])
        tags.append(span_tags([(kind, a - start, b - start) for kind, a, b in spans], WIDTH))
    return encoded(texts, WIDTH), np.stack(tags)


def _pieces(docs: DataFrame) -> DataFrame:
    """Pieces of texts around spans of the patterns, and as many without; bounded, the first by hash."""

    def start():
        def work(ids, texts):
            kept, marked = [], []
            for text in texts.to_pylist():
                spans = shapes(text or "")
                if text:
                    middle = spans[len(spans) // 2][1] if spans else len(text) // 2
                    begin = max(0, middle - PIECE // 2)
                    kept.append(text[begin : begin + PIECE])
                    marked.append(bool(spans))
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(marked, pa.bool_())], ["piece", "marked"])

        return work

    frame = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = map_rows(frame, ["doc_id", "text"], start, "piece string, marked boolean").distinct()
    halves = [
        pieces.filter(F.col("marked") == flag).orderBy(F.xxhash64("piece"), "piece").limit(EXAMPLES // 2)
        for flag in (True, False)
    ]
    return halves[0].unionByName(halves[1]).select("piece")


def fitted(pieces: list[str], steps: int, windows: int, seed: int) -> Tagger:
    """A tagger trained on pieces of text; the same pieces give the same tagger."""
    pieces = sorted(pieces)
    order = np.random.default_rng(seed).permutation(len(pieces))
    ids, tags = training_windows([pieces[i] for i in order], windows, seed)
    tagger = Tagger.new(len(KINDS), embedding=8, hidden=16, seed=seed)
    tagger.train(ids, tags, steps, batch=48, rate=0.02, seed=seed)
    return tagger


def learn(docs: DataFrame, steps: int = 600, windows: int = 8000, seed: int = 7) -> Tagger:
    """A tagger trained, in one task, on at most ``EXAMPLES`` pieces of the documents."""

    def train(table: pa.Table) -> pa.Table:
        tagger = fitted([p for p in table["piece"].to_pylist() if p is not None], steps, windows, seed)
        return pa.table({"tagger": pa.array([tagger.packed()], pa.binary())})

    spark = docs.sparkSession
    pieces = _pieces(docs).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("piece")))
    row = pieces.groupBy().applyInArrow(train, "tagger binary").first()
    return Tagger.unpacked(row["tagger"])


# Search ---------------------------------------------------------------------------------


def chosen(spans: Iterable[tuple[int, int, int, float]]) -> list[Span]:
    """The spans without overlap that have the greatest sum of margins; equal spans add up."""
    sums: dict[Span, float] = {}
    for kind, start, stop, margin in spans:
        sums[kind, start, stop] = sums.get((kind, start, stop), 0.0) + margin
    ordered = sorted(sums, key=lambda s: (s[2], s[1], s[0]))
    stops = [s[2] for s in ordered]
    best, before = [0.0], []
    for i, span in enumerate(ordered):
        before.append(bisect_right(stops, span[1], 0, i))
        best.append(max(best[-1], best[before[-1]] + sums[span]))
    out, i = [], len(ordered)
    while i:
        if best[i] > best[i - 1]:
            out.append(ordered[i - 1])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def _windows(text: str) -> list[int]:
    """Where the windows with a digit or an at-sign begin."""
    found: dict[int, None] = {}
    for m in _TRIGGER.finditer(text):
        for k in range(max(0, (m.start() - WIDTH) // STRIDE + 1), (m.end() - 1) // STRIDE + 1):
            found[k * STRIDE] = None
    return list(found)


def _email_like(text: str) -> bool:
    """An at-sign in some form with something before, and a dot in some form after it."""
    parts = re.split(r"@|[(\[]at[)\]]", text)
    return len(parts) == 2 and bool(parts[0].strip()) and bool(re.search(r"[a-z0-9] ?(\.|[(\[]dot[)\]]| dot ) ?[a-z]", parts[1], re.I))


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """The span without signs that only surround it."""
    while start < stop and not text[start].isalnum() and text[start] not in "+(":
        start += 1
    while stop > start and not text[stop - 1].isalnum():
        stop -= 1
    return start, stop


def _believed(kind: int, text: str) -> bool:
    """Whether a tagged span can be what its kind says, whatever its signs."""
    if not _TRIGGER.search(text):
        return False
    return _email_like(text) if KINDS[kind] == "email" else _plausible(kind, text)


class Finder:
    """Spans of texts, with the tagger's windows of many texts decoded together."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def _tagged(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        queue: list[tuple[int, int]] = []

        def flush() -> None:
            cut = [texts[k][at : at + WIDTH] for k, at in queue]
            for (k, at), piece, spans in zip(queue, cut, self.tagger.spans(encoded(cut, WIDTH))):
                for kind, start, stop, margin in spans:
                    # an edge inside the text may have cut the span; the next window holds it whole
                    if (start or not at) and (stop < len(piece) or at + len(piece) == len(texts[k])) and margin >= MARGIN:
                        found[k].append((kind, at + start, at + stop, margin))
            queue.clear()

        for k, text in enumerate(texts):
            for at in _windows(text):
                queue.append((k, at))
                if len(queue) == BATCH:
                    flush()
        if queue:
            flush()
        return found

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
        """Per text (kind, start, stop, whether a fixed pattern found it), by kind and place."""
        texts = [t or "" for t in texts]
        out = []
        for text, tagged in zip(texts, self._tagged(texts)):
            base = pattern_spans(text)
            taken = sorted(base, key=lambda s: s[1])
            starts, reach = [s[1] for s in taken], []
            for s in taken:
                reach.append(max(s[2], reach[-1] if reach else 0))

            def free(start: int, stop: int) -> bool:
                k = bisect_right(starts, stop - 1)
                return k == 0 or reach[k - 1] <= start

            trimmed = [(kind, *_trimmed(text, start, stop), margin) for kind, start, stop, margin in tagged]
            added = [s for s in trimmed if free(s[1], s[2]) and _believed(s[0], text[s[1] : s[2]])]
            out.append(sorted([(*s, True) for s in base] + [(*s, False) for s in chosen(added)]))
        return out


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """One row per row of the documents: doc_id and its spans (kind, start, stop, value, by_pattern)."""

    def start():
        finder = Finder(tagger)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()),
                          ("by_pattern", pa.bool_())])

        def work(ids, texts):
            plain = texts.to_pylist()
            found = [
                [
                    {"kind": KINDS[kind], "start": a, "stop": b, "value": text[a:b], "by_pattern": base}
                    for kind, a, b, base in spans
                ]
                for text, spans in zip(plain, finder.find(plain))
            ]
            return pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(span))], ["doc_id", "spans"])

        return work

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, spans array<struct<kind: string, start: long, stop: long, value: string, by_pattern: boolean>>"
    return map_rows(frame, ["doc_id", "text"], start, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the pattern spans, and the list of all spans, per document."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def number(spans: Column, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["by_pattern"])
    counts = [number(base, kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
