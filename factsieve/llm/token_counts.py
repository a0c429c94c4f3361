"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A document is cut into leaves, each a blank-separated chunk with the blanks after it; chunks are
encoded apart, so a document's count is the sum over its leaves. Leaves lie in blocks, and a binary
tree over the blocks holds sums of characters and tokens. An edit replaces a range of characters.
The tree finds the leaves it touches in a walk from the root; these, and the neighbours
that the new text could join, are cut and encoded anew, and the sums above them are updated.
Everything else keeps its count.

Edits of a document apply one after another, each in the coordinates of the text as it is then;
positions beyond the text are moved to its end, and null edits change nothing. Null texts count
as empty. Repeated rows are counted each for itself. An empty table gives no rows. There is no
shuffle: a row brings its own edits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.batches import map_rows
from factsieve.llm.encoder import Encoder

Edit = tuple[int, int, str]
BLOCK = 64
_LEAF = re.compile(r"[^ \n]+[ \n]*|[ \n]+")

# Personal data as it appears in running text, and what stands in for it.
PERSONAL = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b\d{13,19}\b", "<number>"),
    (r"\+\d{1,3} ?\(?\d{2,4}\)?[ -]?\d{3}[ -]?\d{4}", "<phone>"),
]


class TokenTree:
    """The token count of a text under edits."""

    def __init__(self, encoder: Encoder, text: str) -> None:
        self.encoder = encoder
        self.reencoded = 0
        self._build(*self._cut(text))

    def _cut(self, text: str) -> tuple[list[str], list[int]]:
        """Leaves of a text and their token counts."""
        leaves = _LEAF.findall(text) if self.encoder.plain else [text] if text else []
        chunks = [leaf.rstrip(" \n") for leaf in leaves] if self.encoder.plain else leaves
        return leaves, [len(ids) // 4 for ids in self.encoder.ids(chunks)] if leaves else []

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self.counts = [counts[i : i + BLOCK] for i in range(0, len(counts), BLOCK)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (own, n) in enumerate(zip(self.leaves, self.counts)):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(map(len, own)), sum(n)
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _update(self, block: int) -> None:
        k = self.size + block
        self.chars[k], self.tokens[k] = sum(map(len, self.leaves[block])), sum(self.counts[block])
        while k := k // 2:
            self._sum(k)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(leaf for block in self.leaves for leaf in block)

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, characters of the text before the leaf) of the leaf that holds a position."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at >= before + self.chars[k]:
                before += self.chars[k]
                k += 1
        block = k - self.size
        for leaf, text in enumerate(self.leaves[block]):
            if at < before + len(text):
                return block, leaf, before
            before += len(text)
        return block, len(self.leaves[block]), before

    def edit(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to ``stop``."""
        start = min(max(start, 0), self.length)
        stop = min(max(stop, start), self.length)
        if not self.length:
            self._build(*self._cut(new))
            self.reencoded += sum(map(len, self.leaves))
            return
        # the leaf before the first character and the leaf of the one after the last are touched too
        first, i, left = self._find(max(start - 1, 0))
        last, j, right = self._find(min(stop, self.length - 1))
        head = self.leaves[first][i][: start - left]
        tail = self.leaves[last][j][max(stop - right, 0) :]
        leaves, counts = self._cut(head + new + tail)
        self.reencoded += len(leaves)
        if first == last:
            self.leaves[first][i : j + 1], self.counts[first][i : j + 1] = leaves, counts
        else:
            self.leaves[first][i:], self.counts[first][i:] = leaves, counts
            for block in range(first + 1, last):
                self.leaves[block], self.counts[block] = [], []
                self._update(block)
            del self.leaves[last][: j + 1], self.counts[last][: j + 1]
            self._update(last)
        self._update(first)
        if len(self.leaves[first]) > 4 * BLOCK:  # long insertions: deal the leaves anew
            self._build(*([x for block in part for x in block] for part in (self.leaves, self.counts)))


def redactions(text: str | None) -> list[Edit]:
    """Edits that mask personal data, the last place first, so that positions stay valid."""
    found: list[Edit] = []
    for pattern, name in PERSONAL:
        found += [(m.start(), m.end(), name) for m in re.finditer(pattern, text or "")]
    out: list[Edit] = []
    for start, stop, name in sorted(found, reverse=True):
        if not out or stop <= out[-1][0]:
            out.append((start, stop, name))
    return out


def with_edits(docs: DataFrame, rule: Callable[[str | None], Iterable[Edit]] = redactions) -> DataFrame:
    """(doc_id, text, edits): the edits that a rule derives from each text."""

    def start():
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("new", pa.string())]))

        def work(ids, texts):
            edits = [[{"start": a, "stop": b, "new": n} for a, b, n in rule(t)] for t in texts.to_pylist()]
            return pa.RecordBatch.from_arrays([ids, texts, pa.array(edits, kind)], ["doc_id", "text", "edits"])

        return work

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, text string, edits array<struct<start: long, stop: long, new: string>>"
    return map_rows(frame, ["doc_id", "text"], start, schema)


def count(edited: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of (doc_id, text, edits): counts before and after, edits, pre-tokens encoded anew."""

    def start():
        encoder = Encoder(tokenizer)

        def one(text: str | None, edits: list | None) -> tuple[int, int, int, int]:
            text, edits = text or "", [e for e in edits or [] if e]
            if not edits:
                total = len(encoder.encode(text)) // 4
                return total, total, 0, 0
            tree = TokenTree(encoder, text)
            before = tree.total
            for e in edits:
                tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
            return before, tree.total, len(edits), tree.reencoded

        def work(ids, texts, edits):
            found = [one(t, e) for t, e in zip(texts.to_pylist(), edits.to_pylist())]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays([ids, *columns], names)

        return work

    names = ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_reencoded"]
    return map_rows(edited, ["doc_id", "text", "edits"], start, ", ".join(f"{n} long" for n in names))
