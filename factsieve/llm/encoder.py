"""Token ids of whole texts, chunk by chunk, equal to encoding each text as a whole.

The tokenizer at hand lower-cases, drops white space and marks word ends, so a blank always
separates: the ids of a text are those of its blank-separated chunks, one after another, and the
ids of frequent chunks are remembered. New chunks of plain characters are cut into pre-tokens
and merged by byte ranks, which is many times faster and gives the same ids wherever each merge
joins the two parts that earlier merges make of its token (a test shows that for the whole
table). Other chunks (control characters, combining marks, special tokens, other scripts) go to
the tokenizer itself, as do all texts where the file is of another kind.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# The tokenizer's own pre-token pattern, and its mark for the end of a word.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Characters for which lower-casing and composing are the same here as in the tokenizer.
_PLAIN = re.compile("[ -~¡-¬®-įı-ʯ]*")
#: Longest chunk that is remembered, and characters of remembered chunks at most; with their ids and
#: the table's own entries some 20 bytes a character.
LONGEST = 64
REMEMBERED = 1 << 22

_END = "\x01"
_BLANK = 0x20


def byte_symbols() -> dict[str, int]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    Chunks of at most ``LONGEST`` characters are remembered, up to ``remembered`` characters of
    them; longer ones (scripts without blanks, encoded data) are encoded each time.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.kept = 0  # characters of the known chunks
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = steps[0].get("pattern", {}).get("Regex")
        self.plain = pattern == PRE_TOKEN and spec["model"].get("end_of_word_suffix") == WORD_END
        if self.plain:
            self.pre_tokens = regex.compile(PRE_TOKEN)
            self.merger, self.id_of_rank = self._merger(spec["model"])

    @staticmethod
    def _merger(model: dict) -> tuple[tiktoken.Encoding, np.ndarray]:
        """Byte ranks with one byte for the word end, and the id of each rank."""
        byte_of, end = byte_symbols(), _END.encode()

        def name(token: str) -> bytes:
            word, marked = (token[: -len(WORD_END)], end) if token.endswith(WORD_END) else (token, b"")
            return bytes(byte_of[c] for c in word) + marked

        # single bytes, then bytes with the word end, then the merges in their order
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + end: 256 + b for b in range(256)}
        ids = {name(token): i for token, i in model["vocab"].items() if token not in ("<|startoftext|>", "<|endoftext|>")}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[name(a + b)] = 512 + k
        table = np.full(max(ranks.values()) + 1, -1, np.int64)
        for token, rank in ranks.items():
            table[rank] = ids.get(token, -1)
        table[_BLANK] = -1
        words = rf"[^ {_END}]+{_END}| "
        return tiktoken.Encoding("own", pat_str=words, mergeable_ranks=ranks, special_tokens={}), table

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def split(self, text: str) -> list[str]:
        """Chunks that can be encoded apart."""
        if not self.plain:
            return [text] if text else []
        return [c for c in text.replace("\n", " ").split(" ") if c]

    def ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        out = list(map(self.known.get, chunks))
        if None in out:
            new = self._encoded(list({c for c, found in zip(chunks, out) if found is None}))
            out = [new[c] if found is None else found for c, found in zip(chunks, out)]
            short = {c: v for c, v in new.items() if len(c) <= LONGEST}
            self.kept += sum(map(len, short))
            if self.kept > self.remembered:
                self.known, self.kept = {}, 0
            else:
                self.known.update(short)
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.ids(self.split(text))) if text else b""

    def _simple(self, text: str) -> bool:
        return self.plain and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of distinct chunks."""
        joined, found = " ".join(chunks), {}
        if not self._simple(joined):
            found = {c: self.whole(c) for c in chunks if not self._simple(c)}
            chunks = [c for c in chunks if c not in found]
            joined = " ".join(chunks)
        if not chunks:
            return found
        ranks = np.array(self.merger.encode_ordinary(self.pre_tokens.sub(rf"\g<0>{_END}", joined.lower())), np.int64)
        cuts = np.flatnonzero(ranks == _BLANK)
        data = self.id_of_rank[np.delete(ranks, cuts)].astype(np.uint32).tobytes()
        at = [0, *((cuts - np.arange(len(cuts))) * 4).tolist(), len(data)]
        found.update((c, data[a:b]) for c, a, b in zip(chunks, at, at[1:]))
        return found
