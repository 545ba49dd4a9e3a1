"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved until the parts are short, the parts are encoded, and neighbours are
joined bottom-up. At a join, tokens are taken from both sides of the seam into a window
until the window begins and ends at a *safe cut*, and the window's bytes are encoded anew.

A safe cut is a place between a character that is no white space and an ASCII one that is. No match
of the pattern holds white space after anything else, so a match ends there in whatever
context the text stands; the pattern's only lookahead, ``\\s+(?!\\S)``, concerns matches
that end in white space, and none of those ends at a safe cut. Tokens outside the window
hence are final. Where a side has no safe cut, all of it enters the window.

Decoding needs no windows: bytes of halves are concatenated up the same tree.

Defined results: a null text counts as empty and has no tokens; strings of special tokens
are ordinary text; equal rows give equal results, an empty table an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kind_of

#: Characters of a part that is encoded at once, and ids of one that is decoded at once.
LEAF = 512
_SOLID = regex.compile(r"\S")
_GAP = regex.compile(r"[\x20\x09-\x0D]")
_SAFE = regex.compile(r"(?<=\S)(?=[\x20\x09-\x0D])")
_known: dict = {}


def encoder(path: str, pattern: str):
    """The encoder of a rank file, read once for each Python process."""
    import tiktoken

    if (path, pattern) not in _known:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _known[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _known[path, pattern]


class Tree:
    """Encodes and decodes by halves. ``leaf`` is the length in characters from which parts are split."""

    def __init__(self, encoding, leaf: int = LEAF):
        self.encoding, self.leaf = encoding, max(1, leaf)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(self.encode(left), left, self.encode(right), right)

    def join(self, a: list[int], left: str, b: list[int], right: str) -> list[int]:
        """Tokens of left + right, of which a and b are the tokens."""
        start, stop = self._last_cut(left, right), self._first_cut(left, right)
        keep_a = self._tokens_before(a, left, start)
        drop_b = self._tokens_until(b, right, stop)
        return a[:keep_a] + self.encoding.encode_ordinary(left[start:] + right[:stop]) + (b[drop_b:] if drop_b < len(b) else [])

    def _last_cut(self, left: str, right: str) -> int:
        """Where the window begins in left: its last safe cut, sought in windows that double."""
        if left and right and _SOLID.match(left[-1]) and _GAP.match(right[0]):
            return len(left)
        span = 64
        while True:
            low = max(0, len(left) - span)
            if cuts := [m.start() for m in _SAFE.finditer(left, low)]:
                return cuts[-1]
            if not low:
                return 0
            span *= 2

    def _first_cut(self, left: str, right: str) -> int:
        """Where the window ends in right: its first safe cut, or its end."""
        if left and right and _SOLID.match(left[-1]) and _GAP.match(right[0]):
            return 0
        found = _SAFE.search(right)
        return found.start() if found else len(right)

    def _tokens_before(self, ids: list[int], text: str, cut: int) -> int:
        """How many tokens stand before a cut, counted from the end of the text."""
        rest, n = len(text[cut:].encode("utf-8")), len(ids)
        while rest > 0:
            n -= 1
            rest -= len(self.encoding.decode_single_token_bytes(ids[n]))
        if rest:
            raise ValueError("a token crosses a safe cut")
        return n

    def _tokens_until(self, ids: list[int], text: str, cut: int) -> int:
        rest, n = len(text[:cut].encode("utf-8")), 0
        while rest > 0:
            rest -= len(self.encoding.decode_single_token_bytes(ids[n]))
            n += 1
        if rest:
            raise ValueError("a token crosses a safe cut")
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(encoder(ranks, pattern), leaf)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"].array, "ids": [tree.encode(x or "") for x in rows["text"]]})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(part, f"doc_id {kind_of(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and bytes of encoded rows."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(encoder(ranks, pattern))
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "bytes": [tree.decode([int(i) for i in ids]) for ids in rows["ids"]]})

    return encoded.mapInPandas(part, f"doc_id {kind_of(encoded, 'doc_id')}, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its ids decoded, in one pass."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(encoder(ranks, pattern), leaf)
        for rows in batches:
            out = []
            for text in rows["text"]:
                ids = tree.encode(text or "")
                out.append((len(ids), hashlib.sha256(_packed(ids)).hexdigest(), hashlib.sha256(tree.decode(ids)).hexdigest()))
            made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            made.insert(0, "doc_id", rows["doc_id"].array)
            yield made

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(part, f"doc_id {kind_of(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
