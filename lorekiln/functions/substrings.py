"""Which of many texts stand inside others: rolling hashes over UTF-8 bytes, in vector operations.

A text is sought by the hash of its first bytes and, where that is met, by the hash of all of it. What is met is given
back as it stands in the searched text, so an accidental hash finds a substring that nobody asked for, and nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bytes at a text's beginning that are looked for: the largest of these powers of two that it has.
WIDEST = 32
#: Bytes that are searched together, and pairs of places and lengths that are hashed together.
LOT, PAIRS = 2 << 20, 1 << 20

_RANDOM = np.random.default_rng(77).integers(0, 2**63, 256 + 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_BYTE, _STEPS = _RANDOM[:256], _RANDOM[256:]
_BASE = int(_STEPS[15])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) or further, modulo 2^64; kept for the next lot."""
    if len(_powers.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


class _Hashed:
    """Hashes of all substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        self.n, self.bytes = len(data), _OF_BYTE[data]
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.bytes * _power(_BASE, self.n + 1)[: self.n], out=self.sums[1:])

    def windows(self) -> Iterator[tuple[int, np.ndarray]]:
        """width, hash of as many bytes from each place, as far as there are any."""
        width, h = 1, self.bytes
        while True:
            yield width, h
            if width == WIDEST or len(h) <= width:
                return
            h = h[:-width] * _STEPS[width.bit_length()] + h[width:] * _STEPS[width.bit_length() + 6]
            h ^= h >> np.uint64(31)
            width *= 2

    def wholes(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of ``size`` bytes from each place."""
        whole = (self.sums[at + size] - self.sums[at]) * _power(pow(_BASE, -1, 1 << 64), self.n + 1)[at]
        whole = (whole ^ (whole >> np.uint64(32))) * _STEPS[14]
        return (whole ^ (whole >> np.uint64(29))) + size.astype(np.uint64) * _STEPS[13]


def described(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size in bytes, hash of the first bytes and hash of the whole of each text; none may be empty."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    at = np.cumsum(size) - size
    hashed = _Hashed(np.frombuffer(b"".join(raw), np.uint8))
    head = np.zeros(len(raw), np.uint64)
    for width, h in hashed.windows():
        mine = np.flatnonzero(size >= width)  # wider windows replace narrower ones
        head[mine] = h[at[mine]]
    return size, head, hashed.wholes(at, size)


class Wanted:
    """Texts that are sought, as ``described``; those that were met are sought no longer."""

    def __init__(self, size: np.ndarray, head: np.ndarray, whole: np.ndarray):
        self.size, self.head, self.whole = size, head, whole
        self._arrange()

    def _arrange(self) -> None:
        """By width: marks of hashes of first bytes, these in order, where their sizes begin, how many they have; sizes; whole hashes in order."""
        self.by: dict[int, tuple] = {}
        width = np.int64(1) << np.minimum(np.log2(np.maximum(self.size, 1)).astype(np.int64), WIDEST.bit_length() - 1)
        for w in np.unique(width).tolist():
            mine = width == w
            pairs = np.unique(np.rec.fromarrays([self.head[mine], self.size[mine]], names="head,size"))
            heads, first, count = np.unique(pairs["head"], return_index=True, return_counts=True)
            bits = min(26, max(16, int(len(heads)).bit_length() + 5))
            marks = np.zeros(1 << bits, bool)
            marks[heads >> np.uint64(64 - bits)] = True
            self.by[w] = marks, np.uint64(64 - bits), heads, first, count, pairs["size"].copy(), np.unique(self.whole[mine])

    def within(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Place and size of one substring for each whole hash that ``data`` holds."""
        hashed, met = _Hashed(data), []
        for width, h in hashed.windows():
            if width not in self.by:
                continue
            marks, shift, heads, first, count, sizes, wholes = self.by[width]
            at = np.flatnonzero(marks[h >> shift])
            group = np.minimum(np.searchsorted(heads, h[at]), len(heads) - 1)
            hit = heads[group] == h[at]
            at, group = at[hit], group[hit]
            ends = np.cumsum(count[group])
            start = 0
            while start < len(at):  # some pairs of places and sizes at a time; one place has all of its sizes
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                n = count[group[start:stop]]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place, size = np.repeat(at[start:stop], n), sizes[np.repeat(first[group[start:stop]], n) + nth]
                fits = place + size <= hashed.n
                place, size = place[fits], size[fits]
                whole = hashed.wholes(place, size)
                same = wholes[np.minimum(np.searchsorted(wholes, whole), len(wholes) - 1)] == whole
                values, one = np.unique(whole[same], return_index=True)
                yield from zip(place[same][one].tolist(), size[same][one].tolist(), strict=True)
                met.append(values)
                start = stop
        met = np.concatenate(met) if met else np.empty(0, np.uint64)
        if len(met):
            left = ~np.isin(self.whole, met)
            self.size, self.head, self.whole = self.size[left], self.head[left], self.whole[left]
            self._arrange()

    def search(self, texts: Iterator[str | None]) -> Iterator[str]:
        """Substrings of the texts that are wanted; some come repeatedly."""
        held, size = [], 0

        def lot() -> Iterator[str]:
            raw = b"\xff".join(held)  # a byte that no text has
            if len(self.size) and raw:
                for at, n in self.within(np.frombuffer(raw, np.uint8)):
                    yield raw[at : at + n].decode("utf-8", "surrogatepass")

        for text in texts:
            if text and len(self.size):
                held.append(text.encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size >= LOT:
                    yield from lot()
                    held, size = [], 0
        yield from lot()
