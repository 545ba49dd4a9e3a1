"""Repeats of windows of consecutive units (words, lines) over a whole corpus.

Occurrences travel packed: a row holds those of one batch of documents for one bucket of the
hash space, as a few bytes each. Batches combine their own occurrences first, so a
window that a third of all documents share sends one occurrence for each batch, not one for each document.
Buckets answer batches, again a row for each pair of them, and batches spread the answers over their documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .shared import rolling

#: Units that one batch combines at least; bounds a Python worker's memory.
BATCH_UNITS = 1_000_000
PACKED = "bucket int, batch long, direct boolean, docs binary, counts binary, hashes binary, places binary, blocks binary"
ANSWER = "batch long, docs binary, counts binary, places binary"
FOUND = "uid long, places binary"
COLUMNS = ["bucket", "batch", "direct", "docs", "counts", "hashes", "places", "blocks"]


def bucket_count(n_bytes: int, of_bytes: int = 8 << 20) -> int:
    """Buckets of the hash space, such that each serves about ``of_bytes`` of text."""
    return max(8, -(-n_bytes // of_bytes))


def in_batches(batches: Iterable[pd.DataFrame], units_of: Callable[[Iterable[str]], Iterable[np.ndarray]], extra: str | None = None, most: int = BATCH_UNITS) -> Iterator[tuple[np.ndarray, list[np.ndarray], list]]:
    """uids, units of each document and what column ``extra`` holds, as soon as there are ``most`` units; ``units_of`` gives those of each of many texts."""
    uids, units, more, total = [], [], [], 0
    for rows in batches:
        beside = rows[extra] if extra else [None] * len(rows)
        for uid, found, x in zip(rows["uid"], units_of(rows["text"]), beside, strict=True):
            uids.append(uid)
            units.append(found)
            more.append(x)
            total += len(found)
            if total >= most:
                yield np.array(uids, np.int64), units, more
                uids, units, more, total = [], [], [], 0
    if uids:
        yield np.array(uids, np.int64), units, more


def windows_of(units: list[np.ndarray], width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window that lies within one document, its document's number in the batch, and its place there."""
    lengths = np.array([len(x) for x in units], np.int64)
    flat = np.concatenate(units) if len(units) else np.empty(0, np.uint64)
    hashes = rolling(flat, width, seed)
    windows = np.maximum(lengths - width + 1, 0)
    doc = np.repeat(np.arange(len(units), dtype=np.int32), windows)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    return hashes[np.repeat(np.cumsum(lengths) - lengths, windows) + place], doc, place


def _packed(uid: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Documents, entries of each, and places as differences within a document; entries are sorted by both."""
    starts = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]]) if len(uid) else np.empty(0, np.int64)
    steps = np.diff(place, prepend=0)
    steps[starts] = place[starts]
    small = steps.astype("<u2") if steps.max(initial=0) < 1 << 16 else steps.astype("<u4")
    return uid[starts].astype("<i8").tobytes(), np.diff(np.r_[starts, len(uid)]).astype("<u4").tobytes(), small.tobytes()


def _unpacked(docs: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    uid = np.repeat(np.frombuffer(docs, "<i8"), n)
    steps = np.frombuffer(places, "<u2" if len(places) == 2 * len(uid) else "<u4").astype(np.int64)
    starts = np.cumsum(n) - n
    run = np.cumsum(steps)
    return uid, run - np.repeat(run[starts] - steps[starts], n)


def _row(bucket: int, batch: int, direct: bool, uid: np.ndarray, place: np.ndarray, hashes: np.ndarray, blocks: np.ndarray | None) -> tuple:
    docs, counts, places = _packed(uid, place)
    return (bucket, batch, direct, docs, counts, hashes.tobytes(), places, b"" if blocks is None else np.packbits(blocks).tobytes())


def _groups(key: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (key, second) stand together, and where each group of them starts."""
    order = np.argsort(key)
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]]
    if second is not None:
        s = second[order]
        if (~new[1:] & (s[1:] != s[:-1])).any():  # two contents under one 64-bit key
            order = np.lexsort((second, key))
            k, s = key[order], second[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
    return order, np.flatnonzero(new)


def pack(uids: np.ndarray, doc: np.ndarray, place: np.ndarray, key: np.ndarray, second: np.ndarray | None, block: np.ndarray | None, buckets: int, all_repeats: bool) -> Iterator[tuple]:
    """Rows of PACKED for one batch, whose documents stand in rising order of uid.

    The first of equal windows stands for all of them. The others are sent as ``direct``, for
    their repeat is known already; so is the first if ``all_repeats``.
    """
    if not len(key):
        return
    order, starts = _groups(key, second)
    earliest = np.minimum.reduceat(order, starts)
    first = np.zeros(len(key), bool)
    first[earliest] = True
    known = ~first
    if all_repeats:
        many = np.diff(np.r_[starts, len(key)]) > 1
        known[earliest[many]] = True
    if block is not None:
        merged = np.maximum.reduceat(block[order].astype(np.uint8), starts).astype(bool)
        block = block.copy()
        block[earliest] = merged
    if known.any():
        at = np.flatnonzero(known)
        spread = int(key[at[0]] % np.uint64(buckets))
        yield _row(spread, int(uids[0]), True, uids[doc[at]], place[at], np.empty(0, np.uint8), None)
    at = np.flatnonzero(first)
    bucket = (key[at] % np.uint64(buckets)).astype(np.int64)
    turn = np.argsort(bucket, kind="stable")
    at, bucket = at[turn], bucket[turn]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = at[a:b]
        body = key[own].astype("<u8").view(np.uint8).reshape(-1, 8)
        body = body[:, 2:] if second is None else np.hstack([body, second[own].astype("<u8").view(np.uint8).reshape(-1, 8)])
        yield _row(int(bucket[a]), int(uids[0]), False, uids[doc[own]], place[own], np.ascontiguousarray(body), None if block is None else block[own])


def _hashes(row, n: int, wide: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """key, second, block of one packed row's n entries."""
    body = np.frombuffer(row.hashes, np.uint8)
    if wide:
        both = np.ascontiguousarray(body.reshape(n, 16)).view("<u8")
        return both[:, 0], both[:, 1], None
    key = np.zeros((n, 8), np.uint8)
    key[:, :6] = body.reshape(n, 6)
    return key.view("<u8")[:, 0], None, np.unpackbits(np.frombuffer(row.blocks, np.uint8), count=n).astype(bool)


def resolve(rows: pd.DataFrame, wide: bool) -> pd.DataFrame:
    """Of one bucket: an answer to each batch, the places whose window is met again.

    ``wide``: exact windows with 128-bit hashes; all but the earliest occurrence (uid, place) are
    returned. Else anchors: all occurrences of hashes that occur twice, one of them a block.
    """
    out = [(row.batch, row.docs, row.counts, row.places) for row in rows.itertuples(index=False) if row.direct]
    rows = rows[~rows["direct"]]
    if len(rows):
        entries = [_unpacked(row.docs, row.counts, row.places) for row in rows.itertuples(index=False)]
        hashes = [_hashes(row, len(e[0]), wide) for row, e in zip(rows.itertuples(index=False), entries, strict=True)]
        k = np.concatenate([h[0] for h in hashes])
        order, starts = _groups(k, np.concatenate([h[1] for h in hashes]) if wide else None)
        sizes = np.diff(np.r_[starts, len(k)])
        met = np.zeros(len(k), bool)
        if wide:
            rest = order[np.repeat(sizes > 1, sizes)]
            group = np.repeat(np.arange(len(starts)), sizes)[np.repeat(sizes > 1, sizes)]
            u, p = (np.concatenate([e[i] for e in entries])[rest] for i in (0, 1))
            turn = np.lexsort((p, u, group))
            if len(turn):
                met[rest[turn[np.r_[False, group[turn][1:] == group[turn][:-1]]]]] = True
        else:
            blocks = np.maximum.reduceat(np.concatenate([h[2] for h in hashes])[order].astype(np.uint8), starts).astype(bool)
            met[order[np.repeat((sizes > 1) & blocks, sizes)]] = True
        at = 0
        for batch, (uid, place) in zip(rows["batch"], entries, strict=True):
            own = met[at : at + len(uid)]
            at += len(uid)
            if own.any():
                out.append((batch, *_packed(uid[own], place[own])))
    return pd.DataFrame(out, columns=["batch", "docs", "counts", "places"])


def spread(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: its documents' places, from the answers of all buckets."""
    entries = [_unpacked(row.docs, row.counts, row.places) for row in rows.itertuples(index=False)]
    uid, place = (np.concatenate([e[i] for e in entries]) for i in (0, 1))
    order = np.lexsort((place, uid))
    uid, place = uid[order], place[order]
    edges = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1], True])
    return pd.DataFrame({"uid": uid[edges[:-1]], "places": [place[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]})


def places_of(packed: bytes | None) -> np.ndarray:
    """Sorted places of one document (null: none)."""
    return np.empty(0, np.int64) if packed is None else np.unique(np.frombuffer(packed, "<u4")).astype(np.int64)


def resolved(packed: DataFrame, wide: bool) -> DataFrame:
    """FOUND, a row for each document that has places."""
    answers = packed.groupBy("bucket").applyInPandas(lambda rows: resolve(rows, wide), ANSWER)
    return answers.groupBy("batch").applyInPandas(spread, FOUND)


def later_windows(rows: DataFrame, units_of: Callable[[], Callable[[Iterable[str]], Iterable[np.ndarray]]], width: int, buckets: int, hot: str | None = None, anchor: int = 0, skip: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """FOUND: starts of windows of ``width`` units whose sequence also starts earlier.

    With ``hot``, a column of packed anchor places, only windows that hold a whole anchor of
    ``anchor`` units at one of these are looked at.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for uids, units, near in in_batches(batches, units_of(), hot):
            order = np.argsort(uids, kind="stable")
            uids, units, near = uids[order], [units[i] for i in order], [near[i] for i in order]
            key, doc, place = windows_of(units, width, 11)
            second, _, _ = windows_of(units, width, 12)
            keep = np.ones(len(key), bool)
            if hot:
                keep = _holds_anchor(units, near, width, anchor)
            if skip is not None:
                keep &= ~skip(units)
            yield pd.DataFrame(list(pack(uids, doc[keep], place[keep], key[keep], second[keep], None, buckets, False)), columns=COLUMNS)

    columns = ["uid", "text", *([hot] if hot else [])]
    return resolved(rows.select(*columns).mapInPandas(part, PACKED), True)


def _holds_anchor(units: list[np.ndarray], near: list, width: int, anchor: int) -> np.ndarray:
    """For each window inside a document, in order: whether an anchor place lies in its first width - anchor + 1 places."""
    out = []
    for x, packed in zip(units, near, strict=True):
        n = len(x) - width + 1
        if n <= 0:
            continue
        marks = np.zeros(len(x) + 2, np.int64)
        marks[places_of(packed) + 1] = 1
        total = np.cumsum(marks)
        start = np.arange(n)
        out.append(total[start + width - anchor + 1] > total[start])
    return np.concatenate(out) if out else np.empty(0, bool)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + width, n), -1)
    return np.cumsum(edges)[:n] > 0
