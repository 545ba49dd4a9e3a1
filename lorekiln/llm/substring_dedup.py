"""Substring dedup by fixed-block anchors.

Non-overlapping reference blocks of half a window index every document; every rolling window of
a block's length probes that index. Of two equal windows, the one that stands earlier holds a
whole reference block, wherever it starts, so both hold a place at which a probe and a block
agree (an anchor). Hits are extended to windows around their anchors, which are compared by
128-bit hashes of all their words, and what remains, merged, are the maximal exact repeats. They are not
extended along pairs of documents: a window's earlier copy may stand in another document than
its anchor's earliest one, and all pairs of a passage's holders would have to be looked at.

Probes go to buckets of the hash space as six bytes of hash and about two of place each, after
batches have combined their own. No pairs are made: a passage with n occurrences gives n rows
at most.

Defined results: a null text has no words; a document shorter than a window loses nothing;
windows are judged on the input. Rows that repeat a doc_id, or have none, count as documents
of their own in the order of doc_id (null last) and text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import COLUMNS, PACKED, bucket_count, covered, in_batches, later_windows, pack, places_of, resolved, windows_of
from .shared import numbered, release_shuffles, text_bytes, word_hashes, written

WINDOW = 20


def _words():
    return word_hashes


def anchors(rows: DataFrame, block: int, buckets: int) -> DataFrame:
    """uid and packed places of probes and blocks that agree with another one."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for uids, units, _ in in_batches(batches, _words()):
            order = np.argsort(uids, kind="stable")
            key, doc, place = windows_of([units[i] for i in order], block, 10)
            yield pd.DataFrame(list(pack(uids[order], doc, place, key, None, place % block == 0, buckets, True)), columns=COLUMNS)

    return resolved(rows.select("uid", "text").mapInPandas(part, PACKED), False)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words, as [start, end) pairs), kept (the other words, joined by a space)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    spark, block = docs.sparkSession, window // 2
    rows = numbered(docs, id_col, text_col)
    buckets = bucket_count(text_bytes(rows))
    found = written(anchors(rows, block, buckets), "substring-anchors")
    release_shuffles(spark)
    near = rows.select("uid", "text").join(found.withColumnRenamed("places", "anchors").hint("merge"), "uid")
    later = written(later_windows(near, _words, window, buckets, "anchors", block), "substring-later")
    release_shuffles(spark)
    starts = later.withColumnRenamed("places", "starts")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in batches:
            out = []
            for text, packed in zip(group["text"], group["starts"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if packed is None:
                    out.append((len(words), 0, [], b" ".join(words).decode("utf-8", "surrogatepass")))
                    continue
                gone = covered(places_of(packed), window, len(words))
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                out.append((len(words), int(gone.sum()), edges.reshape(-1, 2).tolist(), kept.decode("utf-8", "surrogatepass")))
            made = pd.DataFrame(out, columns=["n_words", "n_removed", "spans", "kept"])
            made.insert(0, "doc_id", group["doc_id"].array)
            yield made

    kind = dict(rows.dtypes)["doc_id"]
    return rows.join(starts.hint("merge"), "uid", "left").select("doc_id", "text", "starts").mapInPandas(part, f"doc_id {kind}, n_words long, n_removed long, spans array<array<long>>, kept string")


def report(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
