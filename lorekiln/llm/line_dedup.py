"""Line dedup by overlapping windows of three lines.

Each three consecutive lines of a document are hashed (128 bits); windows that also start
earlier (smaller doc_id, or earlier in the same document) are found over the whole corpus, and
the lines that they cover, merged, are removed.

Defined results: lines are parted by line feeds and compared unchanged; windows of blank lines
alone do not count as repeats; documents of one or two lines lose nothing; a null text is one
empty line. Rows that repeat a doc_id, or have none, count as documents of their own in the
order of doc_id (null last) and text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import bucket_count, covered, later_windows, places_of
from .shared import numbered, release_shuffles, text_bytes, written

WINDOW = 3


def _lines():
    """A line's hash is even; a blank line's is odd, which is how windows of blank lines are told."""

    def of(text: str | None) -> np.ndarray:
        lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
        return np.array([xxhash.xxh3_64_intdigest(x) & ~1 if x.strip() else xxhash.xxh3_64_intdigest(x) | 1 for x in lines], np.uint64)

    return lambda texts: map(of, texts)


def line_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the other lines, joined by line feeds)."""
    rows = numbered(docs, id_col, text_col)

    def blank(units: list[np.ndarray]) -> np.ndarray:
        out = [np.lib.stride_tricks.sliding_window_view(x & np.uint64(1), window).all(axis=1) for x in units if len(x) >= window]
        return np.concatenate(out) if out else np.empty(0, bool)

    later = written(later_windows(rows, _lines, window, bucket_count(text_bytes(rows), 64 << 20), skip=blank), "line-later")
    release_shuffles(docs.sparkSession)
    starts = later.withColumnRenamed("places", "starts")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in batches:
            out = []
            for text, packed in zip(group["text"], group["starts"], strict=True):
                lines = (text or "").split("\n")
                gone = covered(places_of(packed), window, len(lines))
                out.append((len(lines), int(gone.sum()), "\n".join(x for x, y in zip(lines, gone.tolist(), strict=True) if not y)))
            made = pd.DataFrame(out, columns=["n_lines", "n_removed", "kept"])
            made.insert(0, "doc_id", group["doc_id"].array)
            yield made

    kind = dict(rows.dtypes)["doc_id"]
    return rows.join(starts.hint("merge"), "uid", "left").select("doc_id", "text", "starts").mapInPandas(part, f"doc_id {kind}, n_lines long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
