"""What several operators of this package use: written tables, word hashes and skew-safe lookups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, new_path, release_shuffles, remove, shared_dir, written

__all__ = ["discard", "new_path", "release_shuffles", "remove", "shared_dir", "written"]

#: A word is a longest run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys that a lookup sends by broadcast at most; a key outside these holds under 1/HOT_KEYS of the rows.
HOT_KEYS = 1000


def text_of(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def digest_of(text: Column) -> Column:
    """32 bytes of SHA-256 over the UTF-8 form."""
    return F.unhex(F.sha2(text, 256))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as a column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column, for a schema that keeps it."""
    return df.select(F.col(f"`{column}`").alias("x")).schema["x"].dataType.simpleString()


def lookup(left: DataFrame, right: DataFrame, key: str, columns: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Left join of many rows with a table that is unique on ``key`` (binary), safe for hot keys.

    The at most ``HOT_KEYS`` keys of ``hot`` (default: those most frequent in ``left``) are
    joined by broadcast, which thus has a proven bound. Their rows take no part in the
    shuffled join that serves all other keys: there they carry a key that matches nothing
    and spreads them evenly.
    """
    if hot is None:
        hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), key).limit(HOT_KEYS).select(key)
    hot = right.join(F.broadcast(hot), key, "left_semi").limit(HOT_KEYS)
    hot_side = hot.select(F.col(key).alias("__hot_key"), *[F.col(c).alias(f"__hot_{c}") for c in columns])
    near = left.join(F.broadcast(hot_side), left[key] == F.col("__hot_key"), "left")
    spread = F.when(F.col("__hot_key").isNotNull(), F.unhex(F.hex(F.xxhash64(*[F.col(c) for c in left.columns])))).otherwise(F.col(key))
    near = near.withColumn("__key", spread)
    cold_side = right.select(F.col(key).alias("__cold_key"), *[F.col(c).alias(f"__cold_{c}") for c in columns])
    far = near.join(cold_side, F.col("__key") == F.col("__cold_key"), "left")
    return far.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col(f"__hot_{c}"), F.col(f"__cold_{c}")).alias(c) for c in columns])


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers made from a seed."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Bytes of text whose words are hashed together; bounds a Python worker's memory beside its longest text.
HASHED_BYTES = 4 << 20
#: Bytes of words that are hashed together; longer ones are hashed one by one.
LONG_WORD = 64


def _hashes_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``raw``, which begins with white space and ends with 9 bytes of it or more, a multiple of 8 in all.

    Words are taken eight bytes at a time, as two halves of aligned ones; their length goes in first.
    """
    data, aligned = np.frombuffer(raw, np.uint8), np.frombuffer(raw, "<u8")
    space = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, length = edges[::2], edges[1::2] - edges[::2]
    out = mixed(length.astype(np.uint64) * odd_numbers(1, 40)[0])
    left = np.flatnonzero(length <= LONG_WORD)
    at, more = starts[left], length[left]
    while len(left):
        shift = (at & 7).astype(np.uint64) * np.uint64(8)
        eight = (aligned[at >> 3] >> shift) | (aligned[(at >> 3) + 1] << np.uint64(1) << (np.uint64(63) - shift))
        eight &= np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(more, 8)).astype(np.uint64))
        out[left] = mixed(out[left] ^ eight)
        on = more > 8
        left, at, more = left[on], at[on] + 8, more[on] - 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + length[i]])
    return out, starts


def word_hashes(texts: Iterable[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text in order (null: none); ``lower`` takes A-Z as a-z.

    Texts are hashed some HASHED_BYTES at a time, in vector operations.
    """

    def lot(held: list[bytes]) -> Iterator[np.ndarray]:
        raw = b" " + b" ".join(held)
        raw += b" " * (16 - len(raw) % 8)
        hashes, starts = _hashes_of(raw.lower() if lower else raw)
        edges = np.searchsorted(starts, np.cumsum([1, *[len(x) + 1 for x in held]])).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield hashes[a:b]

    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= HASHED_BYTES:
            yield from lot(held)
            held, size = [], 0
    yield from lot(held)


def rolling(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive entries; shorter input gives none.

    Runs are put together from halves, so the work grows with the logarithm of the width.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a, b, c = odd_numbers(3, seed * 1009 + width)
    if width == 1:
        return mixed(words * a + c)
    half = rolling(words, width // 2, seed)
    out = mixed(half[:n] * a + half[width // 2 : width // 2 + n] * b + c)
    return mixed(out * b + words[width - 1 :] * a) if width % 2 else out


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid (long), doc_id, text: rows under a unique number that rises with doc_id.

    Usually that is doc_id itself. Where doc_ids are null or repeat, rows are numbered in the
    order of doc_id (null last) and text: ranges of the order are written, counted and offset.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty() and dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        return rows.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    ranged = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered-ranges")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = ranged.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return written(placed.select((F.col("__before") + within).cast("long").alias("uid"), "doc_id", "text"), "numbered")


def text_bytes(rows: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes of groups that go to one task are set by it."""
    return int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
