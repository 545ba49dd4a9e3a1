"""Document fingerprints by one-permutation MinHash (native: DataFrame operations only).

Shingles of five words are hashed once. The top eight bits of a hash name one of 256 bins, of
which each keeps its smallest hash. A bin that stays empty borrows from another one, drawn by a
hash of (bin, attempt) until a filled one is met (optimal densification); after some
attempts the draw goes on without replacement, by the smallest hash of (bin, filled bin). What each
bin holds is hashed with the bin, and the four low-order bits are packed into 16 longs. Two unlike
bins agree in these by chance once in 16 times, and ``likeness`` corrects for that.

To make the bins, a sentinel for each is appended to the hashes, all are sorted, and the first
of each bin is taken: a text's work is linear in its length but for that sort, and no array is
searched again and again.

Defined results: a text of one to four words is one shingle; a text without words (null: empty)
has the empty string as fingerprint, is like another such text (1.0) and unlike all others
(0.0). Documents are ordered by descending doc_id, null last, then by digest; rows that repeat
doc_id and text are one document and get equal rows. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, text_of, written

SHINGLE = 5
BINS, BITS = 256, 4
ATTEMPTS = 24
_PER_LONG = 64 // BITS
_LOW = (1 << 56) - 1
_GAPS = r"[ \t\n\x0B\f\r]+"


def with_fingerprint(rows: DataFrame, text: Column, name: str, width: int = SHINGLE) -> DataFrame:
    """Adds ``name``: 16 packed longs, or an empty array for a text without words.

    Each step is a column of its own and used more than once by the next, so that the optimizer
    keeps it out of the lambdas that read it.
    """
    columns = rows.columns
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    step = rows.withColumn("__bare", bare)
    words = F.when(F.length("__bare") > 0, F.transform(F.split("__bare", _GAPS), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("__w", words).withColumn("__n", F.size("__w"))
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.col("__n") - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(width)]))
    sentinels = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(_LOW)))
    step = step.withColumn("__s", F.sort_array(F.concat(F.when(F.col("__n") > 0, shingles).otherwise(F.array().cast("array<bigint>")), sentinels)))
    bin_of = lambda x: F.shiftright(x, 56)
    step = step.withColumn("__d", F.filter("__s", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col("__s"), i - 1)))))
    low = F.lit((1 << BITS) - 1)
    full = lambda x: x.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW)
    step = step.withColumn("__f", F.filter("__d", full)).withColumn("__e", F.transform("__d", lambda x: F.when(full(x), x)))

    def borrowed(i: Column) -> Column:
        drawn = [F.get(F.col("__e"), F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS)]
        rest = F.array_min(F.transform("__f", lambda x: F.struct(F.xxhash64(i, bin_of(x)).alias("rank"), x.alias("value"))))
        return F.coalesce(*drawn, rest["value"])

    # the bin takes part in the kept bits: else a text of one shingle agrees in all bins or none, by chance
    step = step.withColumn("__v", F.transform("__e", lambda x, i: F.xxhash64(F.coalesce(x, borrowed(i)), i).bitwiseAND(low)))

    def packed(g: Column) -> Column:
        parts = [F.shiftleft(F.get(F.col("__v"), g * _PER_LONG + k), BITS * (_PER_LONG - 1 - k)) for k in range(_PER_LONG)]
        return reduce(Column.bitwiseOR, parts)

    pack = F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), packed)
    step = step.withColumn(name, F.when(F.col("__n") > 0, pack).otherwise(F.array().cast("array<bigint>")))
    return step.select(*columns, name)


def as_string(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two packed fingerprints, from 0 to 1."""
    ones = F.lit(int("1" * (64 // BITS), 16))

    def unlike(x: Column) -> Column:
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(any_bit.bitwiseAND(ones))

    different = F.aggregate(F.zip_with(a, b, lambda x, y: unlike(x.bitwiseXOR(y))), F.lit(0), lambda sum_, n: sum_ + n)
    chance = 2.0**-BITS
    estimate = F.greatest((1 - different / BINS - chance) / (1 - chance), F.lit(0.0))
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(estimate)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (string) for each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return with_fingerprint(rows, F.col("text"), "packed").select("doc_id", as_string(F.col("packed")).alias("fingerprint"))


def _key(id_col: str, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.lit("\x01"), text)))


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """key, doc_id, n_chars, packed, prev_key, prev_half: each document and what it follows in the order.

    Also whether any row repeats another's doc_id and text.

    Ranges of the order are numbered and written; within a range neighbours are next to each
    other, and between ranges only their first and last rows, one of each for a range, meet.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _key(id_col, text).alias("key"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    # written first: the range partitioner samples its input, which would make every fingerprint a second time
    made = written(with_fingerprint(rows, F.col("text"), "packed").drop("text"), "fingerprints")
    rows = written(made.repartitionByRange("doc_id", "key").withColumn("part", F.spark_partition_id()), "fingerprint-order")
    discard(made)
    repeated = not rows.groupBy("key").count().where("count > 1").isEmpty()
    if repeated:
        rows = rows.dropDuplicates(["part", "key"])
    one = F.struct("doc_id", "key", "n_chars")
    falling = Window.partitionBy("part").orderBy(F.desc("doc_id"), F.desc("key"))
    ends = rows.groupBy("part").agg(F.min(one).alias("last"))
    above = F.lead("last").over(Window.orderBy("part"))
    lowest = F.first("last").over(Window.orderBy("part"))  # what the first document follows
    ends = ends.select("part", F.coalesce(above, lowest).alias("before"))
    placed = rows.withColumn("prev", F.lag(one).over(falling)).join(F.broadcast(ends), "part")
    prev = F.coalesce("prev", "before")
    placed = placed.select("key", "doc_id", "n_chars", "packed", prev["key"].alias("prev_key"), F.floor(prev["n_chars"] / 2).cast("int").alias("prev_half"))
    return written(placed, "fingerprint-neighbours"), repeated


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likenesses.

    Whole texts move once, to meet their neighbours' keys; then the beginnings that replace the
    second halves move to the documents that they edit.
    """
    order, repeated = _neighbours(docs, id_col, text_col)
    text = text_of(text_col)
    texts = docs.select(_key(id_col, text).alias("key"), text.alias("text")).join(order, "key")
    begin = texts.select(F.col("prev_key").alias("key"), F.col("text").substr(F.lit(1), F.col("prev_half")).alias("begin"), F.col("packed").alias("next_packed"))
    if repeated:
        begin = begin.dropDuplicates(["key"])
    own = texts.select("key", "doc_id", "n_chars", "packed", "text")
    edited = own.join(begin, "key").withColumn("edited", F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")), "begin"))
    edited = with_fingerprint(edited, F.col("edited"), "edited_packed")
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("packed")).alias("fingerprint"),
        as_string(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
