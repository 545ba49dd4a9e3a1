"""Exact dedup by skew-safe combining (native: DataFrame operations only).

Texts are grouped in three steps, each of which compares whole contents, never digests
alone: every map task combines its own copies, salted groups merge what the tasks kept,
and a last step combines the salts' winners. A group's size thus never decides how many
rows meet in one task: at most one row for each task, then one for each salt.

Defined results: a null text counts as empty, and empty texts are equal to each other. The
largest doc_id stays; rows that repeat both doc_id and text count as copies, and exactly
one of them stays. A null doc_id loses to any other. An empty table gives an empty result.
Extra columns, whatever their names, neither matter nor change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT_KEYS, digest_of, fresh, lookup, text_of, written

SALTS = 32


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Column | None) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (digest_of(text) if digest is None else digest).alias("digest"), text.alias("text"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """digest, text, keep_id, group_size: a row for each distinct content."""
    rows = _rows(docs, id_col, text_col, digest).withColumn("salt", F.spark_partition_id() % SALTS)
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.select("digest", "text", "keep_id", "n").repartition("digest")
    return winners.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept: a row for each row of ``docs``.

    ``digest`` may replace SHA-256 by another binary expression over the text, weak ones
    included: contents that share a digest are told apart by a join over whole texts.
    """
    contents = groups(docs, id_col, text_col, digest)
    by_digest = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    several = written(by_digest.where("group_size > 1"), "exact-groups")
    hot = several.orderBy(F.desc("group_size"), "digest").limit(HOT_KEYS).select("digest")
    rows = _rows(docs, id_col, text_col, digest)
    found = lookup(rows.select("doc_id", "digest"), several.where("contents = 1"), "digest", ["keep_id", "group_size"], hot)
    clashes = several.where("contents > 1").select("digest")
    if not clashes.isEmpty():
        found = found.join(clashes, "digest", "left_anti")
        told_apart = contents.join(clashes, "digest", "left_semi")
        found = found.unionByName(rows.join(told_apart, ["digest", "text"]).select(*found.columns))
    found = found.withColumn("keep_id", F.coalesce("keep_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    same = Window.partitionBy("doc_id", "digest", "keep_id")
    nth = F.row_number().over(same.orderBy("group_size"))
    return found.select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"), F.count(F.lit(1)).over(same).alias("times"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    one, two, mark = (fresh(docs, x) for x in ("kept_id", "kept_digest", "digest"))
    kept = written(assign(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(one), F.col("digest").alias(two), "times"), "exact-kept")
    winners = kept.select(one, two)
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(one)) & (digest_of(text_of(text_col)) == F.col(two))
    left = docs.join(winners, on, "left_semi")
    if not kept.where("times > 1").isEmpty():
        left = left.withColumn(mark, digest_of(text_of(text_col))).dropDuplicates([id_col, mark]).drop(mark)
    return left


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each document, dropped ones too."""
    return assign(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
