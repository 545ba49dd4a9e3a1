"""A bounded sample of labelled rows, for the two classifiers that are fitted on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of


def fold(id_col: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def labels_of(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id, y: one 0/1 label for each document outside the held-out fold; the larger of labels that disagree."""
    rows = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold("doc_id", folds) != held_out))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """text, y of at most ``most`` rows of either class, in the order of a hash, and how many rows each class has in all."""
    known = labels_of(labels, label, folds, held_out)
    sizes = {int(r["y"]): int(r["count"]) for r in known.groupBy("y").count().collect()}  # two rows
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(*order).limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select(F.col("doc_id").alias("__id"), "y")
    # 2 * most rows of two numbers: the bound of what is sent to all executors
    rows = docs.select(F.col(f"`{id_col}`").alias("__doc"), text_of(text_col).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    return rows.select("__doc", "text", "y"), sizes


def collected(features: DataFrame) -> pd.DataFrame:
    """Bounded by the sample; in an order that does not depend on how tasks finish."""
    return features.toPandas().sort_values("__doc", kind="stable", ignore_index=True)
