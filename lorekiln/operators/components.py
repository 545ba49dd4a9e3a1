"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, written


def _roots(start: DataFrame) -> DataFrame:
    """uid, next: the root of each node of a written table (uid, parent), whose parents are never larger than their nodes.

    Paths halve with each round; each round's table replaces the one before.
    """
    table, parents = start, start
    while True:
        above = parents.select(F.col("uid").alias("parent"), F.col("parent").alias("next"))
        moved = written(parents.join(above, "parent").select("uid", "parent", "next"), "roots")
        discard(table)
        if moved.where("next <> parent").isEmpty():
            return moved
        table, parents = moved, moved.select("uid", F.col("next").alias("parent"))


def connected(edges: DataFrame) -> DataFrame:
    """uid, label for each end of an edge (a, b); the label is the smallest uid that can be reached.

    Every round each node points to the smallest of its neighbours and itself, the trees that result
    are contracted to their roots, and only edges between different roots go on. Minima are
    combined before they are shuffled and neighbours never gathered. Rounds are written tables, so a lost
    executor costs a round's work at most.
    """
    pairs = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = edges.select(F.col("a").alias("uid")).union(edges.select("b")).distinct()
    labels = written(ends.select("uid", F.col("uid").alias("label")), "labels")
    while not pairs.isEmpty():
        down = pairs.groupBy(F.col("b").alias("uid")).agg(F.min("a").alias("parent"))
        tops = pairs.select(F.col("a").alias("uid")).distinct().select("uid", F.col("uid").alias("parent"))
        roots = _roots(written(down.unionByName(tops).groupBy("uid").agg(F.min("parent").alias("parent")), "parents"))
        to = lambda name: roots.select(F.col("uid").alias(name), F.col("next").alias(f"root_{name}"))
        far = pairs.join(to("a"), "a").join(to("b"), "b").where("root_a <> root_b")
        before = pairs, labels, roots
        pairs = written(far.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
        labels = written(labels.join(to("label"), "label", "left").select("uid", F.coalesce("root_label", "label").alias("label")), "labels")
        discard(*before)
    discard(pairs)
    return labels
