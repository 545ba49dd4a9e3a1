"""Mixing sources to target weights by weighted fair queueing (native: DataFrame operations only).

Sources weigh 5, 2, 1, repeating, by code point order (null last). Targets share the size of
the whole corpus by weight, stop at three times a source's size, and the excess is shared
again by weight among the others (water filling, in closed form over the sorted sources).

Each source queues its documents in the order of a seeded digest, up to three times over. A
document's virtual finish time is its source's cumulative size at that place divided by the
source's target. All queues are merged in the order of these times, and the mix is what
comes before the total budget is used up.

Nothing is gathered by source: cumulative sizes are added up within (source, digest range)
cells and offset by the sums of earlier cells. The merged queue is one global range sort of slim entries: sizes
are added up within each range, ranges are offset by the sums of earlier ones, and what comes after the
budget is cut off.

Defined results: null texts have size 0; documents of size 0 are never taken and never in the
way; a null source is a source of its own; rows that repeat a doc_id queue separately in
``plan`` and share the smallest number of copies in ``mix``; an empty table gives an empty
result. Equal finish times go by source, copy and digest. The order depends on doc_id and the seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, fresh, text_of, written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    key = F.md5(F.concat(F.lit(seed + "\x01"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    source = F.col(f"`{source_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("queue"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        key.alias("place"),
        F.substring(key, 1, 3).alias("cell"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """queue, source_size, target. A queue is 's' and the source's name, or 't', which sorts after all of these, for null."""
    by_source = sized.groupBy("queue").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy("queue")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn % len(WEIGHTS) + 1).cast("int"))
    shares = by_source.withColumn("weight", weight).withColumn("top", (MOST_TIMES * F.col("source_size")).cast("double"))
    rising = Window.orderBy(F.col("top") / F.col("weight"), "queue")
    before = F.coalesce(F.sum("top").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - before) / left).alias("level")
    filled = shares.select("*", level).withColumn("full", F.col("top") < F.col("weight") * F.col("level"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return filled.select("queue", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.col("weight") * final).alias("target"))


def _queued(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds source_size, target and ``upto``, the source's cumulative size with this document."""
    cells = sized.groupBy("queue", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("queue").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("queue", "cell", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("offset")).join(goals, "queue")
    within = Window.partitionBy("queue", "cell").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return sized.join(cells, ["queue", "cell"]).withColumn("upto", F.col("offset") + F.sum("size").over(within))


def _finish(turn: Column) -> Column:
    return (turn * F.col("source_size") + F.col("upto")) / F.when(F.col("target") > 0, F.col("target"))


def _taken(queued: DataFrame, budget: int) -> DataFrame:
    """queue, upto, copies: how often the mix takes each row of positive size; ``upto`` tells the rows of a queue apart."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1))).alias("turn")
    entries = queued.where("size > 0 AND target > 0").select("queue", "place", "size", turns, "source_size", "upto", "target")
    entries = entries.select("queue", "place", "size", "turn", "upto", _finish(F.col("turn")).alias("finish"))
    order = ["finish", "queue", "turn", "place", "upto"]
    merged = written(entries.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-order")
    parts = merged.groupBy("part").agg(F.sum("size").alias("part_size"))  # a row for each partition
    earlier = F.coalesce(F.sum("part_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier.alias("before")).where(F.col("before") < budget)
    within = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = merged.join(F.broadcast(parts), "part").withColumn("total", F.col("before") + within).where(F.col("total") <= budget)
    found = written(taken.groupBy("queue", "upto").agg(F.count(F.lit(1)).alias("copies")), "mix-taken")
    discard(merged)
    return found


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, queue, place, size, source_size, target, finish, copies, taken for each row; ``finish`` is the first virtual finish time."""
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    queued = written(_queued(sized, targets(sized)), "mix-queues")
    budget = sized.agg(F.sum("size")).first()[0] or 0
    taken = _taken(queued, budget).select("queue", F.col("upto").alias("at"), F.col("copies").alias("some"))
    here = F.when(F.col("size") > 0, F.col("upto")) == F.col("at")
    rows = queued.join(taken, (queued["queue"] == taken["queue"]) & here, "left").drop(taken["queue"])
    rows = rows.select("doc_id", "queue", "place", "size", "source_size", "target", _finish(F.lit(0)).alias("finish"), F.coalesce("some", F.lit(0)).cast("long").alias("copies"))
    return rows.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself, in the merged order: each row of ``docs`` as often as the mix takes it, with all its columns."""
    names = {x: fresh(docs, "mix_" + x) for x in ("id", "queue", "copies", "finish", "round", "place", "turn")}
    rows = plan(docs, id_col, text_col, source_col, seed)
    step = F.max(F.col("source_size") / F.when(F.col("target") > 0, F.col("target")))
    rows = rows.groupBy("doc_id", "queue").agg(F.min("copies").alias("copies"), F.min("finish").alias("finish"), step.alias("round"), F.min("place").alias("place"))
    rows = rows.where("copies > 0").select(*[F.col({"id": "doc_id"}.get(x, x)).alias(names[x]) for x in ("id", "queue", "copies", "finish", "round", "place")])
    queue = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("t"))
    joined = docs.join(rows, F.col(f"`{id_col}`").eqNullSafe(F.col(names["id"])) & (queue == F.col(names["queue"])))
    joined = joined.withColumn(names["turn"], F.explode(F.sequence(F.lit(0), F.col(names["copies"]).cast("int") - 1)))
    order = [F.col(names["finish"]) + F.col(names["turn"]) * F.col(names["round"]), F.col(names["queue"]), F.col(names["turn"]), F.col(names["place"])]
    return joined.orderBy(*order).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")
