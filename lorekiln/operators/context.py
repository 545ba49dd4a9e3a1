"""Budgeted context assembly: the one place where candidates are taken greedily, in order.

Its input is a ranked list that an earlier limit bounds (three times the chunks), so one group holds it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default caps.
CHUNKS, TOKENS, PAGES, PER_SOURCE = 12, 24_000, 4, 4


def select_context(candidates: DataFrame, chunks: int = CHUNKS, tokens: int = TOKENS, pages: int = PAGES, per_source: int = PER_SOURCE, group: str | None = None) -> DataFrame:
    """Candidates with ``taken``; needs pos, page_id, source, tokens.

    A page beyond the cap is refused and does not count. A page's slot and a source's count
    stay used when a later cap refuses the candidate. A candidate over the token budget is
    skipped; smaller ones after it may still fit. ``group`` separates queries.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        used_pages: set = set()
        used_sources: dict = {}
        spent, n, taken = 0, 0, []
        for page, source, cost in zip(rows["page_id"], rows["source"], rows["tokens"], strict=True):
            ok = n < chunks and (page in used_pages or len(used_pages) < pages)
            if ok:
                used_pages.add(page)
                if source is not None:
                    ok = used_sources.get(source, 0) < per_source
                    if ok:
                        used_sources[source] = used_sources.get(source, 0) + 1
            if ok and spent + cost > tokens:
                ok = False
            if ok:
                spent, n = spent + cost, n + 1
            taken.append(ok)
        return rows.assign(taken=taken)

    keys = [group] if group else []
    schema = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes) + ", taken boolean"
    return candidates.groupBy(*keys).applyInPandas(fold, schema)


def summary(selected: DataFrame) -> DataFrame:
    """chunks, tokens, dropped of a selection."""
    return selected.agg(F.sum(F.col("taken").cast("long")).alias("chunks"), F.sum(F.when(F.col("taken"), F.col("tokens")).otherwise(0)).alias("tokens"), F.sum((~F.col("taken")).cast("long")).alias("dropped"))


def neighbourhood(chunks: DataFrame, neighbours: DataFrame, first: int = 3, limit: int = 10) -> DataFrame:
    """Graph neighbours of the first chunks' pages (pos, page_id): each node once, 2 * limit in all.

    ``neighbours`` has page_id, node_id, relation, label in the order of expansion (nth).
    """
    from pyspark.sql import Window

    near = chunks.orderBy("pos").limit(first).join(neighbours, "page_id").where(F.col("nth") <= limit)
    once = near.withColumn("again", F.row_number().over(Window.partitionBy("node_id").orderBy("pos", "nth"))).where("again = 1").drop("again")
    return once.orderBy("pos", "nth").limit(2 * limit)
