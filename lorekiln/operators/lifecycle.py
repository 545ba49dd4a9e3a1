"""What becomes of knowledge nodes, sources and pages from one build to the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_key, claim_key, short_label
from .lint import CATEGORIES


def judged_merges(registry: DataFrame, merges: DataFrame) -> DataFrame:
    """merges (primary, secondary) with reason: why a merge is refused, null if it takes effect.

    A node is not merged into itself; the secondary node must be known and active, the primary one known. Of several
    merges of one node the one with the smallest primary counts; after it the node is no longer active.
    """
    nodes = registry.select("id", "status")
    joined = merges.join(nodes.select(F.col("id").alias("secondary"), F.col("status").alias("__was")), "secondary", "left")
    joined = joined.join(nodes.select(F.col("id").alias("primary"), F.lit(True).alias("__known")), "primary", "left")
    reason = (
        F.when(F.col("primary") == F.col("secondary"), "same-node")
        .when(F.col("__was").isNull(), "unknown-secondary")
        .when(F.col("__was") != "active", "not-active")
        .when(F.col("__known").isNull(), "unknown-primary")
    )
    judged = joined.withColumn("reason", reason)
    first = judged.where("reason IS NULL").groupBy("secondary").agg(F.min("primary").alias("__first"))
    later = F.col("reason").isNull() & (F.col("primary") != F.col("__first"))
    return judged.join(first, "secondary", "left").select("primary", "secondary", F.when(later, "not-active").otherwise(F.col("reason")).alias("reason"))


def merged(registry: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry after merges (``judged_merges`` that take effect), and the change of its revision: one for each."""
    done = judged_merges(registry, merges).where("reason IS NULL").select(F.col("secondary").alias("id"), F.col("primary").alias("__into")).distinct()
    joined = registry.join(done, "id", "left")
    hit = F.col("__into").isNotNull()
    after = joined.withColumn("status", F.when(hit, "merged").otherwise(F.col("status"))).withColumn("merged_into", F.coalesce("__into", "merged_into")).drop("__into")
    return after, done.agg(F.count(F.lit(1)).alias("revision_change"))


def retired(registry: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry after the active nodes among ids (id) are retired, and the change of its revision: one for each."""
    joined = registry.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    hit = (F.col("status") == "active") & F.col("__hit")
    change = joined.agg(F.count(F.when(hit, 1)).alias("revision_change"))
    return joined.withColumn("status", F.when(hit, "retired").otherwise(F.col("status"))).drop("__hit"), change


def without_sources(registry: DataFrame, claims: DataFrame, relations: DataFrame, analyses: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Registry, claims and relations after sources (source_id) are deleted, in this order, and the nodes that lose support.

    registry: id, status; claims: node_id, source_id, status; relations: analysis_id, source_node_id, target_node_id,
    status; analyses: analysis_id, source_id. Active claims and relations of deleted sources are retired, and with them
    active nodes that have neither left. Nodes: id, last (the largest source_id that supported it), retired. A node goes
    with its last source, so the registry's revision grows by the number of distinct ``last`` of retired nodes.
    """
    dead = gone.select("source_id").distinct().withColumn("__gone", F.lit(True))
    lost = F.coalesce("__gone", F.lit(False)) & (F.col("status") == "active")
    found = claims.join(dead, "source_id", "left").withColumn("__lost", lost)
    of = analyses.join(dead, "source_id", "left").select("analysis_id", F.col("source_id").alias("__source"), "__gone")
    ties = relations.join(of, "analysis_id", "left").withColumn("__lost", lost)
    support = found.where("status = 'active'").select(F.col("node_id").alias("id"), F.col("source_id").alias("source"), "__lost")
    for end in ("source_node_id", "target_node_id"):
        support = support.unionByName(ties.where("status = 'active'").select(F.col(end).alias("id"), F.col("__source").alias("source"), "__lost"))
    held = support.groupBy("id").agg(F.max(F.when(F.col("__lost"), F.col("source"))).alias("last"), F.max("__lost").alias("__hit"), F.min("__lost").alias("__bare"))
    nodes = held.where("__hit").join(registry.select("id", "status"), "id", "left")
    nodes = nodes.select("id", "last", (F.col("__bare") & F.coalesce(F.col("status") == "active", F.lit(False))).alias("retired"))
    kept, _ = retired(registry, nodes.where("retired").select("id"))
    end = lambda rows, *extra: rows.withColumn("status", F.when(F.col("__lost"), "retired").otherwise(F.col("status"))).drop("__lost", "__gone", *extra)
    return kept, end(found).select(*claims.columns), end(ties, "__source").select(*relations.columns), nodes


def node_drafts(entities: DataFrame, concepts: DataFrame, claims: DataFrame, relations: DataFrame) -> DataFrame:
    """source_id, node_kind, canonical_key, canonical_name, entity_type, description: the nodes that analyses name, each once a source.

    entities: source_id, ord, name, entity_type, description; concepts the same without entity_type; claims: source_id,
    ord, statement; relations: source_id, ord, source, target. Of equal keys of a kind the first counts, in the order of
    entities, concepts, claims, relations. Ends of relations that nothing names are entities of the type 'other'.
    """
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, place: int, kind: str, key: Column, name: Column, type_: Column = none, description: Column = none) -> DataFrame:
        return df.select("source_id", F.lit(kind).alias("node_kind"), key.alias("canonical_key"), F.struct(F.lit(place).alias("place"), F.col("ord").cast("long").alias("ord"), name.alias("canonical_name"), type_.alias("entity_type"), description.alias("description")).alias("draft"))

    name, statement = F.col("name"), F.col("statement")
    ends = relations.select("source_id", (2 * F.col("ord")).alias("ord"), F.col("source").alias("name")).unionByName(relations.select("source_id", (2 * F.col("ord") + 1).alias("ord"), F.col("target").alias("name")))
    found = [
        rows(entities, 0, "entity", canonical_key(name), name, F.nullif(F.col("entity_type"), F.lit("")), F.col("description")),
        rows(concepts, 1, "concept", canonical_key(name), name, none, F.col("description")),
        rows(claims, 2, "claim", claim_key(statement), short_label(statement)),
        rows(ends, 3, "entity", canonical_key(name), name, F.lit("other")),
    ]
    first = reduce(DataFrame.unionByName, found).groupBy("source_id", "node_kind", "canonical_key").agg(F.min("draft").alias("draft"))
    return first.select("source_id", "node_kind", "canonical_key", "draft.canonical_name", "draft.entity_type", "draft.description")


def topic_drafts(spark: SparkSession, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Drafts of the nodes that stand for the domains of planned pages. Registered before a plan, so that it finds the revision that it leaves."""
    rows = [("topic", f"domain:{c}", c, f"pages of the category {c}") for c in categories]
    return spark.createDataFrame(rows, "node_kind string, canonical_key string, canonical_name string, description string")


def _signatures(pages: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """A page's title with its own links and refs as sets; these are as many as one page's text has."""
    out = links.select(F.col("from_page").alias("page_id"), "to_page").groupBy("page_id").agg(F.array_sort(F.collect_set("to_page")).alias("links"))
    targets = dict(links.dtypes)["to_page"]
    whole = F.struct("title", F.coalesce("links", F.array().cast(f"array<{targets}>")).alias("links"), F.array_sort(F.array_distinct("refs")).alias("refs"))
    return pages.select("page_id", "title", "refs").join(out, "page_id", "left").select("page_id", F.sha2(F.to_json(whole), 256).alias(name))


def signature_diff(old: DataFrame, old_links: DataFrame, new: DataFrame, new_links: DataFrame) -> DataFrame:
    """page_id, change: pages (page_id, title, refs) whose nodes and edges (from_page, to_page) a graph must add, renew, drop or may keep."""
    joined = _signatures(old, old_links, "old").join(_signatures(new, new_links, "new"), "page_id", "full_outer")
    return joined.select("page_id", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed").alias("change"))


def graph_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two graphs' nodes or edges that only one has, with ``change``: 'added' or 'removed'. Applied to the first it gives the second."""
    columns = before.columns
    marked = before.withColumn("__side", F.lit(False)).unionByName(after.withColumn("__side", F.lit(True)))
    # one aggregation takes repeated rows and both sides
    net = marked.groupBy(*columns).agg(F.min("__side").alias("__first"), F.max("__side").alias("__last")).where("__first = __last")
    return net.select(*columns, F.when(F.col("__last"), "added").otherwise("removed").alias("change"))


def surviving(pages: DataFrame, obsolete: DataFrame, updated: DataFrame) -> DataFrame:
    """Pages of the next generation: those that are not obsolete (page_id), with updated refs (page_id, refs) where there are any.

    Links go to surviving pages only (``surviving_links``), which are all known before any link is judged.
    """
    kept = pages.join(obsolete.select("page_id"), "page_id", "left_anti")
    return kept.join(updated.select("page_id", F.col("refs").alias("__refs")), "page_id", "left").withColumn("refs", F.coalesce("__refs", "refs")).drop("__refs")


def surviving_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links (from_page, to_page) between pages that are left."""
    ids = pages.select("page_id").distinct()
    from_ = links.join(ids.withColumnRenamed("page_id", "from_page"), "from_page", "left_semi")
    return from_.join(ids.withColumnRenamed("page_id", "to_page"), "to_page", "left_semi")


def topology_breaks(before: DataFrame, compiled: DataFrame, recompiled: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, lost, gained: recompiled pages (page_id) whose links are no longer the ones that they had to pages that are left.

    before, compiled: from_page, to_page. Any row means that the change is structural and needs a new plan.
    """
    own = lambda links: links.select(F.col("from_page").alias("page_id"), "to_page").join(recompiled.select("page_id"), "page_id", "left_semi")
    known = pages.select(F.col("page_id").alias("to_page"))
    delta = graph_delta(own(before).join(known, "to_page", "left_semi").select("page_id", "to_page"), own(compiled))
    return delta.groupBy("page_id").agg(F.count(F.when(F.col("change") == "removed", 1)).alias("lost"), F.count(F.when(F.col("change") == "added", 1)).alias("gained"))


def next_generation(pages: DataFrame, obsolete: DataFrame, compiled: DataFrame) -> DataFrame:
    """Pages of a generation after an incremental build, with ``carried``: compiled rows replace their pages, all others that are not obsolete stay as they are."""
    fresh = compiled.join(pages.select("page_id"), "page_id", "left_semi").join(obsolete.select("page_id"), "page_id", "left_anti")
    kept = pages.join(obsolete.select("page_id"), "page_id", "left_anti").join(compiled.select("page_id"), "page_id", "left_anti")
    return kept.withColumn("carried", F.lit(True)).unionByName(fresh.select(*pages.columns).withColumn("carried", F.lit(False)))


def covered(sections: DataFrame, vectors: DataFrame, model: str) -> bool:
    """Whether any section (text_hash) has a vector of the model; only if so is a query worth embedding."""
    own = vectors.where(F.col("model") == model).select("text_hash")
    return not sections.select("text_hash").join(own, "text_hash", "left_semi").limit(1).isEmpty()


def decision(pages: DataFrame) -> DataFrame:
    """outcome, trigger, pages: what an incremental build does, from outcomes of pages (see versions.map_change).

    A new plan if any page needs one, with the first trigger in the order of unmappable nodes, emptied pages and structural changes.
    """
    order = F.array(F.lit("unmappable-node"), F.lit("page-emptied"), F.lit("structural-change"))
    first = F.min(F.when(F.col("outcome") == "replan", F.array_position(order, F.col("trigger"))))
    found = pages.agg(first.cast("int").alias("at"), F.count("page_id").alias("pages"))
    return found.select(F.when(F.col("at").isNull(), "local-update").otherwise("replan-required").alias("outcome"), F.when(F.col("at").isNotNull(), F.element_at(order, F.col("at"))).alias("trigger"), "pages")
