"""The knowledge graph: building, expansion, clustering, related and aggregate pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label, top_directory
from .components import connected

# Kinds of pages that are made from others, and default caps.
AGGREGATES = ("overview", "index", "domain")
HUBS, CONCEPTS, RELATED, EXPANSION, CLUSTER = 10, 12, 8, 10, 24


def is_aggregate(category: Column) -> Column:
    return category.isin(*AGGREGATES)


def build(pages: DataFrame, links: DataFrame, nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, node_type, label), edges (source, relation, target), and a row of skipped counts.

    pages: page_id, title, category, refs; links: from_page, to_page; nodes: id, node_kind,
    canonical_name, canonical_key, status; relations: source_node_id, relation_type, target_node_id, status.
    """
    page_nodes = pages.select(F.concat(F.lit("page:"), "page_id").alias("id"), F.lit("page").alias("node_type"), F.col("title").alias("label"))
    words = nodes.where("status = 'active'").where(F.col("node_kind").isin("entity", "concept"))
    word_id = F.concat("node_kind", F.lit(":"), "id")
    word_nodes = words.select(word_id.alias("id"), F.col("node_kind").alias("node_type"), label("canonical_name", "canonical_key").alias("label"))
    page = lambda c: F.concat(F.lit("page:"), c)
    linked = links.join(pages.select(F.col("page_id").alias("from_page"), "category"), "from_page")
    is_domain = F.col("category") == "domain"
    link_edges = linked.select(page("from_page").alias("source"), F.when(is_domain, "aggregates").otherwise("links_to").alias("relation"), page("to_page").alias("target"))
    names = words.select(F.col("id").alias("ref"), word_id.alias("name"))
    refs = pages.select("page_id", F.explode("refs").alias("ref")).join(names, "ref", "left")
    contains = refs.where("name IS NOT NULL").select(page("page_id").alias("source"), F.lit("contains").alias("relation"), F.col("name").alias("target"))
    ends = relations.where("status = 'active'").join(names.select(F.col("ref").alias("source_node_id"), F.col("name").alias("source")), "source_node_id", "left").join(names.select(F.col("ref").alias("target_node_id"), F.col("name").alias("target")), "target_node_id", "left")
    related = ends.where("source IS NOT NULL AND target IS NOT NULL").select("source", F.col("relation_type").alias("relation"), "target")
    skipped = ends.agg(F.count(F.when(F.col("source").isNull() | F.col("target").isNull(), 1)).alias("skipped_relations")).crossJoin(refs.agg(F.count(F.when(F.col("name").isNull(), 1)).alias("skipped_refs")))
    return page_nodes.unionByName(word_nodes), link_edges.unionByName(contains).unionByName(related).distinct(), skipped


def expand(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = EXPANSION) -> DataFrame:
    """One hop in both directions: relation, label, id, at most ``limit`` in this order."""
    out = edges.where(F.col("source") == node_id).select("relation", F.col("target").alias("id"))
    back = edges.where(F.col("target") == node_id).select("relation", F.col("source").alias("id"))
    hop = out.unionByName(back).join(nodes.select("id", "node_type", "label"), "id")
    return hop.orderBy("relation", "label", "id").limit(limit)


def clusters(nodes: DataFrame, relations: DataFrame, most_nodes: int = CLUSTER, most_tokens: int = 1 << 60) -> DataFrame:
    """id, component, cluster: related nodes, and claims of the same directories, in parts within both budgets.

    nodes: id, node_kind, dirs (array of top directories), tokens. Parts are formed within a component:
    first by directories, then by halving the sorted members.
    """
    ids = nodes.select("id").withColumn("n", F.row_number().over(Window.orderBy("id")).cast("long")) if dict(nodes.dtypes)["id"] == "string" else nodes.select("id", F.col("id").cast("long").alias("n"))
    number = ids.select(F.col("id").alias("x"), "n")
    ends = relations.join(number.select(F.col("x").alias("source"), F.col("n").alias("a")), "source").join(number.select(F.col("x").alias("target"), F.col("n").alias("b")), "target").select("a", "b")
    group = F.array_join(F.array_sort(F.array_distinct("dirs")), "\x1f")
    claims = nodes.where("node_kind = 'claim' AND size(dirs) > 0").select("id", group.alias("group")).join(ids, "id")
    chain = claims.select(F.col("n").alias("a"), F.lag("n").over(Window.partitionBy("group").orderBy("n")).alias("b")).where("b IS NOT NULL")
    found = connected(ends.unionByName(chain).where("a <> b"))
    placed = nodes.withColumn("group", group).join(ids, "id").join(found.withColumnRenamed("uid", "n"), "n", "left").withColumn("component", F.coalesce("label", "n"))

    def parts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable", ignore_index=True)
        cluster = {}

        def cut(members: list[int]) -> None:
            if len(members) < 2 or len(members) <= most_nodes and rows["tokens"].iloc[members].sum() <= most_tokens:
                for m in members:
                    cluster[m] = int(rows["n"].iloc[members[0]])
                return
            by: dict[str, list[int]] = {}
            for m in members:
                by.setdefault(rows["group"].iloc[m] or "", []).append(m)
            half = -(-len(members) // 2)
            for part in [by[k] for k in sorted(by)] if len(by) > 1 else [members[:half], members[half:]]:
                cut(part)

        cut(list(range(len(rows))))
        return pd.DataFrame({"id": rows["id"], "component": rows["component"], "cluster": [cluster[i] for i in range(len(rows))]})

    kind = dict(nodes.dtypes)["id"]
    return placed.select("id", "n", "component", "group", "tokens").groupBy("component").applyInPandas(parts, f"id {kind}, component long, cluster long")


def related_pages(refs: DataFrame, relations: DataFrame, sources: DataFrame, k: int = RELATED) -> DataFrame:
    """page_id, related, score, rank: twice the relations between two pages' nodes plus their shared sources.

    refs: page_id, node; relations: source, target; sources: page_id, source_id.
    """
    a, b = refs.select(F.col("page_id").alias("p"), F.col("node").alias("source")), refs.select(F.col("page_id").alias("q"), F.col("node").alias("target"))
    one = relations.join(a, "source").join(b, "target").where("p <> q").select("p", "q")
    near = one.unionByName(one.select(F.col("q").alias("p"), F.col("p").alias("q"))).groupBy("p", "q").agg((2 * F.count(F.lit(1))).alias("score"))
    s = sources.distinct()
    shared = s.select(F.col("page_id").alias("p"), "source_id").join(s.select(F.col("page_id").alias("q"), "source_id"), "source_id").where("p <> q").groupBy("p", "q").agg(F.count(F.lit(1)).alias("score"))
    total = near.unionByName(shared).groupBy("p", "q").agg(F.sum("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "q"))
    return total.select(F.col("p").alias("page_id"), F.col("q").alias("related"), "score", nth.alias("rank")).where(F.col("rank") <= k)


def inbound(links: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, inbound: links from other pages that are no aggregates."""
    plain = pages.where(~is_aggregate(F.col("category"))).select(F.col("page_id").alias("from_page"))
    return links.join(plain, "from_page").where("from_page <> to_page").groupBy(F.col("to_page").alias("page_id")).agg(F.count(F.lit(1)).alias("inbound"))


def hubs(links: DataFrame, pages: DataFrame, k: int = HUBS) -> DataFrame:
    return inbound(links, pages).join(pages.select("page_id", "title"), "page_id").where("inbound > 0").orderBy(F.desc("inbound"), "title").limit(k)


def key_concepts(pages: DataFrame, labels: DataFrame, k: int = CONCEPTS) -> DataFrame:
    """category, id, label, pages, rank: of each category the labelled nodes on most of its pages."""
    refs = pages.select("category", "page_id", F.explode("refs").alias("id"))
    # labels come to counted nodes, as they would widen every row that is counted
    counted = refs.groupBy("category", "id").agg(F.countDistinct("page_id").alias("pages")).join(labels.select("id", "label").distinct(), "id").select("category", "id", "label", "pages")
    nth = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("pages"), "id"))
    return counted.withColumn("rank", nth).where(F.col("rank") <= k)


def dominant(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n: the most frequent value of each group; of equals the smallest."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value)) if by else F.row_number().over(Window.orderBy(F.desc("n"), value))
    return counted.withColumn("nth", nth).where("nth = 1").drop("nth")


def category_groups(pages: DataFrame) -> DataFrame:
    """category, members (titles in the order of title and slug), n, of pages that are no aggregates themselves."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("title", "slug"))), lambda x: x["title"])
    return pages.where(~is_aggregate(F.col("category"))).groupBy("category").agg(members.alias("members"), F.count(F.lit(1)).alias("n"))


def aggregate_pages(pages: DataFrame, links: DataFrame, labels: DataFrame, chinese: bool = False) -> DataFrame:
    """slug, title, category, body: a domain page for each category, an overview and an index, in Markdown."""
    plain = pages.where(~is_aggregate(F.col("category")))
    line = F.concat(F.lit("- [["), "title", F.lit("]]"))
    concepts = key_concepts(plain, labels).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("concepts"))
    lists = plain.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("title", "slug", line.alias("line")))), lambda x: x["line"]).alias("lines"), F.count(F.lit(1)).alias("n")).join(concepts, "category", "left")
    head, of = ("关键概念", "页面") if chinese else ("Key concepts", "Pages")
    slug = F.when(F.trim("category") == "", F.lit("domain-other")).otherwise(F.concat(F.lit("_agg-domain-"), "category"))
    domain = lists.select(
        slug.alias("slug"),
        F.initcap("category").alias("title"),
        F.lit("domain").alias("category"),
        F.concat(F.lit(f"## {of}\n\n"), F.array_join("lines", "\n"), F.when(F.size("concepts") > 0, F.concat(F.lit(f"\n\n## {head}\n\n"), F.array_join("concepts", ", "))).otherwise(F.lit(""))).alias("body"),
    )
    hub = hubs(links, plain).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("inbound", "title")), asc=False), lambda x: F.concat(F.lit("- [["), x["title"], F.lit("]]"))), "\n").alias("hubs"))
    areas = lists.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.initcap("category"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")))), "\n").alias("areas"))
    overview = areas.crossJoin(hub).select(F.lit("_agg-overview").alias("slug"), F.lit("Overview").alias("title"), F.lit("overview").alias("category"), F.concat_ws("\n\n", "areas", "hubs").alias("body"))
    index = lists.agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("category", "lines"))), lambda x: F.concat(F.array(F.concat(F.lit("## "), F.initcap(x["category"]))), x["lines"]))), "\n").alias("body"))
    index = index.select(F.lit("_agg-index").alias("slug"), F.lit("Index").alias("title"), F.lit("index").alias("category"), "body")
    return domain.unionByName(overview).unionByName(index)


def page_sources(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """page_id, paths: the distinct paths that a page cites, sorted."""
    return citations.join(sources.select("source_id", "rel_path"), "source_id").groupBy("page_id").agg(F.array_sort(F.collect_set("rel_path")).alias("paths"))


def directories(anchors: DataFrame) -> DataFrame:
    """id, dirs from id, rel_path."""
    return anchors.groupBy("id").agg(F.array_sort(F.collect_set(top_directory("rel_path"))).alias("dirs"))
