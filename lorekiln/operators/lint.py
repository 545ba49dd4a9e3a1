"""Checks of a published generation. Each returns findings: check, severity, slug, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CITE_ANY, cited_claims, link_targets, normalized_title, trimmed, without_citations, without_links
from .graph import is_aggregate

# Checks in the order that reports list them, and the length from which a section needs support.
CHECKS = ("missing-source", "stale-citation", "broken-link", "orphan-page", "unsupported-section", "duplicate-concept", "stale-insight", "hand-edited-file")
PROSE = 160


def _finding(check: str, severity: str, slug: Column, message: Column) -> list[Column]:
    return [F.lit(check).alias("check"), F.lit(severity).alias("severity"), slug.alias("slug"), message.alias("message")]


def citation_sources(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of sources that are gone (errors), or changed since (warnings). citations: slug, source_id, source_hash."""
    joined = citations.join(sources.select("source_id", "status", "content_hash"), "source_id", "left")
    missing = joined.where("status IS NULL OR status <> 'active'").select(*_finding("missing-source", "error", F.col("slug"), F.concat(F.lit("source "), F.col("source_id").cast("string"), F.lit(" is gone"))))
    stale = joined.where("status = 'active' AND content_hash <> source_hash").select(*_finding("stale-citation", "warning", F.col("slug"), F.concat(F.lit("source "), F.col("source_id").cast("string"), F.lit(" has changed"))))
    return missing.unionByName(stale)


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links: slug, target (a title); titles compare trimmed and in lower case."""
    known = pages.select(F.lower(F.trim("title")).alias("key")).distinct()
    missing = links.withColumn("key", F.lower(F.trim("target"))).join(known, "key", "left_anti")
    return missing.select(*_finding("broken-link", "error", F.col("slug"), F.concat(F.lit("no page is called "), F.col("target"))))


def body_links(pages: DataFrame) -> DataFrame:
    return pages.select("slug", F.explode(link_targets("content")).alias("target"))


def orphans(pages: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """Pages without links to them whose refs no relation touches. links: from_page, to_page; relations: source, target."""
    linked = links.where("from_page <> to_page").select(F.col("to_page").alias("page_id")).distinct()
    ends = relations.select(F.col("source").alias("ref")).union(relations.select("target")).distinct()
    tied = pages.select("page_id", F.explode("refs").alias("ref")).join(ends, "ref", "left_semi").select("page_id").distinct()
    alone = pages.where(~is_aggregate(F.col("category"))).join(linked, "page_id", "left_anti").join(tied, "page_id", "left_anti")
    return alone.select(*_finding("orphan-page", "warning", F.col("slug"), F.lit("nothing leads to this page")))


def unsupported_sections(sections: DataFrame) -> DataFrame:
    """Sections (slug, category, level, heading, content) of level 2 or 3 with much prose and no citation."""
    prose = F.length(F.trim(without_links(without_citations("content"))))
    bad = sections.where(F.col("level").isin(2, 3) & ~is_aggregate(F.col("category")) & (prose >= PROSE) & (F.size(cited_claims("content")) == 0))
    return bad.select(*_finding("unsupported-section", "warning", F.col("slug"), F.concat(F.lit("no citation under "), F.col("heading"))))


def duplicates(pages: DataFrame) -> DataFrame:
    """Pages whose normalised title an earlier slug has, or is another page's slug."""
    keyed = pages.select("slug", normalized_title("title").alias("key"))
    first = F.min("slug").over(Window.partitionBy("key"))
    same = keyed.withColumn("first", first).where("slug <> first")
    titles = same.select(*_finding("duplicate-concept", "warning", F.col("slug"), F.concat(F.lit("same title as "), F.col("first"))))
    other = keyed.join(pages.select(F.col("slug").alias("key")), "key").where("slug <> key")
    return titles.unionByName(other.select(*_finding("duplicate-concept", "warning", F.col("slug"), F.concat(F.lit("title is the slug of "), F.col("key")))))


def stale_insights(insights: DataFrame, citations: DataFrame) -> DataFrame:
    """insights: insight_id, citation_id, digest; citations: citation_id, current."""
    joined = insights.join(citations.select("citation_id", "current"), "citation_id", "left")
    bad = joined.where("current IS NULL OR current <> digest")
    return bad.select(*_finding("stale-insight", "warning", F.col("insight_id").cast("string"), F.when(F.col("current").isNull(), "a citation is gone").otherwise("a citation has drifted")))


def edited_files(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Published files (slug, content) that are missing, empty or no longer what was written (body_hash)."""
    joined = pages.select("slug", "body_hash").join(files.select("slug", "content"), "slug", "left")
    bad = joined.where(F.col("content").isNull() | (F.length("content") == 0) | (F.sha2("content", 256) != F.col("body_hash")))
    return bad.select(*_finding("hand-edited-file", "error", F.col("slug"), F.when(F.col("content").isNull(), "missing").when(F.length("content") == 0, "empty").otherwise("differs")))


def report(*findings: DataFrame) -> DataFrame:
    """All findings once, in the order of check, severity, slug and message."""
    place = F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("check"))
    return reduce(DataFrame.unionByName, findings).distinct().orderBy(place, "severity", "slug", "message")


def counts(findings: DataFrame) -> DataFrame:
    return findings.distinct().agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"))


# The categories of planned pages.
CATEGORIES = ("concepts", "architecture", "security", "guides", "reference")


def plan_codes(proposals: DataFrame, nodes: DataFrame, merged: bool = False) -> DataFrame:
    """page (null for whole-plan codes), code: what makes a plan invalid. proposals: page, title, category, purpose, refs.

    A merged plan must also give purposes and cover all nodes, those that proposals have named; a single proposal need not.
    """
    blank = lambda c: trimmed(F.coalesce(F.col(c), F.lit(""))) == ""
    kind = dict(proposals.dtypes)["page"]
    checks = [
        F.when(blank("title"), "EMPTY_TITLE"),
        F.when(F.size(F.coalesce("refs", F.array().cast("array<string>"))) == 0, "EMPTY_REFS"),
        F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "UNKNOWN_CATEGORY"),
    ]
    if merged:
        checks.append(F.when(blank("purpose"), "EMPTY_PURPOSE"))
    rows = proposals.select("page", F.explode(F.array_compact(F.array(*checks))).alias("code"))
    refs = proposals.select("page", F.explode("refs").alias("ref"))
    unknown = refs.join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti").select("page", F.lit("UNKNOWN_NODE_REF").alias("code"))
    twice = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("page")).where("n > 1").select("page", F.lit("DUPLICATE_NODE_ASSIGNMENT").alias("code"))
    empty = proposals.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast(kind).alias("page"), F.lit("EMPTY_PLAN").alias("code"))
    found = [rows, unknown, twice, empty]
    if merged:
        uncovered = nodes.select(F.col("id").alias("ref")).join(refs.select("ref"), "ref", "left_anti")
        found.append(uncovered.select(F.lit(None).cast(kind).alias("page"), F.lit("MISSING_NODE_COVERAGE").alias("code")))
    return reduce(DataFrame.unionByName, found)


def body_codes(pages: DataFrame, claims: DataFrame, titles: DataFrame) -> DataFrame:
    """page_id, codes: what makes a compiled body invalid. claims: page_id, claim_id (its own), anchored (may be absent: all are); titles: title."""
    body = F.col("content")
    anchored = F.col("anchored") if "anchored" in claims.columns else F.lit(True)
    own_claims = claims.groupBy("page_id", "claim_id").agg(F.max(anchored).alias("anchored"))
    cited = pages.select("page_id", F.explode(F.array_distinct(cited_claims(body))).alias("claim_id")).where("claim_id <> ''")
    judged = cited.join(own_claims, ["page_id", "claim_id"], "left")
    bad_claims = judged.where("anchored IS NULL OR NOT anchored").select("page_id", F.when(F.col("anchored").isNull(), "UNKNOWN_CLAIM_REF").otherwise("UNANCHORED_CLAIM").alias("code"))
    linked = pages.select("page_id", F.explode(link_targets(body)).alias("title"))
    lost = linked.withColumn("key", F.lower("title")).join(titles.select(F.lower(trimmed(F.col("title"))).alias("key")).distinct(), "key", "left_anti").select("page_id", F.lit("UNKNOWN_LINK_TARGET").alias("code"))
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    bare = trimmed(without_citations(body))
    cites = count(CITE_ANY)
    own = F.array_compact(
        F.array(
            F.when((cites == 0) & (F.coalesce("n_claims", F.lit(0)) > 0), "UNGROUNDED_BODY"),
            F.when(cites > F.size(F.filter(cited_claims(body), lambda c: c != "")), "EMPTY_CLAIM_REF"),
            F.when(count("<!--") != count("-->"), "UNCLOSED_COMMENT"),
            F.when(count(r"\[\[") != count(r"\]\]"), "UNCLOSED_WIKILINK"),
            F.when(bare == "", "EMPTY_BODY").when(~F.contains(body, F.lit("## ")) & (F.length(bare) > 500), "NO_SECTIONS"),
        )
    )
    counted = pages.join(own_claims.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_claims")), "page_id", "left")
    rows = counted.select("page_id", F.explode(own).alias("code")).unionByName(bad_claims).unionByName(lost)
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
