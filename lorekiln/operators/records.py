"""Small lookups, counts and set tests over the records of a knowledge base."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_id_or_slug(pages: DataFrame, key: str) -> DataFrame:
    """The page that has ``key`` as page_id or as slug."""
    return pages.where((F.col("page_id") == key) | (F.col("slug") == key))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal what is wanted; a wanted None asks nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with a prefix, which stands for itself."""
    return rows.where(F.startswith(F.col(column), F.lit(prefix)))


def claim_sources(claims: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, source_id, rel_path of each citation (owner_kind, owner_id, source_id) that a claim owns, of a known source."""
    owned = citations.where("owner_kind = 'claim'").select(F.col("owner_id").alias("claim_id"), "source_id")
    return claims.select("claim_id").join(owned, "claim_id").join(sources.select("source_id", "rel_path"), "source_id").select("claim_id", "source_id", "rel_path")


def source_nodes(relations: DataFrame, analyses: DataFrame, source_ids: Column) -> DataFrame:
    """node: both ends of all relations (analysis_id, source_node_id, target_node_id) that analyses of some sources found."""
    own = relations.join(analyses.where(source_ids).select("analysis_id"), "analysis_id", "left_semi")
    return own.select(F.col("source_node_id").alias("node")).union(own.select("target_node_id")).distinct()


def per_page(rows: DataFrame, page: str, name: str) -> DataFrame:
    """How many rows (citations, links to it) each page has."""
    return rows.groupBy(page).agg(F.count(F.lit(1)).alias(name))


def hash_coverage(sections: DataFrame, column: str = "text_hash") -> DataFrame:
    """sections, hashed, complete: whether every section has a hash."""
    return sections.agg(F.count(F.lit(1)).alias("sections"), F.count(column).alias("hashed")).withColumn("complete", F.col("sections") == F.col("hashed"))


def revision(rows: DataFrame, number: str) -> DataFrame:
    """revision: the largest row number, 0 without rows."""
    return rows.agg(F.coalesce(F.max(number), F.lit(0)).cast("long").alias("revision"))


# What a fresh plan makes of pages. Successors of split pages have a class of their own.
DIFF = ("unchanged", "modified", "merged", "split", "successor", "created", "retired")


def diff_summary(classes: DataFrame) -> DataFrame:
    """Counts of classes of pages (status), how many pages must be compiled, and whether nothing changed."""
    of = lambda name: F.count(F.when(F.col("status") == name, 1))
    counted = classes.agg(*[of(x).alias(x) for x in DIFF])
    again = F.col("modified") + F.col("merged") + F.col("successor") + F.col("created")
    changed = F.col("modified") + F.col("merged") + F.col("split") + F.col("created") + F.col("retired")
    return counted.withColumn("recompile", again).withColumn("empty", changed == 0)


def memberships(rows: DataFrame) -> DataFrame:
    """Distinct (page_id, build_id, node_id)."""
    return rows.select("page_id", "build_id", "node_id").distinct()


def unique_titles(pages: DataFrame, order: str, title: str = "title") -> DataFrame:
    """Adds unique_title: the trimmed title, with (n) after it if it is the nth page of that title in any case."""
    bare = F.trim(F.col(title))
    nth = F.row_number().over(Window.partitionBy(F.lower(bare)).orderBy(order))
    return pages.withColumn("unique_title", F.when(nth > 1, F.concat(bare, F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(bare))


def unique_slugs(pages: DataFrame, order: str, slug: str = "slug") -> DataFrame:
    """Adds unique_slug: the slug, or the first of slug-2, slug-3, ... that no page before has.

    Slugs can only collide within a family, those that are equal but for numbers at their ends; families are folded apart.
    """

    def family(rows: pd.DataFrame) -> pd.DataFrame:
        rows, taken, out = rows.sort_values(order), set(), []
        nexts: dict[str, int] = {}
        for base in rows[slug]:
            found = base
            while found in taken:
                nexts[base] = nexts.get(base, 1) + 1
                found = f"{base}-{nexts[base]}"
            taken.add(found)
            out.append(found)
        return rows.drop(columns="__family").assign(unique_slug=out)

    kept = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes)
    keyed = pages.withColumn("__family", F.regexp_replace(slug, r"(-\d+)+$", ""))
    return keyed.groupBy("__family").applyInPandas(family, f"{kept}, unique_slug string")


def latest(builds: DataFrame, status: str | None = None) -> DataFrame:
    """The build (build_id, status, started_at) that started last, of one status if that is given; ties by id."""
    return matching(builds, status=status).orderBy(F.desc("started_at"), F.desc("build_id")).limit(1)


def is_subset(part: Column, whole: Column) -> Column:
    """Whether all members of one array are among those of another."""
    return F.size(F.array_except(part, whole)) == 0


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays have the same members, in any order and number."""
    return is_subset(a, b) & is_subset(b, a)


def record_fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as a JSON object with sorted keys, null as an empty string."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(fields[k].cast("string"), F.lit("")).alias(k) for k in sorted(fields)])), 256)


def encoded_list(values: Column) -> Column:
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def decoded_list(text: Column) -> Column:
    """The strings of a JSON array; what is none gives an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


_CITE = re.compile(r'<!--\s*((?:[\w-]+:)?cite)(?:\s((?:(?!-->)[\s\S])*))?-->')
_CLAIM = re.compile(r'claim="([^"]*)"')


def _expanded(body: str, anchors: dict[str, list[dict]]) -> tuple[str, list[dict], list[str]]:
    records, paths = [], {}

    def full(found: re.Match) -> str:
        claim = _CLAIM.search(found[2] or "")
        out = []
        for a in anchors.get(claim[1], ()) if claim else ():
            out.append(f'<!-- {found[1]} claim="{claim[1]}" source="{a["rel_path"]}" section="{" > ".join(a["heading_path"])}" range="{a["start"]}-{a["end"]}" digest="{a["digest"]}" -->')
            records.append({"claim_id": claim[1], "source_id": a["source_id"], "start": a["start"], "end": a["end"], "digest": a["digest"]})
            paths[a["rel_path"]] = None
        return " ".join(out)

    return _CITE.sub(full, body), records, list(paths)


EXPANDED = "body string, citations array<struct<claim_id:string,source_id:string,start:long,end:long,digest:string>>, sources array<string>"


def expand_citations(pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """page_id, body with a full comment for each anchor of a cited claim, its citations in that order, its sources in order of first use.

    pages: page_id, content. anchors: claim_id, nth, source_id, rel_path, heading_path, start, end, digest. Citations of
    claims without anchors go. Anchors meet pages by the claims that these cite, so a page carries its own only.
    """
    from ..functions.text import cited_claims

    cited = pages.select("page_id", F.explode(F.array_distinct(cited_claims("content"))).alias("claim_id"))
    fields = ("nth", "claim_id", "source_id", "rel_path", "heading_path", "start", "end", "digest")
    own = cited.join(anchors.select(*fields), "claim_id").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("anchors"))

    @F.pandas_udf(f"struct<{EXPANDED.replace(' ', ':').replace(',:', ',')}>")
    def expanded(bodies: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for body, found in zip(bodies, lists, strict=True):
            by: dict[str, list] = {}
            for a in found if found is not None else ():
                by.setdefault(a["claim_id"], []).append(a)
            out.append(_expanded(body or "", by))
        return pd.DataFrame(out, columns=["body", "citations", "sources"])

    joined = pages.select("page_id", "content").join(own, "page_id", "left")
    return joined.select("page_id", expanded("content", "anchors").alias("x")).select("page_id", "x.body", "x.citations", "x.sources")
