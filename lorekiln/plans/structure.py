"""Markdown structure. Conversations and pages serve as Markdown and MDX files; SQL has no parsers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions as V
from ..sources import markdown as M
from .tables import Tables, registry

QUERIES, SQL, query = registry()


def _files(t: Tables) -> DataFrame:
    """A file for each conversation, a section for each turn."""
    turn = F.concat(F.lit("## "), F.initcap("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))), lambda y: y["x"]), "\n\n")
    head = F.concat(F.lit("---\ntitle: \"Talk "), F.col("conv_id").cast("string"), F.lit("\"\nlang: en\n---\n# Talk "), F.col("conv_id").cast("string"), F.lit("\n\n"))
    return t.conversations.groupBy("conv_id").agg(body.alias("body")).select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(head, "body").alias("raw"))


def _mdx(t: Tables) -> DataFrame:
    """Each page's paragraphs as accordions, its title as a callout."""
    title = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), '"', "")
    text = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[{}<>]", " ")
    return t.pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".mdx")).alias("path"), F.concat(F.lit('<Callout type="info">'), title, F.lit('</Callout>\n\n<Accordions>\n<Accordion title="'), title, F.lit('">'), text, F.lit("</Accordion>\n</Accordions>\n")).alias("raw"))


@query()
def frontmatter_parse(t: Tables) -> DataFrame:
    return M.frontmatter_of(_files(t)).select("path", F.col("keys")["title"].alias("title"), F.col("keys")["lang"].alias("lang"), F.length("rest").alias("rest_chars"), "diagnostic")


@query("""
SELECT 'talk/' || conv_id || '.md' AS path, CAST(turn + 1 AS INTEGER) AS ord, 2 AS level, upper(role[1]) || role[2:] || ' ' || turn AS heading, 'Talk ' || conv_id || ' > ' || upper(role[1]) || role[2:] || ' ' || turn AS heading_path, sha256(text) AS digest
FROM (SELECT conv_id, turn, role, text FROM conversations)
UNION ALL SELECT DISTINCT 'talk/' || conv_id || '.md', 0, 1, 'Talk ' || conv_id, 'Talk ' || conv_id, sha256('') FROM conversations""")
def markdown_sections(t: Tables) -> DataFrame:
    rows = M.read_sections(_files(t))
    return rows.select("path", "ord", "level", "heading", F.array_join("heading_path", " > ").alias("heading_path"), F.sha2("content", 256).alias("digest"))


@query()
def section_segments(t: Tables) -> DataFrame:
    return M.read_chunks(M.read_sections(_files(t)), 40).select("path", "ord", "ordinal", "start", "end", F.sha2("body", 256).alias("digest"))


@query()
def analysis_units(t: Tables) -> DataFrame:
    return M.units(M.read_sections(_files(t)), 400)


@query()
def mdx_downgrade(t: Tables) -> DataFrame:
    return M.downgraded(_mdx(t)).select("path", F.sha2("text", 256).alias("digest"), F.size("components").alias("components"), F.size("diagnostics").alias("diagnostics"))


@query()
def section_match(t: Tables) -> DataFrame:
    """Turns as sections: assistants' third turns are edited, and the first turn of each conversation is new."""
    turns = t.conversations.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("ord"), F.col("role").alias("path"), F.sha2("text", 256).alias("fingerprint"))
    previous = turns.where("ord > 0").withColumn("section_id", F.concat_ws("-", F.col("source_id").cast("string"), F.col("ord").cast("string")))
    current = turns.withColumn("fingerprint", F.when((F.col("path") == "assistant") & (F.col("ord") == 3), F.sha2("fingerprint", 256)).otherwise(F.col("fingerprint")))
    return V.match_sections(previous, current)
