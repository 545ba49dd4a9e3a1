"""Stages that a language model serves: analysis, planning, compiling, summaries and review. What it answers is checked before it counts.

Rows meet the model through ``generate_cached``: once for each distinct miss, on executors, with one more try. The planner alone works on
the driver, as each of its rounds needs the one before; it holds proposals, as many as a plan has pages.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import key_of, one_line_summary
from ..sources.providers import TextProvider, generate_cached, json_payload
from ..sources.tables import written
from .lint import body_codes, plan_codes

# The largest payload in bytes of one request to merge proposals, how many rounds there may be, and up to
# how many pages a domain has a summary.
PAYLOAD, ROUNDS, SUMMARY_PAGES = 96_000, 64, 40
# Kinds of findings as a model names them and as reports do.
KINDS = {
    "contradiction": "contradictory-claims",
    "superseded": "superseded-facts",
    "weak-synthesis": "weak-synthesis",
    "superseded-insight": "superseded-insight",
    "contradicted-insight": "contradicted-insight",
}

ANALYSIS = (
    "entities array<struct<name:string,entity_type:string,description:string>>, concepts array<struct<name:string,description:string>>, "
    "claims array<struct<text:string,source_section_id:string,evidence:string,confidence:double>>, "
    "relations array<struct<source_name:string,relation_type:string,target_name:string,evidence:string,source_section_id:string>>"
)
_ANALYSE = "Name what this text is about as one JSON object with the lists entities, concepts, claims and relations. Quote evidence word for word.\n\n"
_COMPILE = 'Write this page in Markdown. Cite a claim as <!-- kb:cite claim="id" --> after what it supports, and link pages as [[title]].\n\n'
_SUMMARISE = "Summarise this domain in one paragraph.\n\n"
_REVIEW = 'Review this page. Answer with one JSON object {"findings": [{"kind", "claim_ids", "reason", "excerpt"}]}.\n\n'
_PLAN = 'Plan pages for this knowledge. Answer with one JSON object {"pages": [{"title", "category", "purpose", "knowledge_refs"}]}.\n\n'
_MERGE = "Merge these proposed pages; every knowledge reference stays on one page. Answer in the same form as they have.\n\n"


def _object(answer: str, *lists: str) -> dict | None:
    """The JSON object of an answer if all that it has under these names are lists."""
    try:
        found = json.loads(json_payload(answer) or "null")
    except ValueError:
        return None
    return found if isinstance(found, dict) and all(isinstance(found.get(name, []), list) for name in lists) else None


def _has(*lists: str) -> Callable[[str], bool]:
    return lambda answer: _object(answer, *lists) is not None


@F.pandas_udf(StringType())
def _payload(answers: pd.Series) -> pd.Series:
    return answers.map(lambda a: None if a is None else json_payload(a))


def _asked(rows: DataFrame, prompt: str, provider: TextProvider, version: str) -> DataFrame:
    return rows.withColumn("cache_key", key_of(F.lit(provider.model), F.lit(version), F.col(prompt)))


def analysed(units: DataFrame, cache: DataFrame, provider: TextProvider, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """source_id, unit, analysis (see ANALYSIS; null if no answer had that form) of units (source_id, unit, text), and what the cache gains."""
    wanted = _asked(units.withColumn("prompt", F.concat(F.lit(_ANALYSE), "text")), "prompt", provider, version)
    answers, gained = generate_cached(wanted.select("cache_key", "prompt"), cache, provider, _has("entities", "concepts", "claims", "relations"))
    known = answers.distinct().select("cache_key", F.from_json(_payload("response"), ANALYSIS).alias("analysis"))
    return wanted.select("source_id", "unit", "cache_key").join(known, "cache_key", "left").select("source_id", "unit", "analysis"), gained


def _numbered(analyses: DataFrame, field: str, columns: dict[str, str]) -> DataFrame:
    """Items of all units of a source, ord in the order of units and within them."""
    rows = analyses.select("source_id", "unit", F.posexplode(f"analysis.{field}").alias("at", "x"))
    return rows.select("source_id", (F.col("unit").cast("long") * 1_000_000 + F.col("at")).alias("ord"), *[F.col(f"x.{a}").alias(b) for a, b in columns.items()])


def found(analyses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, concepts, claims and relations as ``lifecycle.node_drafts`` takes them, with evidence where there is any."""
    entities = _numbered(analyses, "entities", {"name": "name", "entity_type": "entity_type", "description": "description"})
    concepts = _numbered(analyses, "concepts", {"name": "name", "description": "description"})
    claims = _numbered(analyses, "claims", {"text": "statement", "source_section_id": "section_id", "evidence": "evidence", "confidence": "confidence"})
    relations = _numbered(analyses, "relations", {"source_name": "source", "relation_type": "relation_type", "target_name": "target", "evidence": "evidence"})
    return entities, concepts, claims, relations


def _plan_faults(spark: SparkSession, pages: list[dict], nodes: list[str], merged: bool) -> list[str]:
    schema = "page string, title string, category string, purpose string, refs array<string>"
    rows = [(str(i), p.get("title"), p.get("category"), p.get("purpose"), [str(r) for r in p.get("knowledge_refs") or []]) for i, p in enumerate(pages)]
    known = spark.createDataFrame([(n,) for n in nodes], "id string")
    return sorted({r["code"] for r in plan_codes(spark.createDataFrame(rows, schema), known, merged).collect()})  # a handful of codes


def _pages(answer: str) -> list[dict]:
    answer_ = _object(answer, "pages") or {}
    return [p for p in answer_.get("pages", []) if isinstance(p, dict)]


def _planned(spark: SparkSession, prompt: str, nodes: list[str], provider: TextProvider, merged: bool) -> list[dict]:
    """Pages of a valid answer; a second one is asked for with what made the first invalid, and is an error if invalid too."""
    pages = _pages(provider.generate(prompt))
    faults = _plan_faults(spark, pages, nodes, merged)
    if faults:
        pages = _pages(provider.generate(prompt + "\n\nThe last answer was not valid: " + ", ".join(faults)))
        faults = _plan_faults(spark, pages, nodes, merged)
    if faults:
        raise ValueError("no valid plan: " + ", ".join(faults))
    return pages


def reconciled(spark: SparkSession, proposals: list[dict], provider: TextProvider, rounds: int = ROUNDS, most: int = PAYLOAD) -> list[dict]:
    """Proposed pages merged until one request holds them all.

    A payload beyond ``most`` bytes is cut into batches of proposals, whose merged pages go into the next round. A round that makes neither
    proposals nor bytes fewer than the one before is an error, and so is one more than ``rounds``.
    """
    before: tuple[int, int] | None = None
    for _ in range(max(1, rounds)):
        payload = json.dumps({"pages": proposals}, ensure_ascii=False)
        size = (len(proposals), len(payload.encode()))
        if before is not None and size[0] >= before[0] and size[1] >= before[1]:
            raise ValueError(f"a round made no progress: {before} and {size} proposals and bytes")
        refs = lambda batch: sorted({str(r) for p in batch for r in p.get("knowledge_refs") or []})
        if size[1] <= most:
            return _planned(spark, _MERGE + payload, refs(proposals), provider, True)
        each = max(1, -(-len(proposals) // (-(-size[1] // most) + 1)))
        batches = [proposals[i : i + each] for i in range(0, len(proposals), each)]
        before, proposals = size, [p for b in batches for p in _planned(spark, _MERGE + json.dumps({"pages": b}, ensure_ascii=False), refs(b), provider, True)]
        if len(proposals) <= 1:
            return proposals
    raise ValueError(f"not reconciled after {rounds} rounds")


def planned(clusters: DataFrame, nodes: DataFrame, provider: TextProvider, rounds: int = ROUNDS, most: int = PAYLOAD) -> list[dict]:
    """Pages (title, category, purpose, knowledge_refs) for clusters (id, cluster) of nodes (id, label), each node on one page.

    Proposals are made for one cluster after the other, whose nodes are bounded by ``graph.clusters``, and then reconciled.
    """
    spark = clusters.sparkSession
    rows = clusters.select(F.col("id").cast("string").alias("id"), "cluster").join(nodes.select(F.col("id").cast("string").alias("id"), "label"), "id")
    lists = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("nodes")).orderBy("cluster")
    proposals: list[dict] = []
    for row in lists.toLocalIterator():
        payload = json.dumps([n.asDict() for n in row["nodes"]], ensure_ascii=False)
        proposals += _planned(spark, _PLAN + payload, [n["id"] for n in row["nodes"]], provider, False)
    return reconciled(spark, proposals, provider, rounds, most) if proposals else []


def compiled(plan: DataFrame, claims: DataFrame, titles: DataFrame, cache: DataFrame, provider: TextProvider, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """page_id, content, codes (empty: valid) of planned pages, and what the cache gains: valid answers only.

    plan: page_id, title, purpose; claims: page_id, claim_id, statement, anchored; titles: title. A page whose body is invalid
    is asked for once more with its codes.
    """
    line = F.concat(F.lit("- "), F.col("claim_id"), F.lit(": "), F.col("statement"))
    own = claims.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("claims"))
    prompt = F.concat_ws("\n", F.lit(_COMPILE), "title", F.coalesce("purpose", F.lit("")), F.coalesce("claims", F.lit("")))
    asked = _asked(plan.join(own, "page_id", "left").select("page_id", prompt.alias("prompt")), "prompt", provider, version)
    ids = claims.select("page_id", "claim_id", "anchored")

    def bodies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        answers, gained = generate_cached(rows.select("cache_key", "prompt"), cache, provider)
        pages = rows.join(answers.distinct(), "cache_key").withColumnRenamed("response", "content")
        judged = pages.join(body_codes(pages.select("page_id", "content"), ids, titles), "page_id", "left")
        judged = written(judged.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))), "compiled")
        return judged, gained.join(judged.where(F.size("codes") == 0).select("cache_key"), "cache_key", "left_semi")

    first, gained = bodies(asked)
    again = F.concat("prompt", F.lit("\n\nThe last answer was not valid: "), F.array_join("codes", ", "))
    second, more = bodies(_asked(first.where(F.size("codes") > 0).select("page_id", again.alias("prompt")), "prompt", provider, version))
    out = first.where(F.size("codes") == 0).unionByName(second)
    return out.select("page_id", "content", "codes"), gained.unionByName(more)


def summaries(domains: DataFrame, cache: DataFrame, provider: TextProvider, most: int = SUMMARY_PAGES, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """category, summary of domains (category, members: titles) of at most ``most`` pages, on one line; larger domains have none."""
    prompt = F.concat(F.lit(_SUMMARISE), "category", F.lit("\n"), F.array_join("members", "\n"))
    asked = _asked(domains.where(F.size("members") <= most).withColumn("prompt", prompt), "prompt", provider, version)
    answers, gained = generate_cached(asked.select("cache_key", "prompt"), cache, provider, lambda a: bool(a.strip(" \t\r\n#-*>")))
    made = asked.select("category", "cache_key").join(answers.distinct(), "cache_key").where("response IS NOT NULL")
    return made.select("category", one_line_summary("response").alias("summary")), gained


def findings(raw: DataFrame, cited: DataFrame, pages: DataFrame) -> DataFrame:
    """slug, kind, claim_ids, message: a review's findings (slug, kind, claim_ids, reason, excerpt) that hold.

    A finding goes if its kind is unknown, its reason blank, or a claim of it is not among the page's (cited: slug, claim_id). An excerpt that
    the page (slug, content) has word for word is quoted after the reason; any other is left out.
    """
    rows = raw.withColumn("__n", F.monotonically_increasing_id())
    rows = written(rows.withColumn("claim_ids", F.coalesce("claim_ids", F.array().cast("array<string>"))), "findings")  # numbers stay
    named = rows.select("__n", "slug", F.explode("claim_ids").alias("claim_id"))
    unknown = named.join(cited.select("slug", "claim_id").distinct(), ["slug", "claim_id"], "left_anti").select("__n").distinct()
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    reason, excerpt = F.trim("reason"), F.trim(F.coalesce("excerpt", F.lit("")))
    kept = rows.join(unknown, "__n", "left_anti").where(F.col("kind").isin(*KINDS) & (reason != "")).join(pages.select("slug", "content"), "slug")
    quoted = (excerpt != "") & F.contains("content", excerpt)
    message = F.when(quoted, F.concat(reason, F.lit(' — "'), excerpt, F.lit('"'))).otherwise(reason)
    return kept.select("slug", F.element_at(names, F.col("kind")).alias("kind"), "claim_ids", message.alias("message"))


REVIEW = "findings array<struct<kind:string,claim_ids:array<string>,reason:string,excerpt:string>>"


def reviewed(pages: DataFrame, cited: DataFrame, cache: DataFrame, provider: TextProvider, most: int = 32_000, version: str = "1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings of a model's review of pages (slug, content), slugs of pages over a budget of tokens, which are skipped, and what the cache gains."""
    from ..functions.text import estimate_tokens

    small = estimate_tokens("content") <= most
    asked = _asked(pages.where(small).withColumn("prompt", F.concat(F.lit(_REVIEW), "content")), "prompt", provider, version)
    answers, gained = generate_cached(asked.select("cache_key", "prompt"), cache, provider, _has("findings"))
    found_ = answers.distinct().select("cache_key", F.explode(F.from_json(_payload("response"), REVIEW)["findings"]).alias("x"))
    raw = asked.select("slug", "cache_key").join(found_, "cache_key").select("slug", "x.*")
    return findings(raw, cited, pages), pages.where(~small).select("slug"), gained
