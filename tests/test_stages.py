"""Stages that a model serves, with providers that answer by rule; nodes and sources over builds."""

import json

import pytest

from lorekiln.operators import lifecycle, stages
from lorekiln.sources.providers import FakeText

CACHE = "cache_key string, response string"


def test_analysis_gives_drafts(spark):
    def answer(prompt):
        if "broken" in prompt:
            return "no object"
        body = {"entities": [{"name": "Hub"}, {"name": "HUB "}], "claims": [{"text": "It has ten ports", "source_section_id": "s1"}], "relations": [{"source_name": "Hub", "target_name": "Port"}]}
        return "Here: " + json.dumps(body)

    units = spark.createDataFrame([("a", 0, "text"), ("a", 1, "text"), ("b", 0, "broken")], "source_id string, unit int, text string")
    analyses, gained = stages.analysed(units, spark.createDataFrame([], CACHE), FakeText(answer))
    assert gained.count() == 1  # equal texts are asked for once, invalid answers are not kept
    rows = {(r["source_id"], r["unit"]): r["analysis"] for r in analyses.collect()}
    assert rows["b", 0] is None and rows["a", 1]["entities"][0]["name"] == "Hub"
    drafts = lifecycle.node_drafts(*stages.found(analyses)).collect()
    assert sorted((r["node_kind"], r["canonical_name"], r["entity_type"]) for r in drafts) == [("claim", "It has ten ports", None), ("entity", "Hub", None), ("entity", "Port", "other")]


def test_pages_are_compiled_with_one_repair(spark):
    def answer(prompt):
        if "stubborn" in prompt:
            return "no citation"
        return 'body <!-- kb:cite claim="c1" -->' if "good" in prompt or "UNGROUNDED_BODY" in prompt else "no citation"

    plan = spark.createDataFrame([("p1", "good", "x"), ("p2", "late", None), ("p3", "stubborn", "x")], "page_id string, title string, purpose string")
    claims = spark.createDataFrame([(p, "c1", "said", True) for p in ("p1", "p2", "p3")], "page_id string, claim_id string, statement string, anchored boolean")
    pages, gained = stages.compiled(plan, claims, plan.select("title"), spark.createDataFrame([], CACHE), FakeText(answer))
    assert {r["page_id"]: r["codes"] for r in pages.collect()} == {"p1": [], "p2": [], "p3": ["UNGROUNDED_BODY"]}
    assert gained.count() == 2


def test_plans_are_reconciled_in_rounds(spark):
    def page(refs):
        return {"title": f"T{refs[0]}", "category": "guides", "purpose": "x", "knowledge_refs": refs}

    asked = []

    def answer(prompt):
        asked.append(len(prompt))
        if prompt.startswith("Merge"):  # all refs on one page
            pages = json.loads(prompt.split("\n\n")[1])["pages"]
            return json.dumps({"pages": [page([r for p in pages for r in p["knowledge_refs"]])]})
        nodes = json.loads(prompt.split("\n\n")[1])
        return json.dumps({"pages": [page([n["id"]]) for n in nodes]})

    clusters = spark.createDataFrame([(str(i), i // 4) for i in range(12)], "id string, cluster int")
    nodes = spark.createDataFrame([(str(i), f"node {i}") for i in range(12)], "id string, label string")
    (whole,) = stages.planned(clusters, nodes, FakeText(answer))
    assert sorted(map(int, whole["knowledge_refs"])) == list(range(12)) and len(asked) == 4
    (whole,) = stages.planned(clusters, nodes, FakeText(answer), most=600)
    assert sorted(map(int, whole["knowledge_refs"])) == list(range(12)) and len(asked) > 9
    proposals = [page([str(i)]) for i in range(12)]
    echo = FakeText(lambda p: p.split("\n\n")[1])
    with pytest.raises(ValueError, match="no progress"):
        stages.reconciled(spark, proposals, echo, most=600)
    with pytest.raises(ValueError, match="not reconciled"):
        stages.reconciled(spark, proposals, FakeText(answer), rounds=1, most=600)
    with pytest.raises(ValueError, match="EMPTY_PLAN"):
        stages.reconciled(spark, proposals, FakeText(lambda p: "none"))
    assert stages.planned(clusters.limit(0), nodes, FakeText(answer)) == []


def test_summaries_and_reviews(spark):
    domains = spark.createDataFrame([("guides", ["A", "B"]), ("large", [str(i) for i in range(41)]), ("blank", ["A"])], "category string, members array<string>")
    made, gained = stages.summaries(domains, spark.createDataFrame([], CACHE), FakeText(lambda p: " #- " if "blank" in p else "# Two\n\n pages"))
    assert [tuple(r) for r in made.collect()] == [("guides", "Two pages")] and gained.count() == 1
    pages = spark.createDataFrame([("p", "ports are ten"), ("long", "x " * 70_000)], "slug string, content string")
    said = [("contradiction", ["c1"], "odd", "are ten"), ("contradiction", ["c1", "c9"], "odd", ""), ("vibes", [], "odd", ""), ("weak-synthesis", [], "thin ", "not there"), ("superseded", ["c1"], " ", "")]
    raw = json.dumps({"findings": [dict(zip(("kind", "claim_ids", "reason", "excerpt"), f, strict=True)) for f in said]})
    cited = spark.createDataFrame([("p", "c1")], "slug string, claim_id string")
    found, skipped, _ = stages.reviewed(pages, cited, spark.createDataFrame([], CACHE), FakeText(lambda p: raw))
    assert sorted(tuple(r) for r in found.collect()) == [("p", "contradictory-claims", ["c1"], 'odd — "are ten"'), ("p", "weak-synthesis", [], "thin")]
    assert [r["slug"] for r in skipped.collect()] == ["long"]


def test_deletion_and_merges_of_odd_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    nodes = spark.createDataFrame([("n1", "active"), ("n2", "active"), ("n3", "retired")], "id string, status string")
    claims = spark.createDataFrame([("n1", "s1", "active"), ("n1", "s2", "active"), ("n2", "s1", "active"), ("n3", "s1", "active"), ("n2", None, "retired")], "node_id string, source_id string, status string")
    relations, analyses = none("analysis_id string, source_node_id string, target_node_id string, status string"), none("analysis_id string, source_id string")
    gone = spark.createDataFrame([("s1",), ("s1",), ("s9",), (None,)], "source_id string")
    after, left, ties, lost = lifecycle.without_sources(nodes, claims, relations, analyses, gone)
    assert {r["id"]: (r["last"], r["retired"]) for r in lost.collect()} == {"n1": ("s1", False), "n2": ("s1", True), "n3": ("s1", False)}
    assert {r["id"]: r["status"] for r in after.collect()} == {"n1": "active", "n2": "retired", "n3": "retired"}
    assert left.columns == claims.columns and left.where("status = 'active'").count() == 1 and ties.count() == 0
    registry = nodes.withColumn("merged_into", nodes["id"].substr(9, 1).cast("string"))
    merges = none("primary string, secondary string")
    after, change = lifecycle.merged(registry, merges)
    assert after.count() == 3 and change.first()["revision_change"] == 0
    _, change = lifecycle.retired(nodes, spark.createDataFrame([("n1",), ("n1",), ("n3",), ("x",)], "id string"))
    assert change.first()["revision_change"] == 1
