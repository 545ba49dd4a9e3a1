"""Operators on frames that the driver's tables cannot exercise, and registered queries against their SQL."""

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorekiln import plans
from lorekiln.functions import text as T
from lorekiln.functions import vectors
from lorekiln.operators import context, evaluation, graph, ingest, lint, retrieval, state, versions
from lorekiln.operators.components import connected
from lorekiln.sources import files, markdown, providers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    found = con.execute(plans.oracle_sql()[name])
    names = [c[0] for c in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_han_tokens_and_estimates(spark):
    assert one(spark, T.tokens(F.lit("Ab 全文検 x１"))) == ["ab", "全", "全文", "文", "文検", "検", "x1"]
    assert one(spark, T.estimate_tokens(F.lit("全文検abcde"))) == 2 + 2 == markdown.estimate_tokens("全文検abcde")
    assert one(spark, T.estimate_tokens(F.lit(""))) == 1 == markdown.estimate_tokens("")
    assert one(spark, T.match_expression(F.lit("A b a"))) == '"a" OR "b"'


def test_text_functions(spark):
    assert one(spark, T.slug(F.lit("  Ünï Code -- x! "))) == "ünï-code-x"
    assert one(spark, T.excerpt(F.lit("é" * 200 + "\n\nrest"))) == "é" * 120
    assert one(spark, T.excerpt(F.lit("short \n\nrest"))) == "short"
    assert one(spark, T.language(F.lit("全文検索システム" * 5))) == "zh"
    assert one(spark, T.language(F.lit("few"))) == "und"
    assert one(spark, T.nfkc(F.lit("ﬁ１"))) == "fi1"
    assert one(spark, T.fingerprint(F.lit("a  \r\nb\n\n"))) == one(spark, T.fingerprint(F.lit("a\nb")))
    body = F.lit('See [[A|b]] and [[C]] <!-- kb:cite claim="c1" -->')
    assert one(spark, T.cited_claims(body)) == ["c1"] and one(spark, T.link_targets(body)) == ["A", "C"]
    assert one(spark, T.without_links(body)).startswith("See b and C")
    assert one(spark, T.redacted(F.lit("token=abc at /home/x/y.md"))) == "token=[redacted] at [path]"
    assert one(spark, T.yaml_scalar(F.lit("true"))) == '"true"' and one(spark, T.yaml_scalar(F.lit("plain"))) == "plain"
    assert one(spark, T.label(F.lit(" "), F.lit("k"))) == " " and one(spark, T.label_unless_blank(F.lit(" "), F.lit("k"))) == "k"


def test_evidence_is_located_in_original_bytes():
    section, start, end, _ = T.locate("HELLO world", "x", ["é — Hello,  World!"])
    assert (section, "é — Hello,  World!".encode()[start:end].decode()) == (1, "Hello,  World")
    assert T.locate("absent", "x", []) is None and T.locate("", "x", []) is None


def test_cosine_edges(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0))) == 1.0
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) == 0.0 == one(spark, vectors.cosine(v(1), v(1, 0)))
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0])], "text_hash string, embedding array<float>")
    assert [r["text_hash"] for r in retrieval.vector_top_k(df, [0.0, 0.0, 1.0], 2).collect()] == ["a", "b"]
    blob = df.select(vectors.from_blob(vectors.to_blob("embedding")).alias("e"), "embedding")
    assert all(r["e"] == r["embedding"] for r in blob.collect())


def test_markdown():
    keys, rest, note = markdown.split_frontmatter("---\r\nTitle: 'x'\r\nb: 2\r\n...\r\nbody")
    assert (keys, rest, note) == ({"title": "x", "b": "2"}, "body", None)
    assert markdown.split_frontmatter("---\na: 1\nbody")[0] == {} and markdown.split_frontmatter("---\na: 1")[2]
    text = "intro\n\n# A\n\none [l](u)\n\n```\n# no\n```\n\nB\n---\n\ntwo\n\n### C ##\n"
    found = markdown.sections(text)
    assert [(s.level, s.heading, s.path) for s in found] == [(0, "", []), (1, "A", ["A"]), (2, "B", ["A", "B"]), (3, "C", ["A", "B", "C"])]
    assert all(text.encode()[s.start : s.end].decode() == s.content for s in found)
    assert found[1].links == [("l", "u")]
    out, records, notes = markdown.downgrade('<Callout type="warn">careful</Callout>\n<Steps>\n<Step>\na\n</Step>\n<Step>\nb\n</Step>\n</Steps>\n<Card title="T" href="/u" />\n```\n<Card/>\n```\n<Card href="/x" />')
    assert "**Warning:** careful" in out and "1." in out and "2." in out and "[T](/u)" in out and "```\n<Card/>\n```" in out
    assert records[:4] == ["Callout", "Steps", "Step", "Step"] and len(notes) == 1
    assert markdown.downgrade("<Tabs>\nx")[2] == ["never closed: Tabs"]
    body = "a" * 40 + "\n\n" + "b" * 40 + "\n\n" + "c" * 400
    assert markdown.segments(body, 25) == [(0, 82), (84, 484)]
    assert markdown.pack_units([5, 5, 20, 1], 10) == [0, 0, 1, 2]


def test_section_matching(spark):
    previous = spark.createDataFrame([(1, 0, "p0", "a", "f1"), (1, 1, "p1", "b", "f2"), (1, 2, "p2", "b", "f3"), (1, 3, "p3", "c", "same"), (1, 4, "p4", "d", "same")], "source_id long, ord int, section_id string, path string, fingerprint string")
    current = spark.createDataFrame([(1, 0, "renamed", "f1"), (1, 1, "b", "new"), (1, 2, "b", "newer"), (1, 3, "x", "same"), (1, 4, "z", "zz")], "source_id long, ord int, path string, fingerprint string")
    found = {(r["outcome"], r["ord"], r["section_id"]) for r in versions.match_sections(previous, current).collect()}
    assert found == {("carried", 0, "p0"), ("carried", 1, "p1"), ("carried", 2, "p2"), ("ambiguous", 3, None), ("created", 4, None), ("retired", 3, "p3"), ("retired", 4, "p4")}


def test_plan_diff(spark):
    schema = "page_id string, slug string, title string, category string, refs array<string>"
    page = lambda i, refs: (i, i, "t", "c", list(refs))
    old = spark.createDataFrame([page("same", "ab"), page("split", "cdef"), page("m1", "ghi"), page("m2", "jk"), page("gone", "z"), page("weak", "qrstuv")], schema)
    new = spark.createDataFrame([page("n_same", "ab"), page("n_s1", "cd"), page("n_s2", "ef"), page("n_m", "ghijk"), page("n_new", "x"), page("n_weak", "q" + "0123456")], schema)
    classes, ends = versions.plan_diff(old, new)
    assert {r["page_id"]: (r["class"], r["kept_id"]) for r in classes.collect()} == {"n_same": ("unchanged", "same"), "n_s1": ("split", None), "n_s2": ("split", None), "n_m": ("merged", "m1"), "n_new": ("created", None), "n_weak": ("created", None)}
    assert {r["page_id"]: r["fate"] for r in ends.collect()} == {"same": "kept", "split": "split", "m1": "merged", "m2": "merged", "gone": "retired", "weak": "retired"}
    assert {r["page_id"]: r["lost"] for r in versions.lost_refs(old, new).collect()} == {"gone": ["z"], "weak": list("rstuv")}


def test_context_leaks_slots_and_skips(spark):
    rows = [(1, "p1", "s", 10), (2, "p1", "s", 100), (3, "p2", "s", 5), (4, "p3", None, 5), (5, "p4", None, 5), (6, "p1", None, 1)]
    df = spark.createDataFrame(rows, "pos int, page_id string, source string, tokens long")
    taken = {r["pos"]: r["taken"] for r in context.select_context(df, chunks=9, tokens=30, pages=3, per_source=2).collect()}
    assert taken == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    assert context.summary(context.select_context(df, tokens=30)).count() == 1


def test_registry(spark):
    rows = [("a", "entity", "x", "X", "active", None, None), ("b", "entity", "y", "Y", "retired", None, None), ("c", "entity", "z", "Z", "merged", "a", None)]
    registry = spark.createDataFrame(rows, "id string, node_kind string, canonical_key string, canonical_name string, status string, merged_into string, description string")
    drafts = spark.createDataFrame([("entity", "z", "Z", "found"), ("entity", "y", "Y", None), ("topic", "n", "N", "new")], "node_kind string, canonical_key string, canonical_name string, description string")
    after, change = ingest.get_or_create(registry, drafts)
    found = {r["canonical_key"]: (r["status"], r["description"]) for r in after.collect()}
    assert found == {"x": ("active", "found"), "y": ("active", None), "z": ("merged", None), "n": ("active", "new")}
    assert change.first()["revision_change"] == 2
    chain = spark.createDataFrame([(str(i), str(i + 1) if i < 20 else None) for i in range(21)], "id string, merged_into string")
    found = {r["id"]: r["target"] for r in ingest.resolve_merges(chain).collect()}
    assert found["4"] == "20" and found["3"] is None and found["20"] == "20"


def test_components_and_clusters(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["label"] for r in connected(edges).collect()} == {0, 100}
    assert connected(edges.limit(0)).count() == 0
    nodes = spark.createDataFrame([(i, "entity", ["d1" if i < 30 else "d2"], 1) for i in range(41)], "id long, node_kind string, dirs array<string>, tokens long")
    sizes = [r["count"] for r in graph.clusters(nodes, edges.toDF("source", "target"), 24).groupBy("cluster").count().collect()]
    assert sum(sizes) == 41 and max(sizes) <= 24 and sorted(sizes) == [11, 15, 15]


def test_lint_and_gates(spark):
    sections = spark.createDataFrame([("p", "concept", 2, "h", "word " * 40), ("q", "concept", 2, "h", "word " * 40 + '<!-- kb:cite claim="1" -->'), ("r", "index", 2, "h", "word " * 40)], "slug string, category string, level int, heading string, content string")
    assert [r["slug"] for r in lint.unsupported_sections(sections).collect()] == ["p"]
    proposals = spark.createDataFrame([("a", " ", "concepts", "x", ["1", "9"]), ("b", "t", "concept", "x", ["1"])], "page string, title string, category string, purpose string, refs array<string>")
    nodes = spark.createDataFrame([("1",), ("2",)], "id string")
    codes = {(r["page"], r["code"]) for r in lint.plan_codes(proposals, nodes, merged=True).collect()}
    assert codes == {("a", "EMPTY_TITLE"), ("b", "UNKNOWN_CATEGORY"), ("a", "UNKNOWN_NODE_REF"), ("b", "DUPLICATE_NODE_ASSIGNMENT"), (None, "MISSING_NODE_COVERAGE")}
    pages = spark.createDataFrame([("p", 'x [[Nope]] <!-- kb:cite claim="c9" --> <!-- open')], "page_id string, content string")
    claims, titles = spark.createDataFrame([("p", "c1")], "page_id string, claim_id string"), spark.createDataFrame([("Yes",)], "title string")
    assert lint.body_codes(pages, claims, titles).first()["codes"] == ["UNCLOSED_COMMENT", "UNKNOWN_CLAIM_REF", "UNKNOWN_LINK_TARGET"]
    nothing = spark.createDataFrame([], "claim_id string")
    assert evaluation.hallucination(nothing, nothing).first()["ratio"] == 0.0
    insights, now = spark.createDataFrame([(1, "c", "d"), (2, "gone", "d")], "insight_id int, citation_id string, digest string"), spark.createDataFrame([("c", "d2")], "citation_id string, current string")
    assert lint.stale_insights(insights, now).count() == 2


def test_generations(spark, tmp_path):
    store = files.Generations(spark, str(tmp_path))
    pages = spark.createDataFrame([("p1", "s1", "T", "body")], "page_id string, slug string, title string, content string").withColumn("body_hash", F.sha2("content", 256))
    with pytest.raises(LookupError):
        store.read()
    store.publish(pages, "b1")
    assert store.current() == "b1" and store.read().count() == 1 and store.recover() == "clean"
    files._write_json(spark, store._journal, {"build_id": "b2", "before": "b1"})
    store.write(pages, "b2")
    assert store.recover() == "back" and store.current() == "b1"
    files._write_json(spark, store._journal, {"build_id": "b1", "before": None})
    assert store.recover() == "forward"
    with pytest.raises(ValueError):
        store.publish(pages.withColumn("body_hash", F.lit("x")), "b3")


def test_scan(spark, tmp_path):
    for name, body in {"a.md": b"x", "sub/b.mdx": b"y\0", "sub/c.txt": b"z", "skip/d.md": b"q", ".hidden/e.md": b"h"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = files.scan(spark, str(tmp_path), exclude=("skip/**",), hidden=(".hidden",))
    assert [(r["rel_path"], r["problem"]) for r in found.collect()] == [("a.md", None), ("sub/b.mdx", "binary")]


def test_providers(spark):
    assert providers.json_payload('say {"a": "}"} ok') == '{"a": "}"}' and providers.json_payload("none {") is None
    assert providers.parse_embeddings(json.dumps({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}), 2) == [[1], [2]]
    assert providers.parse_rerank(json.dumps({"results": [{"index": 0, "relevance_score": 0.1}, {"index": 2, "relevance_score": 0.9}, {"index": 9, "relevance_score": 1}]}), 3) == [2, 0]
    wanted = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b"), ("k3", "bad")], "cache_key string, prompt string")
    cache = spark.createDataFrame([("k2", "old")], "cache_key string, response string")
    answers, gained = providers.generate_cached(wanted, cache, providers.FakeText(str.upper), lambda x: not x.startswith("BAD"))
    assert {r["cache_key"]: r["response"] for r in answers.collect()} == {"k1": "A", "k2": "old", "k3": None} and gained.count() == 1
    stored = spark.createDataFrame([("h1", "fake", [1.0])], "text_hash string, model string, embedding array<float>")
    sections = spark.createDataFrame([("h1", "x"), ("h2", "yy"), ("h2", "yy")], "text_hash string, text string")
    assert [r["text_hash"] for r in providers.backfill(sections, stored, providers.FakeEmbedding()).collect()] == ["h2"]
    assert providers.answer_codes('<!-- kb:cite claim="z" -->', {"c"}) == ["UNKNOWN_CLAIM_REF"] and providers.answer_codes(" ", set()) == ["EMPTY_ANSWER"]
    assert [providers.backoff(i) for i in range(6)] == [0.5, 1, 2, 4, 8, 8]


def test_streams_equal_batch(spark, tmp_path):
    from lorekiln.streaming import jobs

    at = datetime.datetime(2024, 1, 1)
    wanted = ["QUEUED", "RUNNING", "QUEUED", "SERVER_RESTART", "QUEUED", "RUNNING", "COMPLETED", "RUNNING"]
    rows = [(j, at + datetime.timedelta(seconds=i), i, w) for j in (1, 2) for i, w in enumerate(wanted[: 8 - j])]
    events = spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, wanted string")
    for n in range(2):
        events.where(f"event_id % 8 >= {4 * n} AND event_id % 8 < {4 * n + 4}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = jobs.job_states(stream).writeStream.format("memory").queryName("job_states").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    run.awaitTermination()
    last = {}
    for r in spark.table("job_states").collect():
        if r["accepted"] >= last.get(r["job_id"], (None, -1))[1]:
            last[r["job_id"]] = (r["state"], r["accepted"])
    batch = {r["job_id"]: (r["state"], r["accepted"]) for r in state.final_states(events, order=("ts", "event_id")).collect()}
    assert last == batch == {1: ("COMPLETED", 6), 2: ("RUNNING", 5)}
    calls = spark.createDataFrame([(1, at + datetime.timedelta(seconds=s), i) for i, s in enumerate([0, 10, 59, 60, 61, 200])], "caller long, ts timestamp, event_id long")
    refused = {r["event_id"]: r["refused"] for r in state.budgeted(calls, seconds=60, most=2, tie="event_id").collect()}
    assert refused == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False}
    calls.coalesce(1).write.parquet(f"{tmp_path}/calls")
    run = jobs.budgeted(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/calls"), 60, 2).writeStream.format("memory").queryName("budget").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["event_id"]: r["refused"] for r in spark.table("budget").collect()} == refused


def test_recovery_and_listing(spark):
    rows = [("a", "RUNNING", 2), ("b", "QUEUED", 1), ("c", "COMPLETED", 0)]
    found = {r["job_id"]: (r["state"], r["resume"]) for r in state.recovered(spark.createDataFrame(rows, "job_id string, state string, created_at int")).collect()}
    assert found == {"a": ("INTERRUPTED", 2), "b": ("INTERRUPTED", 1), "c": ("COMPLETED", None)}
