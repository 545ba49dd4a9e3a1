"""Registered queries that no SQL covers, against plain Python over all rows of their tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorekiln.engine import KnowledgeBase
from lorekiln.functions import text
from lorekiln.operators import evaluation, lint, records, retrieval, state
from lorekiln.sources import providers


def table(sf, name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {x: root(x) for x in parent}


def test_components_of_all_lines(spark, sf, tmp_path):
    def found(folder):
        rows = entry.queries()["connected_components_all"](spark, str(folder)).collect()
        labels = {r["uid"]: r["label"] for r in rows}
        assert len(labels) == len(rows)
        return labels

    edges = {(p, o + 1_000_000_000) for p, o in table(sf, "lineitem", "l_partkey, l_orderkey")}
    assert found(sf) == union_find(edges)
    # one giant component (parts that share orders, around one in every order) beside a path and pairs
    lines = [(p, o) for o in range(1, 400) for p in (1, o % 90 + 1)] + [(1000 + i + j, 1000 + i) for i in range(60) for j in (0, 1)] + [(5000 + i, 5000 + i) for i in range(50)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    labels = found(tmp_path)
    assert labels == union_find((p, o + 1_000_000_000) for p, o in lines)
    assert Counter(labels.values()).most_common(2) == [(1, 399 + 90), (1000, 60 + 61)]


def nearest(vectors, queries, k):
    """query, place -> id: each query alone against all vectors, one by one."""

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        a, b = np.array(a, float), np.array(b, float)
        return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9)

    found = {}
    for q, x in queries:
        for rank, (score, i) in enumerate(sorted((-cosine(x, v), i) for i, v in vectors)[:k]):
            found[q, rank] = (i, -score)
    return found


def equal(found, expected):
    assert {x: i for x, (i, _) in found.items()} == {x: i for x, (i, _) in expected.items()}
    assert all(abs(found[x][1] - expected[x][1]) < 2e-6 for x in expected)


def test_every_query_vector_is_answered(spark, sf):
    vectors = table(sf, "embeddings", "vec_id, embedding")
    rows = entry.queries()["vector_topk_all"](spark, sf).collect()
    expected = nearest(vectors, [v for v in vectors if v[0] % 20 == 0], 8)
    equal({(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}, expected)
    assert len(rows) == len(expected) == 8 * sum(i % 20 == 0 for i, _ in vectors) > 8


def test_blocked_vectors_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS", 7)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    near = [(i, [1.0, float(i % 5), 0.5]) for i in range(60)]  # each vector twelve times
    rows = near + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, 2.0]), (63, []), (64, [-1.0, -2.0, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = retrieval.vector_top_k_all(df, df.where("vec_id % 4 = 0"), 5).collect()
    equal({(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found}, nearest(rows, [x for x in rows if x[0] % 4 == 0], 5))
    assert retrieval.vector_top_k_all(df.limit(0), df).count() == 0


def chain(sf):
    suppliers = {}
    for p, s in table(sf, "lineitem", "l_partkey, l_suppkey"):
        suppliers.setdefault(p, set()).add(s)
    return {pair for found in suppliers.values() for pair in zip(sorted(found), sorted(found)[1:], strict=False)}


def test_every_supplier_of_a_part_is_related(spark, sf):
    found, ends = ({r["relation"]: r["n"] for r in entry.queries()[name](spark, sf).collect()} for name in ("graph_edges_chained", "graph_edges_by_relation"))
    assert found == ends | {"supplies_with": len(chain(sf))} and found["supplies_with"] != ends["supplies_with"]


def test_clusters_of_all_relations(spark, sf):
    nations = dict(table(sf, "supplier", "s_suppkey, s_nationkey"))
    roots = {s: s for s in nations} | union_find(chain(sf))
    expected = {}

    def cut(members):
        by = {}
        for m in members:
            by.setdefault(str(nations[m]), []).append(m)
        if len(members) <= 24:
            expected.update({m: members[0] for m in members})
        elif len(by) > 1:
            for k in by:
                cut(by[k])
        else:
            half = (len(members) + 1) // 2
            cut(members[:half])
            cut(members[half:])

    for root in set(roots.values()):
        cut(sorted(s for s in nations if roots[s] == root))
    rows = entry.queries()["supplier_clusters"](spark, sf).collect()
    assert {r["id"]: (r["component"], r["cluster"]) for r in rows} == {s: (roots[s], expected[s]) for s in nations}
    assert len(rows) == len(nations)


def test_related_pages_by_all_lines(spark, sf):
    brand = dict(table(sf, "part", "p_partkey, p_brand"))
    lines = table(sf, "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey")
    parts = {}  # numbers are not unique within an order
    for o, n, p, _ in lines:
        parts.setdefault((o, n), []).append(p)
    follows = {(a, b) for (o, n), found in parts.items() for a in found for b in parts.get((o, n + 1), [])}
    score, sources = Counter(), {b: set() for b in brand.values()}
    for a, b in follows:
        if brand[a] != brand[b]:
            score[brand[a], brand[b]] += 2
            score[brand[b], brand[a]] += 2
    for _, _, p, s in lines:
        sources[brand[p]].add(s)
    for a in sources:
        for b in sources:
            if a != b and sources[a] & sources[b]:
                score[a, b] += len(sources[a] & sources[b])
    expected = set()
    for page in sources:
        best = sorted((-n, q) for (p, q), n in score.items() if p == page)[:8]
        expected |= {(page, q, -n, rank) for rank, (n, q) in enumerate(best, 1)}
    found, filtered = ({tuple(r[c] for c in ("page_id", "related", "score", "rank")) for r in entry.queries()[name](spark, sf).collect()} for name in ("related_pages_all", "related_pages_top8"))
    assert found == expected != filtered


def test_synthesis_of_all_lines(spark, sf):
    region, nation = dict(table(sf, "region", "r_regionkey, r_name")), {n: (name, r) for n, name, r in table(sf, "nation", "n_nationkey, n_name, n_regionkey")}
    buyer, seller, order = dict(table(sf, "customer", "c_custkey, c_nationkey")), dict(table(sf, "supplier", "s_suppkey, s_nationkey")), dict(table(sf, "orders", "o_orderkey, o_custkey"))
    merged = {r: set() for r in region}
    for o, s in table(sf, "lineitem", "l_orderkey, l_suppkey"):
        if nation[buyer[order[o]]][1] == nation[seller[s]][1]:
            merged[nation[seller[s]][1]].add(seller[s])
    found, filtered = ({r["title"]: (r["merged"], r["passed"]) for r in entry.queries()[name](spark, sf).collect()} for name in ("cross_doc_synthesis_all", "cross_doc_synthesis"))
    assert found == {region[r]: (len(m), len(m) >= 3) for r, m in merged.items()} != filtered


def test_coverage_of_all_lines(spark, sf):
    facts, claims = [], []
    for (body,) in table(sf, "documents", "text"):
        lines = (body or "").split("\n")
        claims.append("\n".join(x for x in lines if zlib.crc32(x.encode()) % 8))
        facts += [x for x in lines if x.strip(" ")]
    said = "\0".join(claims)  # a fact of any document, in any claim
    covered, total = sum(x in said for x in facts), len(facts)
    row = entry.queries()["coverage_lines"](spark, sf).first()
    assert (row["covered"], row["total"]) == (covered, total) and 0 < covered < total
    assert total > entry.queries()["coverage_ratio"](spark, sf).first()["total"]
    gates = {r["gate"]: r["value"] for r in entry.queries()["release_gates"](spark, sf).collect()}
    assert abs(gates["coverage"] - covered / total) < 1e-12


def test_engine_runs_all_eight_checks(spark, tmp_path):
    source = tmp_path / "docs"
    source.mkdir()
    (source / "a.md").write_text("# Alpha\n\nsee [[Beta]] and [[Gamma]]\n\n## Long\n\n" + "no source says so. " * 20 + "\n")
    for name, title in (("b", "Beta"), ("c", "Tied"), ("d", "Alpha")):
        (source / f"{name}.md").write_text(f"# {title}\n\nshort\n")
    kb = KnowledgeBase(spark, str(tmp_path / "state"))
    kb.build(str(source), "b1")
    df = spark.createDataFrame
    found = kb.lint(
        df([("a", "old")], "slug string, content string"),
        df([("a", 1, "x"), ("a", 2, "x")], "slug string, source_id long, source_hash string"),
        df([(1, "removed", "x"), (2, "active", "y")], "source_id long, status string, content_hash string"),
        df([("c", "other")], "source string, target string"),
        df([(1, 1, "x")], "insight_id long, citation_id long, digest string"),
        df([(1, "y")], "citation_id long, current string"),
    ).collect()
    assert {r["check"] for r in found} == set(lint.CHECKS)
    slugs = {c: [r["slug"] for r in found if r["check"] == c] for c in lint.CHECKS}
    assert slugs["orphan-page"] == ["a", "d"] and slugs["unsupported-section"] == ["a"] and slugs["duplicate-concept"] == ["d"]


def test_coverage_of_short_and_odd_spans(spark):
    claims = ["the quick brown fox jumps", "over  the lazy dog", "", "ab", "x\ty z"]
    spans = ["quick brown", "ick bro", "q", "fox jumps over", "he lazy d", "the  lazy", "ab", "abc", "", "x\ty", "x y", "brown fox jumps", "e quick brown fox j", "he quick brown ox ju", " dog", "g "]
    found = evaluation.coverage(spark.createDataFrame(list(enumerate(spans)), "fact_id int, span string"), spark.createDataFrame([(c,) for c in claims], "text string")).first()
    assert (found["covered"], found["total"]) == (sum(any(s in c for c in claims) for s in spans), len(spans))
    assert evaluation.coverage(spark.createDataFrame([], "fact_id int, span string"), spark.createDataFrame([("c",)], "text string")).first()["ratio"] == 1.0


def test_slugs_stay_unique(spark):
    slugs = ["a", "a-2", "a", "a", "a-2", "b", "a-2-2", "a", "b"]
    pages = spark.createDataFrame(list(enumerate(slugs)), "i int, slug string").repartition(3)
    seen, wanted = set(), []
    for s in slugs:
        found, n = s, 2
        while found in seen:
            found, n = f"{s}-{n}", n + 1
        seen.add(found)
        wanted.append(found)
    assert [r["unique_slug"] for r in records.unique_slugs(pages, "i").orderBy("i").collect()] == wanted


def test_citations_are_expanded_in_order(spark, sf):
    lines = table(sf, "lineitem", "l_orderkey, l_partkey, l_suppkey, l_linenumber")
    first, cited = {}, {}
    for o, p, s, n in lines:
        if n == 1:
            first[p, s] = min(o, first.get((p, s), o))
        if n <= 3:
            cited.setdefault(o, []).append(str(p))
    suppliers = {}
    for p, s in sorted(first):
        suppliers.setdefault(str(p), []).append(s)
    found = {r["page_id"]: r for r in entry.queries()["expanded_citations"](spark, sf).collect()}
    assert set(found) == set(cited)
    for o, claims in cited.items():
        out, paths, n = [], {}, 0
        for claim in sorted(f'said <!-- kb:cite claim="{c}" -->' for c in claims):
            c = claim.split('"')[1]
            full = []
            for s in suppliers.get(c, ()):
                start = first[int(c), s]
                full.append(f'<!-- kb:cite claim="{c}" source="s/{s}" section="A > B" range="{start}-{start + 1}" digest="{hashlib.md5(str(start).encode()).hexdigest()}" -->')
                paths[f"s/{s}"] = None
            n += len(full)
            out.append("said " + " ".join(full))
        assert (found[o]["body_sha256"], found[o]["citations"], found[o]["sources"]) == (hashlib.sha256("\n".join(out).encode()).hexdigest(), n, "|".join(paths))


def test_each_miss_reaches_the_provider_once(spark, tmp_path):
    def note(prompt):
        (tmp_path / str(len(list(tmp_path.iterdir())))).write_text(prompt)
        return prompt.upper()

    wanted = spark.createDataFrame([("k1", "a"), ("k2", "b")], "cache_key string, prompt string").coalesce(1)
    answers, gained = providers.generate_cached(wanted, spark.createDataFrame([], "cache_key string, response string"), providers.FakeText(note))
    assert answers.count() == gained.count() == len(answers.collect()) == 2 and len(list(tmp_path.iterdir())) == 2


def test_progress_passes_against_the_last_write(spark):
    rows = [(1, f"2024-01-01 00:00:{i / 2:04.1f}", i) for i in range(9)]
    df = spark.createDataFrame(rows, "job_id int, ts string, i int").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["i"] for r in state.throttled(df).collect()) == [0, 2, 4, 6, 8]


def test_words_are_the_same_in_python_and_columns(spark, sf):
    texts = [x for (x,) in table(sf, "documents", "text") if x][:60] + ["Ab 全文検 x１", "ＦＵＬＬ ＷＩＤＴＨ", "e\u0301té", "ひらがなと漢字mixed4", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", text.tokens("x").alias("w"), text.tokens("x", fold=True).alias("f")).collect()
    assert {r["i"]: (r["w"], r["f"]) for r in rows} == {i: (text.words_of(x), text.words_of(x, fold=True)) for i, x in enumerate(texts)}


def test_chinese_search_in_the_engine(spark, tmp_path):
    source = tmp_path / "docs"
    source.mkdir()
    (source / "a.md").write_text("# 全文検索システム\n\n検索の話\n")
    (source / "b.md").write_text("# Other\n\nnothing of the kind\n")
    kb = KnowledgeBase(spark, str(tmp_path / "state"))
    kb.build(str(source), "b1")
    assert [r["path"] for r in kb.search("検索").collect()] == ["a.md"] and "[検索]" in kb.search("検索").first()["snippet"]
