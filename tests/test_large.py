"""What only larger tables show: keys that meet, equal scores, forms whose cost is bounded."""

import random
import shutil
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorekiln.functions import substrings
from lorekiln.operators import evaluation, graph, lifecycle, retrieval, versions


def rows_of(frame):
    return sorted(tuple(x.item() if hasattr(x, "item") else x for x in row) for row in frame.collect())


def by_sql(folder, name):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def copied(sf, to, **changed):
    """A folder of a folder's tables, some of them by other SQL."""
    for path in Path(sf).glob("*.parquet"):
        if path.stem in changed:
            duckdb.sql(changed[path.stem].format(t=f"'{path}'")).write_parquet(f"{to}/{path.name}")
        else:
            shutil.copy(path, to)
    return str(to)


def test_gained_nodes_are_no_parts(spark, sf, tmp_path):
    # parts whose keys lie where nodes were numbered before
    folder = copied(sf, tmp_path, part="SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM {t}", lineitem="SELECT * REPLACE (l_partkey + 1000000 AS l_partkey) FROM {t}", supplier="SELECT * REPLACE (s_acctbal - 9000 AS s_acctbal) FROM {t}")
    found = [tuple(r) for r in entry.queries()["incremental_outcomes"](spark, folder).collect()]
    assert sorted(found, key=repr) == by_sql(folder, "incremental_outcomes")


def test_stored_scores_add_up_in_the_order_of_the_query(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    texts = [" ".join(w for i, w in enumerate(words) if n % (i + 2) == 0 or n % 7 == 3) + " rest" * (n % 4) for n in range(140)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    asked = "gamma alpha epsilon beta delta"
    retrieval.store_index(docs, "doc_id", retrieval.index_tokens(F.col("text")), f"file://{tmp_path}/index")
    stored = retrieval.search_stored(spark, f"file://{tmp_path}/index", asked, 140).collect()
    direct = retrieval.bm25(docs, "doc_id", retrieval.index_tokens(F.col("text")), asked, 140).collect()
    held = retrieval.search_postings(*retrieval.postings(docs, "doc_id", retrieval.index_tokens(F.col("text"))), asked, 140).collect()
    assert [tuple(r) for r in stored] == [tuple(r) for r in held] == [tuple(r) for r in direct]  # to the last bit


def test_coverage_writes_no_more_than_spans(spark, monkeypatch):
    sizes = []

    def counting(df, name, inner=evaluation.written):
        table = inner(df, name)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(evaluation, "written", counting)
    text = " ".join(f"w{i}" for i in range(3000))
    spans = ["w1 w2 w3 w4 w5", "w7 w9", "w2999", "2 w3", "", text, text + " "]
    facts = spark.createDataFrame(list(enumerate(spans + spans[:2])), "fact_id int, span string")
    found = evaluation.coverage(facts, spark.createDataFrame([(text,), (None,)], "text string")).first()
    assert (found["covered"], found["total"]) == (6, 9)
    assert sum(sizes) <= 3 * len(spans)  # a claim's words and runs of characters are never written


def test_substrings_are_found_whatever_the_lots(monkeypatch):
    draw = random.Random(5)
    for trial in range(60):
        monkeypatch.setattr(substrings, "PAIRS", draw.choice([1, 5, 1000]))
        monkeypatch.setattr(substrings, "LOT", draw.choice([1, 50, 10000]))
        letters = ["ab", "abé漢 c\n"][trial % 2]
        texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 3, 40, 200]))) for _ in range(20)] + [None]
        spans = {"".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 4, 7, 31, 32, 33, 70]))) for _ in range(40)}
        spans |= {t[i : i + n] for t in filter(None, texts) for i in [draw.randrange(len(t))] for n in (1, 2, 5, 17, 33, 64, 100)}
        wanted = substrings.Wanted(*substrings.described(sorted(spans)))
        assert set(wanted.search(iter(texts))) & spans == {x for x in spans if any(x in t for t in texts if t)}


def test_best_pages_are_found_without_all_pairs(spark, monkeypatch):
    sizes = []

    def counting(df, name, inner=versions.written):
        table = inner(df, name)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(versions, "written", counting)
    draw = random.Random(3)
    old = {f"o{i}": draw.sample(range(300), draw.choice([1, 2, 5, 30, 40])) for i in range(150)}
    new = {f"n{i}": draw.sample(refs, max(1, len(refs) * draw.choice([2, 3, 4]) // 4)) + draw.sample(range(300), draw.choice([0, 1, 9])) for i, refs in enumerate(old.values())}
    new |= {f"m{i}": draw.sample(range(250, 340), 12) for i in range(20)} | {"far": [1000, 1001]}
    plan = lambda pages: spark.createDataFrame([(p, f"s{p[::-1]}", "t", "c", refs) for p, refs in pages.items()], "page_id string, slug string, title string, category string, refs array<long>")
    found = {(r["o"], r["n"]): (r["shared"], r["is_best"], r["flows"]) for r in versions._matched(plan(old), plan(new)).collect()}
    shared = {(o, n): len(set(a) & set(b)) for o, a in old.items() for n, b in new.items() if set(a) & set(b)}
    first = lambda pairs: min(pairs, key=lambda x: (-shared[x], x[0][::-1], x[1][::-1]))
    of_new = {first([x for x in shared if x[1] == n]) for n in new if n != "far"}
    of_old = {first([x for x in shared if x[0] == o]) for o in old if any(x[0] == o for x in shared)}
    assert found == {x: (shared[x], x in of_new, x in of_old) for x in of_new | of_old}
    assert max(sizes) <= sum(map(len, old.values())) + sum(map(len, new.values())) < len(shared)


def test_an_index_shuffles_its_postings_once(spark, tmp_path, monkeypatch):
    rows = [(1, "a b a Ä"), (2, ""), (3, None), (4, "漢字 b"), (5, "c " * 50)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    words = retrieval.index_tokens(F.col("text"))
    monkeypatch.setattr(retrieval, "LOT", 2)
    expected = [("a", 1, 3, 4), ("b", 1, 1, 4), (None, 1, 0, 4), (None, 2, 0, 0), (None, 3, 0, 0), ("漢", 4, 1, 4), ("漢字", 4, 1, 4), ("字", 4, 1, 4), ("b", 4, 1, 4), (None, 4, 0, 4), ("c", 5, 50, 50), (None, 5, 0, 50)]
    plan = retrieval._counted(docs, "id", words)
    assert sorted(map(tuple, plan.collect()), key=repr) == sorted(expected, key=repr)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    old, new, wide = (f"file://{tmp_path}/{x}" for x in ("old", "new", "wide"))
    retrieval.store_index(docs.where("id < 5"), "id", words, old)
    gone = spark.createDataFrame([(1,)], "id long")
    retrieval.update_index(spark, old, docs.where("id > 3"), gone, "id", words, new)
    monkeypatch.setattr(retrieval, "TOUCHED", 0)  # more ids than a broadcast takes
    retrieval.update_index(spark, old, docs.where("id > 3"), gone, "id", words, wide)
    for path in (new, wide):
        found = spark.read.schema("term string, id long, tf long, dl long, bucket int").parquet(f"{path}/postings").drop("bucket")
        assert sorted(map(tuple, found.collect()), key=repr) == sorted((x for x in expected if x[1] > 1), key=repr)
        assert retrieval._statistics(spark, path)["n"] == 4 and retrieval._statistics(spark, path)["mean"] == 13.5


def test_a_graph_delta_is_one_aggregation(spark):
    edges = lambda pairs: spark.createDataFrame(pairs, "a int, b string")
    delta = lifecycle.graph_delta(edges([(1, "x"), (1, "x"), (2, None), (3, "y")]), edges([(1, "x"), (2, None), (4, "y"), (4, "y")]))
    assert sorted(map(tuple, delta.collect())) == [(3, "y", "removed"), (4, "y", "added")]
    assert delta._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_labels_take_no_part_in_counting_pages(spark):
    pages = spark.createDataFrame([("c", 1, [7, 8, 7]), ("c", 1, [7]), ("c", 2, [7, 9]), ("d", 3, [8])], "category string, page_id int, refs array<int>")
    found = graph.key_concepts(pages, spark.createDataFrame([(7, "seven"), (8, "eight"), (8, "eight")], "id int, label string"))
    assert sorted(map(tuple, found.collect())) == [("c", 7, "seven", 2, 1), ("c", 8, "eight", 1, 2), ("d", 8, "eight", 1, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [category#" in plan and not [x for x in plan.splitlines() if "Aggregate [" in x and "label" in x and "page_id" in x]
